"""Wordings as rows of a table, matched on the words of a text rather than on its characters.

A text is spelled as its words, lower-cased, one blank about each; ``;`` stands where a
clause ends, and a word of two to five capitals is led by ``^``.  A phrase is words apart
by blanks:

    avoid*      a word that begins so          *rá        a word that ends so
    if|when     either word                    [the|a]    either word or none
    ..12        up to twelve words of the same clause
    {caps}      a word in capitals             {local}    a word of :data:`CLASSES`

Phrases compile to patterns of the common subset of regular expressions, so an SQL engine
that has the same spelling takes the same table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = {"local": "local|city|town|county|municipal*"}

_STEPS = [
    (r"\^", " "), (r"\b([A-Z]{2,5})\b", r"^\1"), (r"\.([^0-9]|$)", r" ; \1"), (";", " ; "), (r"[^\p{L}\p{N};^]+", " "),
]


def spelled(text: Column) -> Column:
    """The words of a text as phrases take them; a null text has none."""
    out = F.coalesce(text, F.lit(""))
    for pattern, to in _STEPS:
        out = F.regexp_replace(out, pattern, to.replace("\\1", "$1"))
    return F.concat(F.lit(" "), F.lower(F.trim(out)), F.lit(" "))


def sql_spelled(text: str) -> str:
    """The same as SQL."""
    out = f"coalesce({text}, '')"
    for pattern, to in _STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"(' ' || lower(trim({out})) || ' ')"


def _word(word: str) -> str:
    if word == "{caps}":
        return r"\^[^ ]+ "
    if word.startswith("{"):
        return _either(CLASSES[word[1:-1]])
    return r"\^?" + ("[^ ;]*" if word.startswith("*") else "") + word.strip("*") + ("[^ ;]*" if word.endswith("*") else "") + " "


def _either(words: str) -> str:
    return "(?:" + "|".join(_word(w) for w in words.split("|")) + ")"


def pattern(phrase: str) -> str:
    """A phrase as a pattern over a spelled text."""
    parts = []
    for part in phrase.split():
        if part.startswith(".."):
            parts.append(f"(?:[^; ]+ ){{0,{part[2:]}}}")
        elif part.startswith("["):
            parts.append(_either(part[1:-1]) + "?")
        else:
            parts.append(_either(part))
    return " " + "".join(parts)


def phrases(table: str) -> list[str]:
    """The rows of a table: phrases apart by commas or line ends."""
    return [" ".join(p.split()) for line in table.splitlines() for p in line.split(",") if p.strip()]


def any_of(table: list[str]) -> str:
    return "|".join(pattern(p) for p in table)


def says(words: Column, table: list[str]) -> Column:
    """Whether a phrase of the table occurs in a spelled text."""
    return words.rlike(any_of(table))


def begins(words: Column, table: list[str]) -> Column:
    """Whether a spelled text begins with a phrase of the table."""
    return words.rlike("^(?:" + any_of(table) + ")")


def said(words: Column, table: list[str]) -> Column:
    """The words that each phrase of the table was found as, in order, each once."""
    found = [F.translate(F.trim(F.regexp_extract(words, pattern(p), 0)), "^", "") for p in table]
    none = F.array().cast("array<string>")
    return F.when(says(words, table), F.array_sort(F.array_distinct(F.filter(F.array(*found), lambda w: w != "")))).otherwise(none)
