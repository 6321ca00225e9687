"""Questions in plain words: tokens, phrases, intents, how well a row fits, excerpts and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and what they are without; words too common to tell anything.
_marked, _plain = "áàâäãåéèêëíìîïóòôöõúùûüñçý", "aaaaaaeeeeiiiiooooouuuuncy"
STOPWORDS = ("that", "this", "with", "from", "what", "when", "does", "have", "para", "como", "esta", "este", "nicht", "eine", "dans", "pour")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, marks kept."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def unmarked(words: Column) -> Column:
    """The same without marks, so that accents don't matter to a match; a mark that stands alone is dropped."""
    return F.transform(words, lambda t: F.translate(F.regexp_replace(t, r"\p{M}+", ""), _marked, _plain))


def word_matches(token: Column, word: Column) -> Column:
    """A word of four letters and more matches all that begins with it, a shorter one only itself."""
    return F.when(F.char_length(word) >= 4, token.startswith(word)).otherwise(token == word)


def _hits_of(words: Column, key: str, phrase: str) -> Column:
    parts = phrase.split()
    n = len(parts)

    def stands(i: Column) -> Column:
        holds = word_matches(F.element_at(words, i + 1), F.lit(parts[0]))
        for j in range(1, n):
            holds = holds & word_matches(F.element_at(words, i + j + 1), F.lit(parts[j]))
        return F.when(i + n <= F.size(words), holds).otherwise(False)

    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), stands)
    return F.transform(places, lambda i: F.struct(F.lit(n).alias("len"), i.alias("start"), F.lit(key).alias("key")))


def phrase_hits(words: Column, phrases: list[tuple[str, str]]) -> Column:
    """``(len, start, key)`` of each place where a phrase of the lexicon stands; the lexicon, ``(key, phrase)``, is a constant of the caller."""
    none = F.array().cast("array<struct<len:int,start:int,key:string>>")
    # a phrase's places are looked for only where one compiled look at the text finds it
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    stands = lambda phrase: text.contains(" " + phrase.split()[0]) & text.rlike(" " + " ".join(w if len(w) < 4 else w + "[^ ]*" for w in phrase.split()) + " ")
    return F.flatten(F.array(*[F.when(stands(phrase), _hits_of(words, key, phrase)).otherwise(none) for key, phrase in phrases]))


def greedy(hits: Column) -> Column:
    """Hits chosen longest first, then from the left, none over another; in order of place. A question is short, so one row's work."""
    ranked = F.transform(F.array_sort(F.transform(hits, lambda h: F.struct((-h["len"]).alias("a"), h["start"].alias("b"), h["key"].alias("c")))), lambda h: F.struct((-h["a"]).alias("len"), h["b"].alias("start"), h["c"].alias("key")))
    free = lambda kept, h: F.forall(kept, lambda k: (h["start"] + h["len"] <= k["start"]) | (k["start"] + k["len"] <= h["start"]))
    chosen = F.aggregate(ranked, F.slice(ranked, 1, 0), lambda kept, h: F.when(free(kept, h), F.concat(kept, F.array(h))).otherwise(kept))
    return F.array_sort(F.transform(chosen, lambda h: F.struct(h["start"].alias("start"), h["len"].alias("len"), h["key"].alias("key"))))


def best_key(kept: Column, keys: tuple[str, ...]) -> Column:
    """``(score, key)`` of the key with most words hit, the earlier of ``keys`` where two have as many; null if none is hit."""
    hit = lambda key: F.aggregate(F.filter(kept, lambda h: h["key"] == key), F.lit(0), lambda s, h: s + h["len"])
    scores = F.array(*[F.struct(hit(key).alias("score"), F.lit(-i).alias("first"), F.lit(key).alias("key")) for i, key in enumerate(keys)])
    best = F.array_max(scores)
    return F.when(best["score"] > 0, F.struct(best["score"].alias("score"), best["key"].alias("key")))


def intent(kept: Column, categories: tuple[str, ...], kinds: tuple[str, ...]) -> Column:
    """``(kind, category)``: a category where it has as many words as any other kind; else that kind, with the category it is narrowed to."""
    category, other = best_key(kept, categories), best_key(kept, kinds)
    by_category = category.isNotNull() & (other.isNull() | (category["score"] >= other["score"]))
    named = lambda kind, of: F.struct(kind.alias("kind"), of.alias("category"))
    wide = other["key"].isin("jurisdiction", "overview")
    return (
        F.when(by_category, named(F.lit("category"), category["key"])).when(other.isNull(), named(F.lit("no_match"), F.lit(None).cast("string")))
        .otherwise(named(other["key"], F.when(~wide, category["key"])))
    )


def content(words: Column) -> Column:
    return F.filter(words, lambda t: (F.char_length(t) >= 4) & ~t.isin(*STOPWORDS))


def overlap(question: Column, row: Column) -> Column:
    """Distinct telling words of a question that begin, or are begun by, a telling word of the row; both are token arrays."""
    theirs = content(row)
    return F.size(F.filter(F.array_distinct(content(question)), lambda t: F.exists(theirs, lambda w: w.startswith(t) | t.startswith(w))))


def excerpt(text: Column, most: int = 220) -> Column:
    """The text if short enough, else its beginning up to a blank, if that keeps over half, and an ellipsis."""
    whole = F.trim(text)
    head = F.substring(whole, 1, most + 1)
    cut = F.char_length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (cut > most / 2), cut).otherwise(most)
    return F.when(F.char_length(whole) <= most, whole).otherwise(F.concat(F.rtrim(F.substring(whole, F.lit(1), cut.cast("int"))), F.lit("…")))


def has_word(text: Column, word: str) -> Column:
    """Whether a word or phrase stands in the text between signs that are neither letters nor digits."""
    quoted = "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in word)
    return text.rlike(f"(^|[^a-z0-9]){quoted}($|[^a-z0-9])")


def keyword_score(title: Column, body: Column, strong: list[str], weak: list[str], demote: list[str]) -> Column:
    """Two a strong word and one a weak one, three times that in the title, eight off where the title has a demoting one."""
    plain = lambda c: F.translate(F.lower(F.coalesce(c, F.lit(""))), "‘’ʼ`", "''''")
    title, body = plain(title), plain(body)
    score = F.lit(0)
    for words, weight in ((strong, 2), (weak, 1)):
        for w in words:
            score = score + F.when(has_word(title, w), 3 * weight).when(has_word(body, w), weight).otherwise(0)
    side = F.lit(False)
    for w in demote:
        side = side | has_word(title, w)
    return score - F.when(side, 8).otherwise(0)


def counts_said(applies: Column, unknown: Column, pending: Column) -> Column:
    """``3 apply, 1 not known, 2 proposed``; what there is none of goes unsaid."""
    part = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(what)))
    said = F.concat_ws(", ", part(applies, " apply"), part(unknown, " not known"), part(pending, " proposed"))
    return F.when(said == "", "nothing found").otherwise(said)
