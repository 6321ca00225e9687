"""Small text functions: numbers, citations, addresses, unit counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers that texts spell out.
NUMBER_WORDS = {
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12",
    "fifteen": "15", "twenty": "20", "thirty": "30", "sixty": "60", "ninety": "90", "half": "0.5",
}


def numbers_in(text: Column) -> Column:
    """Distinct numbers of a text, thousands commas dropped, spelled ones as digits; one and one-half is 1.5 too."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), 0), lambda x: F.regexp_replace(x, ",", ""))
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    spelled = F.filter(F.transform(F.split(F.lower(text), "[^a-z]+"), lambda w: words[w]), lambda x: x.isNotNull())
    mixed = F.when(F.lower(text).rlike(r"\bone and (?:one-half|a half)\b"), F.array(F.lit("1.5"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(found, spelled, mixed))


def unsupported_numbers(claim: Column, source: Column) -> Column:
    """Numbers of the claim that the source doesn't have."""
    return F.array_except(numbers_in(claim), numbers_in(source))


def citation_key(citation: Column) -> Column:
    """What differently written citations of one law share: a number in parts, else chamber and number, else a bill's letters and number, else letters and digits.

    The citation is read as its words; the first that fits the strongest kind decides.
    """
    words = F.filter(F.split(F.coalesce(citation, F.lit("")), r"[^\p{L}\p{N}.:-]+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(w, r"^[.:-]+|[.:-]+$", "")
    first = lambda kind: F.get(F.filter(F.transform(words, kind), lambda k: k.isNotNull()), F.lit(0))
    number = lambda w: F.when(w.rlike("^[0-9]{2,5}$"), w)

    def section(w: Column) -> Column:
        inside = F.filter(F.split(w, r"^[^0-9]+|[^0-9A-Za-z.:-]+"), lambda x: x != "")
        return F.get(F.filter(F.transform(inside, bare), lambda x: x.rlike("^[0-9]+[A-Za-z]?([.:-][0-9]+[A-Za-z]?)+$")), F.lit(0))

    def chamber(w: Column, i: Column) -> Column:
        after = F.transform(F.slice(words, i + 2, F.lit(3)), lambda x: F.lower(bare(x)))
        glued = F.regexp_extract(F.get(after, F.lit(0)), "^no[.]?([0-9]{2,5})$", 1)
        rest = F.filter(after, lambda x: ~x.isin("bill", "no"))
        direct = F.coalesce(F.nullif(glued, F.lit("")), F.when(F.array_contains(after, "no"), number(F.get(rest, F.lit(0)))))
        return F.when(F.lower(bare(w)).isin("senate", "house", "assembly"), F.concat(F.substring(w, 1, 1), direct))

    def bill(w: Column, i: Column) -> Column:
        apart = F.when(bare(w).rlike("^[A-Z]{1,3}$"), F.concat(bare(w), number(bare(F.get(words, i + 1)))))
        return F.coalesce(apart, F.when(bare(w).rlike("^[A-Z]{1,3}[.]?[0-9]{2,5}$"), F.translate(bare(w), ".", "")))

    return F.lower(F.coalesce(first(section), first(chamber), first(bill), F.regexp_replace(F.lower(citation), "[^a-z0-9]+", "")))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), " +|\t+"), lambda w: w != "")


def clean_street(address: Column) -> Column:
    """A street as a geocoder takes it, word by word.

    Of two addresses between which a slash stands the first; of a range of house
    numbers its first; ordinals without leading zeros, AV as AVE, no dots at the
    ends of words, single blanks.
    """
    words = _words(F.substring_index(address, "/", 1))
    head, second, third = (F.get(words, F.lit(i)) for i in range(3))
    whole = lambda w: F.coalesce(w.try_cast("double").isNotNull(), F.lit(False))
    low, high = F.substring_index(head, "-", 1), F.substring_index(head, "-", -1)
    joined = head.contains("-") & whole(low) & whole(high) & (F.size(words) > 1)
    apart = whole(head) & (second == "-") & whole(third) & (F.size(words) > 3)
    number = F.substring_index(low, ".", 1)
    words = F.when(joined, F.concat(F.array(number), F.slice(words, F.lit(2), F.size(words)))).when(apart, F.concat(F.array(F.substring_index(head, ".", 1)), F.slice(words, F.lit(4), F.size(words)))).otherwise(words)

    def tidy(word: Column) -> Column:
        bare = F.when(word.endswith("."), F.substring(word, F.lit(1), F.char_length(word) - 1)).otherwise(word)
        ordinal = F.upper(F.right(bare, F.lit(2))).isin("ST", "ND", "RD", "TH") & whole(F.substring(bare, F.lit(1), F.char_length(bare) - 2))
        return F.when(bare == "AV", "AVE").when(ordinal, F.ltrim(bare, F.lit("0"))).otherwise(bare)

    return F.array_join(F.transform(words, tidy), " ")


def house_numbers(address: Column) -> Column:
    """``(low, high)`` of the leading house numbers, two where a dash or an ampersand joins them; both null where there is none."""
    sides = F.split(address, "[-&]", 2)
    number = lambda side: F.nullif(F.regexp_extract(F.trim(side), "^[0-9]{1,9}", 0), F.lit("")).cast("int")
    first = number(F.get(sides, F.lit(0)))
    alone = F.trim(F.get(sides, F.lit(0))).rlike(r"^[0-9]+[A-Za-z]?(?:\.[0-9]+)?$")
    second = F.when(alone, number(F.get(sides, F.lit(1))))
    return F.struct(F.least(first, second).alias("low"), F.greatest(first, second).alias("high"))


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.split(F.trim(F.lower(name)), r"\s+"), lambda w: F.substring(w, 1, 1)), "")


def squashed(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def units_described(text: Column) -> Column:
    """``(low, high)`` units of a use description; the first form that fits decides, an open end is null.

    ``N units or less``, ``N units or more`` (or ``N+ units``), ``A to B units``, ``N units``, single family, duplex.
    """
    lower = F.lower(text)
    number = lambda pattern, group=1: F.nullif(F.regexp_extract(lower, pattern, group), F.lit("")).cast("int")
    less, more = number(r"\b([0-9]+) units? or less"), F.coalesce(number(r"\b([0-9]+) units? or more"), number(r"\b([0-9]+)\+ units?"))
    low, high = number(r"\b([0-9]+) (?:to|-) ([0-9]+) units?"), number(r"\b([0-9]+) (?:to|-) ([0-9]+) units?", 2)
    exact = F.coalesce(number(r"\b([0-9]+) units?\b"), F.when(lower.contains("single family"), 1), F.when(lower.contains("duplex"), 2))
    pair = lambda a, b: F.struct(a.cast("int").alias("low"), b.cast("int").alias("high"))
    nothing = F.lit(None)
    return F.when(less.isNotNull(), pair(nothing, less)).when(more.isNotNull(), pair(more, nothing)).when(low.isNotNull(), pair(F.least(low, high), F.greatest(low, high))).otherwise(pair(exact, exact))
