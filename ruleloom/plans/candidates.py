"""Queries over candidate rules, each checked against the document it quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as cd
from ..sources.readers import table
from .catalogue import query

_K = "doc_id"
#: A candidate a document: its quote, date phrase, anchor and numbers stand anywhere in the text, or not at all.
_FIELDS = {
    "q": "CASE WHEN doc_id % 7 = 6 THEN substr(text, begin + 1, 50) || 'zz!!zz' ELSE substr(text, begin + 1, 60) END",
    "phrase": "CASE doc_id % 4 WHEN 0 THEN substr(text, again + 1, 30) WHEN 1 THEN 'as no text here says it' WHEN 2 THEN '' END",
    "anchor": "CASE doc_id % 5 WHEN 0 THEN 'not an anchor of this text' WHEN 1 THEN substr(text, 1, 25) END",
}


def _candidates(spark, sf):
    docs = table(spark, sf, "documents").withColumn("begin", (F.col(_K) * 7919 % F.greatest(F.length("text") - 60, F.lit(1))).cast("int")).withColumn("again", (F.col(_K) * 104729 % F.greatest(F.length("text") - 30, F.lit(1))).cast("int"))
    k, place = F.col(_K), F.when(F.col(_K) % 11 == 0, "Nowhere").when(F.col(_K) % 3 == 0, "Paris, FR").when(F.col(_K) % 3 == 1, "FR").otherwise("Lyon, FR")
    return docs.select(
        k.alias("candidate_id"), k, place.alias("jurisdiction"), F.when(k % 13 == 0, "state").when(k % 3 == 1, "state").otherwise("city").alias("level"), F.lit("Title").alias("title"), F.when(k % 17 != 0, "Sec. 1").alias("citation"), F.lit("enacted").alias("status_hint"),
        F.expr(_FIELDS["q"]).alias("quoted_span"), F.nullif(F.expr(_FIELDS["phrase"]), F.lit("")).alias("effective_date_phrase"), F.expr(_FIELDS["anchor"]).alias("effective_date_anchor"),
        F.concat(F.lit("pay "), k % 40, F.lit(" or two")).alias("requirement"), F.when(k % 2 == 0, F.concat((k % 30).cast("string"), F.lit("%"))).alias("key_value"), F.lit(None).cast("string").alias("coverage_text"),
        F.concat(F.lit("up to "), k % 9).alias("exemptions"), F.lit("").alias("penalty"), F.array((k % 25).cast("string")).alias("predicate_numbers"),
    )


def _docs(spark, sf):
    return table(spark, sf, "documents").select(_K, "text", F.lit(0).alias("body_offset"), F.when(F.col(_K) % 2 == 0, "Paris, FR").otherwise("FR").alias("jurisdiction"))


_WORDS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "fifteen": "15", "twenty": "20", "thirty": "30", "sixty": "60", "ninety": "90", "half": "0.5"}
_map = "MAP {" + ", ".join(f"'{w}': '{n}'" for w, n in _WORDS.items()) + "}"
_numbers = lambda x: f"list_concat(list_concat([replace(n, ',', '') FOR n IN regexp_extract_all({x}, '[0-9][0-9,]*(?:\\.[0-9]+)?')], [{_map}[w] FOR w IN string_split_regex(lower({x}), '[^a-z]+') IF {_map}[w] IS NOT NULL]), CASE WHEN regexp_matches(lower({x}), '\\bone and (?:one-half|a half)\\b') THEN ['1.5'] ELSE [] END)"
_bad = lambda claimed, known, said: f"CASE WHEN len([n FOR n IN {claimed} IF NOT list_contains({known}, n)]) > 0 THEN '{said}: ' || array_to_string([n FOR n IN {claimed} IF NOT list_contains({known}, n)], ', ') END"
_strip = lambda x: f"regexp_replace({x}, '^[\\s\\x0b\\p{{Z}}\\x{{85}}]+|[\\s\\x0b\\p{{Z}}\\x{{85}}]+$', '', 'g')"
SQL_CHECKS = f"""WITH c AS (SELECT doc_id, text, (doc_id * 7919) % greatest(length(text) - 60, 1) AS begin, (doc_id * 104729) % greatest(length(text) - 30, 1) AS again FROM documents),
raw AS (SELECT *, {_strip(_FIELDS['q'])} AS q, nullif({_FIELDS['phrase']}, '') AS raw_phrase, trim({_FIELDS['anchor']}) AS anchor,
    CASE WHEN doc_id % 11 = 0 THEN 'Nowhere' WHEN doc_id % 3 = 0 THEN 'Paris, FR' WHEN doc_id % 3 = 1 THEN 'FR' ELSE 'Lyon, FR' END AS place, CASE WHEN doc_id % 2 = 0 THEN 'Paris, FR' ELSE 'FR' END AS own FROM c),
gated AS (SELECT *, trim(raw_phrase) AS phrase, CASE WHEN text IS NULL THEN 'document without text' WHEN place = 'Nowhere' THEN 'unknown jurisdiction' WHEN (CASE WHEN doc_id % 13 = 0 OR doc_id % 3 = 1 THEN 'state' ELSE 'city' END) <> (CASE WHEN contains(place, ', ') THEN 'city' ELSE 'state' END) THEN 'level is not the jurisdiction''s'
    WHEN doc_id % 17 = 0 THEN 'missing citation' WHEN trim(q) = '' THEN 'missing quoted_span' WHEN length(q) < 20 OR instr(text, q) = 0 THEN 'quote not in its document' END AS reject, instr(text, q) - 1 AS s FROM raw),
spans AS (SELECT *, s + length(q) AS e, CASE WHEN length({_strip('phrase')}) >= 20 THEN nullif(instr(text, {_strip('phrase')}), 0) - 1 END AS p, length({_strip('phrase')}) AS pl, nullif(instr(text, phrase), 0) - 1 AS bare FROM gated),
marks AS (SELECT *, CASE WHEN p IS NOT NULL THEN p < e + 1000 AND p + pl > s - 1000 WHEN bare IS NOT NULL THEN abs(bare - s) < 1000 + e - s END AS near, substr(text, greatest(0, s - 1500) + 1, e + 1500 - greatest(0, s - 1500)) AS win FROM spans),
known AS (SELECT *, {_numbers('win')} AS around, {_numbers('text')} AS every FROM marks WHERE reject IS NULL)
SELECT doc_id AS candidate_id, reject, NULL AS start, NULL AS "end", NULL AS match, NULL AS reasons, NULL AS notes FROM marks WHERE reject IS NOT NULL UNION ALL
SELECT doc_id, reject, s, e, 'exact', array_to_string([x FOR x IN [CASE WHEN phrase IS NOT NULL AND near IS NULL THEN 'date phrase not in the document' END, CASE WHEN NOT near AND length(text) > 24000 THEN 'date phrase far from the quote' END,
    CASE WHEN anchor IS NOT NULL AND NOT contains(text, anchor) THEN 'date anchor not in the document' END, {_bad("list_distinct([CAST(doc_id % 40 AS VARCHAR), '2'])", 'around', 'requirement: numbers not near the quote').replace("list_distinct([CAST(doc_id % 40 AS VARCHAR), '2'])", "(CASE WHEN doc_id % 40 = 2 THEN ['2'] ELSE [CAST(doc_id % 40 AS VARCHAR), '2'] END)")},
    CASE WHEN doc_id % 2 = 0 THEN {_bad("[CAST(doc_id % 30 AS VARCHAR)]", 'around', 'key_value: numbers not near the quote')} END, {_bad("[CAST(doc_id % 9 AS VARCHAR)]", 'every', 'exemptions: numbers not in the document')},
    {_bad("[CAST(doc_id % 25 AS VARCHAR)]", 'every', 'conditions: numbers not in the document')}, CASE WHEN place <> own AND place <> 'FR' THEN 'jurisdiction is not the document''s' END] IF x IS NOT NULL], '|'),
    array_to_string([x FOR x IN [CASE WHEN NOT near AND length(text) <= 24000 THEN 'date phrase far from the quote' END, CASE WHEN place <> own AND place = 'FR' THEN 'state rule from a city''s document' END] IF x IS NOT NULL], '|') FROM known"""


@query(SQL_CHECKS)
def candidate_checks(spark, sf):
    """A candidate a document through all gates and soft checks; quotes and dates from anywhere in the whole text."""
    places = spark.createDataFrame([("Paris, FR",), ("Lyon, FR",), ("FR",)], "jurisdiction string")
    found = cd.checked(_candidates(spark, sf), _docs(spark, sf), places)
    return found.select("candidate_id", "reject", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "match", F.array_join("reasons", "|").alias("reasons"), F.array_join("notes", "|").alias("notes"))
