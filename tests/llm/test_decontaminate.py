import random
import re

import duckdb
from pyspark.sql import functions as F

from ruleloom.llm.decontaminate import contaminated
from ruleloom.llm.registry import ORACLE_SQL, QUERIES


def _brute(docs, items):
    def grams(text, k):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return len(w), {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}

    out = []
    for d, text in docs:
        for i, item in items:
            n, own = grams(item, 5)
            k = min(n, 5)
            has = grams(text, k)[1] if k else set()
            if own and len(own & has) >= 0.8 * len(own):
                out.append((d, i, len(own), len(own & has)))
    return sorted(out, key=str)


def test_against_brute_force_with_near_copies_and_short_items(spark):
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 6))) for _ in range(300)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(r.choice([1, 3, 4, 5, 6, 15, 40, 300])))) for k in range(40)] + [(98, None), (99, " .,! "), (None, "one two three four five six")]
    docs = [(0, None), (1, ""), (None, "x ONE two, three four-five six y"), (7, items[3][1]), (7, items[3][1])]
    for k in range(60):
        words = say(r.choice([3, 50, 400, 3000]))
        for _ in range(r.randrange(3)):
            passage = (items[r.randrange(40)][1]).split()
            if len(passage) > 30 and r.random() < 0.5:
                passage[r.randrange(len(passage))] = "changed"
            at = r.randrange(len(words))
            words[at:at] = passage
        docs.append((100 + k, " ".join(words).title()))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("item", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = sorted((tuple(x) for x in contaminated(df, bench).collect()), key=str)
    assert got == _brute(docs, items)
    assert len(got) > 30
    assert contaminated(df.limit(0), bench).count() == 0
    assert contaminated(df, bench.limit(0)).count() == 0


def test_items_in_several_blocks_give_the_same(spark, sf_dir, monkeypatch):
    import ruleloom.llm.decontaminate as m

    whole = sorted(map(tuple, QUERIES["op7_decontamination"](spark, sf_dir).collect()))
    monkeypatch.setattr(m, "ITEMS_PER_BLOCK", 7)
    assert sorted(map(tuple, QUERIES["op7_decontamination"](spark, sf_dir).collect())) == whole


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = sorted(con.sql("SELECT doc_id, item_id, n_shingles, n_shared FROM (" + ORACLE_SQL["op7_decontamination"] + ")").fetchall())
    assert sorted(map(tuple, QUERIES["op7_decontamination"](spark, sf_dir).collect())) == want
    assert want
