import hashlib
import struct

import corpus_pipeline
from test_decontaminate import _brute as contained
from test_language_id import _brute as languages
from test_near_dedup import _classes
from test_pii import _base

from ruleloom.llm.registry import tokenizer


def _redacted(text):
    out, at = "", 0
    for s, _, e, kind in _base(text):
        if s >= at:
            out += text[at:s] + f"[{kind.upper()}]"
        at = max(at, e)
    return out + text[at:] if out else text


def _expected(docs, items):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    found = languages([(t, lang, source, None) for _, t, lang, source in docs])
    docs = [(i, t) for (i, t, _, _), (lang, p) in zip(docs, found, strict=True) if lang != "und" and p >= 0.5]
    docs = [d for d, (i, c) in zip(sorted(docs, key=lambda d: str((d[0], 0))), sorted(_classes(docs), key=str), strict=True) if i == c]
    leaks = {d for d, *_ in contained(docs, items)}
    out = []
    for i, text in docs:
        if i not in leaks:
            ids = library.encode(_redacted(text), add_special_tokens=False).ids
            out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out)


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == _expected(docs, items)
    assert 0 < len(got) < len(docs)


def test_stages_keep_the_columns_and_take_nulls_repeats_and_empty_tables(spark, sf_dir):
    text = "the of and that with is on " * 8
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text, None, None, None), (3, None, None, None, None), (None, text + " 4111111111111111 x y z", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3"]
    assert corpus_pipeline.decontaminate_benchmark(spark, docs, sf_dir).count() == 5
    assert [r.text for r in corpus_pipeline.redact_personal_data(spark, docs, sf_dir).where("doc_id IS NULL").collect()] == [text + " [CARD] x y z"]
