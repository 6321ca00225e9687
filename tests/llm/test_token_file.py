import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from ruleloom.llm.registry import QUERIES, tokenizer
from ruleloom.llm.storage import fresh_path
from ruleloom.llm.token_file import decode_file, digests, encode_file, pack, read_token_files, unpack, write_token_files

PATH = tokenizer("word_bpe_49k.json")


def test_pack_round_trip_at_every_length():
    r = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (r.integers(0, 2**32, n, dtype=np.uint64) >> r.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = pack(values)
        assert len(control) == -(-n // 4)
        assert unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n).tolist() == values.tolist()


def test_file_round_trip_and_common_ids_take_one_byte():
    parts = [np.array([7, 40_000, 7, 7], np.uint32), np.zeros(0, np.uint32), np.array([2], np.uint32)]
    raw = encode_file([5, None, -1], parts)
    docs, begins, ids = decode_file(raw)
    assert (docs, begins.tolist(), ids.tolist()) == ([5, None, -1], [0, 4, 4, 5], [7, 40_000, 7, 7, 2])
    assert len(decode_file(encode_file([], []))[2]) == 0


def _want(rows):
    from tokenizers import Tokenizer

    library, at, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def test_order_nulls_repeats_and_extra_columns(spark):
    rows = [(9, "b c"), (3, None), (None, "first"), (4, "same text"), (4, "same text"), (10, "<|endoftext|> x" + " long" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("ids", F.lit(1))
    got = digests(read_token_files(write_token_files(df, fresh_path(spark, "t"), PATH, 2))).orderBy("start").collect()
    assert [tuple(r) for r in got] == _want(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert digests(read_token_files(write_token_files(df.limit(0), fresh_path(spark, "t"), PATH, 2))).count() == 0


def test_query_against_the_library_on_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    assert [tuple(r) for r in QUERIES["op8_token_files"](spark, sf_dir).orderBy("doc_id").collect()] == _want([(r.doc_id, r.text) for r in rows])
