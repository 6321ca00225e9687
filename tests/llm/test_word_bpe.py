import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from ruleloom.llm.registry import QUERIES, tokenizer
from ruleloom.llm.token_file import LibraryEncoder
from ruleloom.llm.word_bpe import TrieEncoder, digests, encode_decode

PATH = tokenizer("word_bpe_49k.json")
LETTERS = "abcdefghijklmnopqrstuvwxyzäéñüßœ'’.,!?$%&*0123456789² \t\n\x1c\x85\xa0ΣσςİÉÇ日本語😀́ <|>"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def _texts():
    r = random.Random(5)
    texts = ["".join(r.choice(LETTERS) for _ in range(r.randrange(0, 80))) for _ in range(3000)]
    return [*texts, "", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>'s", "ab" * 20_000 + " c", "don't SHE'LL it's", "½ Ⅷ ٣ ﬁ"]


def test_same_ids_and_text_as_the_library(library):
    coder, texts = TrieEncoder(PATH), _texts()
    for text, ids in zip(texts, coder.encode_texts(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, text[:80]
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_any_characters_get_the_ids_of_the_library_on_the_whole_text(library):
    """Control characters, unassigned ones and those newer than Python's tables too; op8's encoder beside op9's."""
    r = random.Random(11)
    every = [*range(0xD800), *range(0xE000, 0x110000)]
    ranges = [range(128), range(0x3000), every]
    texts = ["".join(chr(r.choice(ranges[k % 3])) for _ in range(r.randrange(12))) for k in range(20_000)]
    texts += [f"!{chr(i)}! a{chr(i)}b 1{chr(i)}" for i in [*range(0x3000), *r.sample(every, 20_000)]]
    coders = [TrieEncoder(PATH), LibraryEncoder(PATH)]
    for at in range(0, len(texts), 5000):
        some = texts[at : at + 5000]
        want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
        for coder in coders:
            assert coder.encode_texts(some) == want


def test_memory_keeps_what_is_met_again_and_forgets_long_words(monkeypatch):
    for name in ("word_bpe.REMEMBERED", "token_file.KEPT_WORDS", "token_file.KEPT_CHUNKS"):
        monkeypatch.setattr(f"ruleloom.llm.{name}", 3)
    coder = LibraryEncoder(PATH)
    once = coder.encode_texts(["same " + "x" * 300])
    for k in range(20):
        assert coder.encode_texts([f"same w{k} v{k}", "same " + "x" * 300])[1] == once[0]
    assert len(coder.chunks.young) + len(coder.chunks.old) <= 10
    assert "same" in {**coder.chunks.young, **coder.chunks.old}
    assert not any(len(w) > 200 for m in (coder.chunks, coder.words) for w in (*m.young, *m.old))


def test_trie_agrees_with_merging_by_definition():
    coder, r = TrieEncoder(PATH), random.Random(7)
    words = {"".join(r.choice("theringstoa") for _ in range(r.randrange(1, 12))) for _ in range(3000)}
    for word, ids in coder.encode_words(words).items():
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == coder.merged(word[:-1] + chr(ord(word[-1]) + 0x20000)), word


def test_nulls_repeats_extra_columns_and_empty_tables(spark, library):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, None, None), (2, None, None), (3, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("ids", F.lit("z")).withColumn("decoded", F.lit(1))
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in digests(encode_decode(df, PATH)).collect()), key=str)
    ids = library.encode("Hello world", add_special_tokens=False).ids
    full, none = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(b"").hexdigest()
    assert got == sorted([(1, len(ids), full), (1, len(ids), full), (None, 0, none), (2, 0, none), (3, 0, none)], key=str)
    assert digests(encode_decode(df.limit(0), PATH)).count() == 0


def test_query_against_the_library_on_whole_table(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op9_bpe_round_trip"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
