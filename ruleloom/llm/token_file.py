"""Token ids in binary files: frequency-ranked, byte-aligned variable-length, with separate control bytes.

File layout, all little-endian::

    8 bytes   magic RLTOK001
    4 x u64   documents D, ids N, distinct ids R, data bytes B
    R x u32   the id of each rank, most frequent first (ties: smaller id first)
    D x i64   document ids;  D x u8  1 where the document id is not null
    (D+1) x u64  where each document's ids begin
    ceil(N/4)    control bytes: two bits a value hold its length minus one, first value lowest
    B            data bytes: each rank in one to four bytes

Common ids have small ranks and so take one byte.  Control bytes lie apart from the
data, so a reader turns them into lengths by one table lookup and gathers all
values at once, with no branch per value.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written
from .word_bpe import END_OF_WORD, LONG, SETTLED, Memory, WordSplitter, byte_characters, each_text, in_small_batches, join_words, library_of, settled_words
from .worker import kept

MAGIC = b"RLTOK001"
#: Words and chunks that a Python worker remembers between batches, twice over.
KEPT_WORDS, KEPT_CHUNKS = 200_000, 600_000
#: Ids after which a task begins another file.
IDS_PER_FILE = 8_000_000
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = ranks.astype("<u4", copy=False)
    n = len(ranks)
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, dtype=np.uint8)
    padded[:n] = lengths - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    kept = np.arange(4, dtype=np.uint8)[None, :] < lengths[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values that :func:`pack` wrote, by table lookup."""
    lengths = LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    begins = ends - lengths
    values = data[begins].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        if len(longer) == 0:
            break
        values[longer] |= data[begins[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def encode_file(doc_ids: list[int | None], parts: list[np.ndarray]) -> bytes:
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    present = np.flatnonzero(counts)
    by_rank = present[np.lexsort((present, -counts[present]))]
    rank_of = np.zeros(len(counts), dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    control, data = pack(rank_of[ids]) if len(ids) else (b"", b"")
    begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("<u8")
    return b"".join([
        MAGIC, np.array([len(parts), len(ids), len(by_rank), len(data)], dtype="<u8").tobytes(), by_rank.astype("<u4").tobytes(),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(), np.array([d is not None for d in doc_ids], dtype=np.uint8).tobytes(),
        begins.tobytes(), control, data,
    ])


def decode_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, where their ids begin (and the end), and all ids."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, distinct, size = (int(x) for x in np.frombuffer(raw, "<u8", 4, 8))
    at = 40
    by_rank = np.frombuffer(raw, "<u4", distinct, at)
    doc_ids = np.frombuffer(raw, "<i8", docs, at := at + 4 * distinct)
    known = np.frombuffer(raw, np.uint8, docs, at := at + 8 * docs)
    begins = np.frombuffer(raw, "<u8", docs + 1, at := at + docs)
    control = np.frombuffer(raw, np.uint8, -(-n // 4), at := at + 8 * (docs + 1))
    data = np.frombuffer(raw, np.uint8, size, at + len(control))
    ids = by_rank[unpack(control, data, n)] if n else np.zeros(0, np.uint32)
    return [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], begins.astype(np.int64), ids


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class LibraryEncoder:
    """The tokenizers library's model on each word not met before.

    Most of the library's time on a whole text goes into normalising it anew, so a
    text is cut at ASCII white space, where no rule of the tokenizer reaches across.  New
    chunks are cut into words thousands at a time, in one string, apart by a word that
    no other text makes, so that the ids are cut again where that word's stands.  Chunks whose characters depend on a
    version of Unicode, or that hold an added token, are cut by the library's own
    classes instead.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        library = library_of(path)
        self.added = {x.content: i for i, x in library.get_added_tokens_decoder().items()}
        self.split, self.chars = WordSplitter(library, self.added), byte_characters()
        self.model = Tokenizer(library.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        vocabulary = library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(END_OF_WORD)]] = True
        self.words, self.mapped, self.chunks = Memory(), Memory(KEPT_WORDS), Memory(KEPT_CHUNKS)
        # the character that stands for a zero byte is a word that only a zero byte makes
        self.between, self.between_id = self.chars[0], vocabulary[self.chars[0] + END_OF_WORD]
        self.shown = {k: "".join([self.chars[b] for b in chr(k).encode()]) for k in range(ord(SETTLED)) if chr(k) not in " \n" and not (k < 128 and chr(k).isprintable())}

    def _encode_mapped(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words whose bytes are written as characters, one string for all; cut behind each token that ends a word."""
        ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        raw = ids.tobytes()
        return dict(zip(words, [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))

    def _encode_words(self, words: set[str]) -> dict[str, bytes]:
        mapped = {w: "".join([self.chars[b] for b in w.encode()]) for w in words}
        found = self._encode_mapped(list(mapped.values()))
        return {w: found[m] for w, m in mapped.items()}

    def _encode_settled(self, chunks: list[str]) -> dict[str, bytes]:
        line = settled_words.sub(r"\g<0> ", "\n".join(chunks).lower())
        if not (line.isascii() and line.replace("\n", "").isprintable()):
            line = line.translate(self.shown)
        words = (line.replace("\n", self.between + " ") + self.between).split(" ")
        known = self.mapped.young
        if new := self.mapped.missing(set(words)):
            known |= self._encode_mapped(list(new))
        raw = b"".join(map(known.__getitem__, words))
        ends = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == self.between_id)).tolist()
        self.mapped.turn()
        return dict(zip(chunks, [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends[:-1]]], ends, strict=True)], strict=True))

    def learn(self, new: set[str]) -> dict[str, bytes]:
        every = "\n".join(new)
        odd = ("<|", "\0", "İ", "\x85", "\xa0")
        other = set()
        if any(x in every for x in odd) or max(map(len, new)) > LONG:
            other = {c for c in new if len(c) > LONG or any(x in c for x in odd)}
        rest = [c for c in new if c not in other] if other else list(new)
        ascii_, wide = [c for c in rest if c.isascii()], [c for c in rest if not c.isascii()]
        latin = [c for c in wide if max(c) < SETTLED]
        other.update(set(wide).difference(latin))
        out = join_words(other, self.split, self.words, self.added, self._encode_words) if other else {}
        for some in (ascii_, latin):
            for at in range(0, len(some), 50_000):
                out |= self._encode_settled(some[at : at + 50_000])
        return out

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [ids.tobytes() for ids in each_text(texts, self.chunks, self.learn)]


def library_for(path: str) -> LibraryEncoder:
    """One encoder a Python worker, kept between the tasks of a stage."""
    return kept(("library", path), lambda: LibraryEncoder(path))


def write_token_files(df: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, appends ``end_id``, writes files in ascending id order; returns their manifest.

    Rows go to tasks by range of the id, so the files' order is the documents'.
    Null ids come first; rows of one id follow the hash of their text, and equal
    rows any order, which shows in no result; a hot id is split by those keys.  A
    null or empty text is just ``end_id``.  Other columns are not read.  A task
    whose executor is lost writes its files anew under other names; the manifest
    lists those of the attempts that counted.
    """
    ends = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_for(tokenizer_path)
        part = TaskContext.get().partitionId()
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = files = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, files
            system, base = _open(folder)
            system.create_dir(base, recursive=True)
            name = f"{part:06d}-{files:04d}-{uuid.uuid4().hex[:10]}.tok"
            with system.open_output_stream(f"{base}/{name}") as f:
                f.write(encode_file(doc_ids, held))
            row = pa.RecordBatch.from_pydict({"part": [part], "file": [files], "path": [f"{folder}/{name}"], "n_docs": [len(held)], "n_ids": [size]}, schema=manifest)
            files += 1
            doc_ids.clear()
            held.clear()
            size = 0
            return row

        manifest = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), each_text(batch.column(1), coder.chunks, coder.learn), strict=True):
                doc_ids.append(key)
                held.append(np.concatenate([ids, ends]))
                size += len(held[-1])
                if size >= IDS_PER_FILE:
                    yield flush()
        if held:
            yield flush()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("id", "hash", "row").sortWithinPartitions("id", "hash").select("id", "text")
    return written(ordered.mapInArrow(run, "part int, file int, path string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, start, ids binary)`` of every document in the files; ``start``: ids of all documents before it.

    The running total is over one row a file, which a single task can hold; the
    files themselves are read by as many tasks as there are files.
    """
    before = F.sum("n_ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(id_col, pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

        def rows():
            for batch in batches:
                for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    system, name = _open(path)
                    with system.open_input_stream(name) as f:
                        doc_ids, begins, ids = decode_file(f.read())
                    for k, doc in enumerate(doc_ids):
                        yield doc, start + int(begins[k]), ids[begins[k] : begins[k + 1]].astype("<u4").tobytes()

        yield from in_small_batches(rows(), schema, lambda r: len(r[2]) + 16)

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(spread, "path").mapInArrow(run, f"`{id_col}` long, start long, ids binary")


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of :func:`read_token_files`' rows."""
    return df.select(F.col(id_col), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
