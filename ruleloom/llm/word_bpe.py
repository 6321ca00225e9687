"""Encoding and decoding with a word-level BPE whose last symbol carries an end-of-word mark.

A text is cut at white space into chunks and a chunk into words; only words not
met before are encoded.  Distinct words are inserted into a trie and the trie is
walked depth first.  Each node keeps one thing, the last token of the encoding of
its prefix: for a prefix ``p`` that is the token ``t``, ``p = q + t``, whose pair
with the last token of ``q`` is left alone by the merge rules.  A prefix that many
words share is therefore encoded once, and a word's ids are read off the back
pointers.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .worker import kept

END_OF_WORD = "</w>"  # fixed value of the tokenizer's file format

#: Words (and chunks) that a Python worker remembers between batches, twice over: see Memory.
REMEMBERED = 100_000
#: Characters of a chunk, beyond which it is forgotten after its batch.
LONG = 200
#: Bytes of output after which a record batch is handed to Spark.
BATCH_BYTES = 4 << 20

_final = 0x20000  # added to a character's number where it ends a word
SETTLED = "\u0180"  # characters before it are their own normal form, with classes and lower case that no version changed
# The tokenizer's own pattern over a text whose other characters stand as "a", "1", "!" or " " by their class.
_words = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\\sA-Za-z0-9]+", re.ASCII)
_numbers = "0-9²³¹¼-¾"
_letters = "".join(chr(k) for k in range(ord(SETTLED)) if chr(k).isalpha())
settled_words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_letters}]+|[{_numbers}]|[^\\s{_letters}{_numbers}]+", re.ASCII)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Memory:
    """What was found for keys met before, in two generations: keys met again since the last turn live on."""

    def __init__(self, most: int | None = None) -> None:
        self.most = REMEMBERED if most is None else most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> set[str]:
        """Those of ``keys`` that have to be found; the others are in ``young`` from now on."""
        new = keys.difference(self.young)
        if again := new.intersection(self.old):
            self.young.update((k, self.old[k]) for k in again)
            new -= again
        return new

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


class _Classes(dict):
    """For ``str.translate``: what stands for a character in :data:`_words`, asked of the library once a character."""

    def __init__(self, library):
        super().__init__({k: chr(k) for k in range(128)})
        self.pieces = lambda text: len(library.pre_tokenizer.pre_tokenize_str(text))

    def __missing__(self, number: int) -> str:
        if 0xD800 <= number < 0xE000:
            return "!"
        c = chr(number)
        if self.pieces(c) == 0:
            stands = " "
        elif self.pieces("a" + c) == 1:
            stands = "a"
        else:
            stands = "!" if self.pieces("!" + c) == 1 else "1"
        self[number] = stands
        return stands


def library_of(path: str):
    """The tokenizers library's own tokenizer from its file, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


class WordSplitter:
    """A chunk's words, as the library normalises it and cuts it, at white space too; added tokens stay whole.

    What depends on a version of Unicode is asked of the library: it normalises
    every chunk with a character beyond U+017F, and tells each character's class.
    """

    def __init__(self, library, added: Iterable[str]):
        self.added = frozenset(added)
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if self.added else None
        self.normal = library.normalizer.normalize_str
        self.classes = _Classes(library)

    def _cut(self, text: str) -> list[str]:
        if text.isascii():
            return _words.findall(text)
        return [text[m.start() : m.end()] for m in _words.finditer(text.translate(self.classes))]

    def __call__(self, chunk: str) -> list[str]:
        whole = chunk.lower()
        if whole.isascii() or max(whole) < SETTLED:
            if whole.isalpha():
                return [whole]
            if whole[:-1].isalpha() and not whole[-1].isspace():  # most other chunks: letters and one sign
                return [whole[:-1], whole[-1]]
        if self.split_added and "<" in chunk:
            parts = self.split_added.split(chunk)
        else:
            parts = [chunk]
        out: list[str] = []
        for part in parts:
            if part in self.added:
                out.append(part)
            elif part:
                out += self._cut(part.lower() if max(part) < SETTLED else self.normal(part))
        return out


class TrieEncoder:
    """Word-level BPE from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token_text = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for text, i in [*vocab.items(), *added.items()]:
            self.token_text[i] = text
        self.added = added
        self.split = WordSplitter(library_of(path), added)
        self.byte_chars = byte_characters()
        self.ids = {self._symbols(text): i for text, i in vocab.items()}
        self.longest = max(map(len, self.ids))
        text_of = {i: s for s, i in self.ids.items()}
        self.pieces = text_of
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            left, right = vocab[a], vocab[b]
            self.merges[left, right] = (rank, self.ids[text_of[left] + text_of[right]])
        self._fits: dict[tuple[int, int], bool] = {}
        self.words, self.chunks = Memory(), Memory()

    @staticmethod
    def _symbols(token: str) -> str:
        """One character a symbol; the last of a word is moved up by ``_final``."""
        if token.endswith(END_OF_WORD) and len(token) > len(END_OF_WORD):
            body = token[: -len(END_OF_WORD)]
            return body[:-1] + chr(ord(body[-1]) + _final)
        return token

    def merged(self, symbols: str) -> list[int]:
        """BPE by its definition: the lowest-ranked adjacent pair, leftmost first, until none is left."""
        ids = [self.ids[s] for s in symbols]
        while len(ids) > 1:
            found = [(m[0], i, m[1]) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (m := self.merges.get(pair))]
            if not found:
                break
            _, i, new = min(found)
            ids[i : i + 2] = [new]
        return ids

    def fits(self, before: int, token: int) -> bool:
        """Whether the rules leave ``before`` and ``token`` side by side; ``before`` -1: whether they make ``token`` at all."""
        key = (before, token)
        if (known := self._fits.get(key)) is None:
            if before < 0:
                known = self.merged(self.pieces[token]) == [token]
            else:
                known = self.merged(self.pieces[before] + self.pieces[token]) == [before, token]
            self._fits[key] = known
        return known

    def _last_token(self, path: str, at: int, last: list[int]) -> int:
        """The last token of ``path[:at]``, given those of all shorter prefixes."""
        ids, fits = self.ids, self.fits
        for length in range(min(at, self.longest), 0, -1):
            token = ids.get(path[at - length : at])
            if token is not None and fits(-1, token):
                start = at - length
                if start == 0 or fits(last[start], token):
                    return token
        raise ValueError(f"no token ends {path[:at]!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct words, from one depth-first walk of their trie.

        Sorted words are the trie's leaves in preorder, so the walk's stack is the
        current word's path; ``last`` holds the state of each node on it.
        """
        chars = self.byte_chars
        paths = sorted(("".join([chars[b] for b in w.encode("utf-8")]), w) for w in words)
        out: dict[str, bytes] = {}
        if len(self._fits) > 8 * REMEMBERED:
            self._fits.clear()
        last: list[int] = [-1]
        before = ""
        for path, word in paths:
            inner = path[:-1]
            shared, most = 0, min(len(inner), len(before))
            while shared < most and inner[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for at in range(shared + 1, len(inner) + 1):
                last.append(self._last_token(inner, at, last))
            before = inner
            whole = inner + chr(ord(path[-1]) + _final)
            token, at, ids = self._last_token(whole, len(whole), last), len(whole), []
            while True:
                ids.append(token)
                at -= len(self.pieces[token])
                if at == 0:
                    break
                token = last[at]
            out[word] = array("I", reversed(ids)).tobytes()
        return out

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of each chunk, by its words; only words not met before are encoded."""
        return join_words(chunks, self.split, self.words, self.added, self.encode_words)

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [ids.tobytes() for ids in each_text(texts, self.chunks, self.learn)]

    def decode(self, ids: bytes) -> str:
        """As the library decodes where the file names no decoder: the tokens joined by a space."""
        return " ".join(map(self.token_text.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def join_words(chunks: Collection[str], split: WordSplitter, words: Memory, added: dict[str, int], encode: Callable[[set[str]], dict[str, bytes]]) -> dict[str, bytes]:
    """Ids of each chunk from those of its words; ``encode`` finds the words' that aren't remembered."""
    cut = [split(chunk) for chunk in chunks]
    met: set[str] = set()
    met.update(*cut)
    new = words.missing(met)
    special = {word: added[word].to_bytes(4, "little") for word in new if word in added}
    words.young |= special
    if new := new.difference(special):
        words.young |= encode(new)
    known = words.young
    out = {}
    for chunk, ws in zip(chunks, cut, strict=True):
        if len(ws) == 1:
            out[chunk] = known[ws[0]]
        elif len(ws) == 2:
            out[chunk] = known[ws[0]] + known[ws[1]]
        else:
            out[chunk] = b"".join([known[w] for w in ws])
    for word in [w for w in new if len(w) > LONG]:
        del known[word]
    words.turn()
    return out


def encode_by_chunks(column: pa.Array, chunks: Memory, learn: Callable[[set[str]], dict[str, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of a column's texts and where each text's begin, in runs of about BATCH_BYTES; ``learn`` finds those of chunks that aren't remembered.

    A chunk is a run without ASCII white space.  Arrow cuts a run's texts and numbers
    their distinct chunks, so Python handles each of them once a run, and the ids are
    gathered by number.  Between runs the memory takes its turn and long chunks are
    forgotten.  A null text has no ids.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, side="right")))
        lists = pc.ascii_split_whitespace(column.slice(at, end - at))
        numbered = lists.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist()
        if new := chunks.missing(set(distinct)):
            chunks.young |= learn(new)
        known = chunks.young
        raw = [known[c] for c in distinct]
        for c in new:
            if len(c) > LONG:
                del known[c]
        chunks.turn()
        ids, lengths = np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        begins, number = np.cumsum(lengths) - lengths, numbered.indices.to_numpy()
        many = lengths[number]
        ends = np.cumsum(many)
        places = np.repeat(begins[number] - ends + many, many)
        places += np.arange(len(places))
        offsets = lists.offsets.to_numpy()
        yield ids[places], np.concatenate([[0], ends])[offsets - offsets[0]]
        at = end


def each_text(column: pa.Array | list[str | None], chunks: Memory, learn: Callable[[set[str]], dict[str, bytes]]) -> Iterator[np.ndarray]:
    """The ids of one text after the other."""
    for ids, begins in encode_by_chunks(column if isinstance(column, pa.Array) else pa.array(column, pa.string()), chunks, learn):
        for k in range(len(begins) - 1):
            yield ids[begins[k] : begins[k + 1]]


def encoder_for(path: str) -> TrieEncoder:
    """One encoder a Python worker, kept between the tasks of a stage."""
    return kept(("trie", path), lambda: TrieEncoder(path))


def in_small_batches(rows: Iterable[tuple], schema: pa.Schema, weigh: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Record batches of at most about BATCH_BYTES."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(col, type=f.type) for col, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids binary, decoded string)`` of every row: its whole text encoded, and those ids decoded again.

    A null or empty text has no ids and decodes to the empty string; a null id is
    kept; repeated rows give repeated rows; other columns are not read.  There is
    no shuffle and no limit on a text's length: memory holds one Arrow batch, its
    distinct words and at most REMEMBERED words from before.
    """
    id_type = df.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_for(tokenizer_path)
        for batch in batches:
            schema = pa.schema([pa.field(id_col, batch.schema.field(0).type), pa.field("ids", pa.binary()), pa.field("decoded", pa.string())])

            def rows(batch=batch):
                for key, ids in zip(batch.column(0).to_pylist(), each_text(batch.column(1), coder.chunks, coder.learn), strict=True):
                    raw = ids.tobytes()
                    yield key, raw, coder.decode(raw)

            yield from in_small_batches(rows(), schema, lambda r: len(r[1]) + len(r[2]))

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, out)


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of :func:`encode_decode`'s rows."""
    return df.select(
        F.col(id_col),
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
