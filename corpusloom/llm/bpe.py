"""Byte-level BPE encoding and decoding.

A text is cut into pieces that no token crosses; each distinct piece is split by the pre-tokenizer's pattern
and merged with a priority queue of merge ranks over a doubly linked list of symbols: an entry whose symbols
have changed since it was queued is stale and skipped. Ids of short words are kept in a bounded cache of each
Python worker. Decoding concatenates the vocabulary's byte strings.

Nothing is shuffled: every text is encoded where it is read, whole, whatever its length (the queue makes a
run of n symbols cost n log n).

Defined cases: a null text is encoded as the empty text, which has no tokens; the literal text of an added
token (such as <|endoftext|>) becomes that token; repeated rows stay; further columns are passed on, and new
columns get underscores appended until their names are free.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import fresh, read_table

#: The published byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern sees it (the Unicode property White_Space).
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space before anything but white space always begins a token.
_CUT = re.compile(f" (?=[^{_BLANK}])")
#: A space that doesn't: the text has to be cut with care.
_GAP = re.compile(f" (?:[{_BLANK}]|$)")
#: Words that a worker remembers, in two halves of which the older one goes when the younger one is full.
CACHE = 350_000
CACHED_CHARS = 48
#: Words of Latin letters alone, and such words before one mark, are one or two pre-tokens.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)").fullmatch


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of every byte: itself where it prints, else the next free code point from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = (chr(256 + i) for i in range(256))
    return {b: chr(b) if b in plain else next(spare) for b in range(256)}


def merge_symbols(symbols: list[int], ranks: list[dict[int, int]], made: list[int]) -> list[int]:
    """symbols after all merges, lowest rank first and leftmost among equals.

    ranks: for each left symbol, right symbol -> rank; made: rank -> the new symbol. A queue entry is the rank and
    the place where its pair begins; it is stale when another pair, or none, begins there by now.
    """
    n = len(symbols)
    now = [ranks[a].get(b, -1) for a, b in zip(symbols, symbols[1:])]  # rank of the pair that begins here
    bits = n.bit_length()  # entries of short words fit a machine word
    queue = [rank << bits | i for i, rank in enumerate(now) if rank >= 0]
    if not queue:
        return symbols
    now.append(-1)
    heapify(queue)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    place = (1 << bits) - 1
    while queue:
        entry = heappop(queue)
        i = entry & place
        rank = entry >> bits
        if now[i] != rank:
            continue  # stale
        new = symbols[i] = made[rank]
        j = after[i]
        symbols[j] = now[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = now[i] = ranks[new].get(symbols[k], -1)
            if rank >= 0:
                heappush(queue, rank << bits | i)
        else:
            now[i] = -1
        h = before[i]
        if h >= 0:
            rank = now[h] = ranks[symbols[h]].get(new, -1)
            if rank >= 0:
                heappush(queue, rank << bits | h)
    return [s for s in symbols if s >= 0]


class _Cache:
    """A bounded memo of short texts: when the young half is full it becomes the old one, which is dropped next."""

    def __init__(self, make, room: int):
        self._make, self._room = make, max(1, room // 2)
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def get(self, text: str) -> bytes:
        found = self._young.get(text)
        if found is None:
            found = self._old.get(text)
            if found is None:
                found = self._make(text)
            if len(text) <= CACHED_CHARS:
                if len(self._young) >= self._room:
                    self._old, self._young = self._young, {}
                self._young[text] = found
        return found

    def all(self, texts: list[str]) -> list[bytes]:
        found = list(map(self._young.get, texts))
        if None in found:
            found = [self.get(t) if x is None else x for t, x in zip(texts, found)]
        return found


class ByteBpe:
    """A tokenizer read from a public tokenizers JSON file of the byte-level kind."""

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = _byte_chars()
        back = {c: b for b, c in chars.items()}
        size = max(vocab.values()) + 1
        self.ranks: list[dict[int, int]] = [{} for _ in range(size)]
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left]][vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.of_byte = [vocab[chars[b]] for b in range(256)]
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.strings = [b""] * size
        for text, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in text)
        for text, i in self.added.items():
            self.strings[i] = text.encode()
        self._split = regex.compile(PATTERN).findall
        self._added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self._pieces, self._tokens = _Cache(self._piece, cache), _Cache(self._token, cache // 8)

    def _token(self, text: str) -> bytes:
        """The ids of one pre-token as bytes of int32."""
        of_byte = self.of_byte
        return array("i", merge_symbols([of_byte[b] for b in text.encode("utf-8", "replace")], self.ranks, self.made)).tobytes()

    def _piece(self, word: str) -> bytes:
        """The ids of a space and a word after it."""
        plain = _PLAIN(word)
        if not plain:
            return b"".join(map(self._tokens.get, self._split(" " + word)))
        letters, mark = plain.groups()
        return self._pieces.get(letters) + self._tokens.get(mark) if mark else self._token(" " + letters)

    def _plain(self, text: str, out: list[bytes]) -> None:
        words = _CUT.split(text) if _GAP.search(text) else text.split(" ")
        if words[0]:
            out.extend(map(self._tokens.get, self._split(words[0])))
        out.extend(self._pieces.all(words[1:]))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text, int32."""
        out: list[bytes] = []
        if text:
            for k, part in enumerate(self._added.split(text) if self._added else [text]):
                if k % 2:
                    out.append(array("i", [self.added[part]]).tobytes())
                elif part:
                    self._plain(part, out)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """One tokenizer for each file and Python worker."""
    return ByteBpe(path)


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _id_lists(bpe: ByteBpe, texts: pa.Array) -> pa.ListArray:
    found = [bpe.encode(t.as_py()) for t in texts]
    ends = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))


def _freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what Arrow holds for further ones is given back at a task's end, as the worker goes on to other stages."""
    yield from batches
    pa.default_memory_pool().release_unused()


def _decoded(bpe: ByteBpe, lists: pa.ListArray) -> pa.Array:
    return pa.array([bpe.decode(x.values.to_numpy().tolist()) if x.is_valid else "" for x in lists], pa.string())


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """docs with one more column, the array<int> of each text's ids. path: the vocabulary's file, on every executor."""
    path = path or _default_path()
    (ids_col,) = fresh(docs, ids_col)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for whole in _freed(batches):
            for batch in _slices(whole, 1000):
                yield pa.RecordBatch.from_arrays([*batch.columns, _id_lists(bpe, batch.column(at))], names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None, text_col: str = "decoded") -> DataFrame:
    """rows with one more column, the text of each array of ids; null ids give an empty text."""
    path = path or _default_path()
    (text_col,) = fresh(rows, text_col)
    at = rows.columns.index(ids_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType(), False)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in _freed(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(bpe, batch.column(at))], names)

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, text_col: str = "text", path: str | None = None, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """docs with the ids in the text's place and, decoded from them, a text: decode(encode(docs)) in one Python worker a task."""
    path = path or _default_path()
    at = docs.columns.index(text_col)
    rest = docs.drop(text_col)
    ids_col, decoded_col = fresh(rest, ids_col, decoded_col)
    more = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded_col, T.StringType(), False)]
    schema = T.StructType([*rest.schema.fields, *more])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for whole in _freed(batches):
            for batch in _slices(whole, 1000):
                lists = _id_lists(bpe, batch.column(at))
                kept = [c for i, c in enumerate(batch.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*kept, lists, _decoded(bpe, lists)], names)

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = round_trip(docs)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
