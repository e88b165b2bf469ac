"""Substring dedup by compact windows.

A text is the sequence of its word shingles (ASCII lower case). Under one hash function, a Cartesian tree over
the shingles' hashes has one node for each shingle, and node c with the nearest smaller hashes at l and r is a
compact window: every subsequence of l+1..r-1 that holds c has the min-hash of c. Only nodes that cover
LENGTH shingles matter, 2n / LENGTH of them, and the subsequences of that length they answer for are one
interval of starts. For each band the intervals of its hash functions are joined: an interval of starts that
share a whole signature becomes one row (signature, text, position). Equal signatures are candidates.

The first text of a signature leads it; every other is verified against the leader: at each offset that signatures
propose for the two texts, a subsequence of the one is compared with the subsequence of the other, and is a repeat
when the similarity of their sets of shingles is at least SIMILARITY. So a signature that thousands of texts share costs one
comparison for each, not all pairs. Starts that share a signature but that its leader doesn't explain are led anew,
by the first text among them, in ROUNDS rounds. What is open then meets every earlier row of its signature: rows carry the
shingles around their place, so that pairs are compared without their texts, a block of rows with a block of rows, and
each start is verified against the first text that has a similar passage there. A passage of LENGTH + SHINGLE - 1 words
that occurs twice word for word is therefore always found; one that is only similar is found when a band agrees (95 of
100 at a similarity of 0.8). Rows that share a signature and are alike nowhere are compared in all pairs: quadratic in such
a group by nature, in cells of bounded size that Spark deals out.

Defined cases: null texts are empty; texts shorter than a passage have no repeats; a passage that occurs twice in
one text only isn't a repeat; texts with equal content are repeats of the smallest id; when ids repeat or are
null, rows are told apart by their place in the order of ids (null first) and the result has a row for each; further
columns pass through remove_repeats(), each of whose rows is cut by its own repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, materialize, read_table, release

SHINGLE = 5
SIMILARITY = 0.8
#: Shingles of the shortest passage: 50 words.
LENGTH = 46
#: Hash functions of each band.
BANDS = ((0, 1), (2, 3), (4, 5))
#: Leaders that a signature tries before what is open meets all earlier rows.
ROUNDS = 3
#: Rows of a signature on each side of a cell of pairs, and pairs that are compared at once.
BLOCK, PAIRS = 512, 32_768
#: Places beside an offset at which shingles count as equal, and passages that are compared at once.
SHIFT, CHECKED = 2, 4096
#: Bytes of texts whose signatures are computed together, and texts of one batch.
PIECE, SLICE = 2_000_000, 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_POSITION = np.uint64((1 << 24) - 1)
_PLACES = np.random.default_rng(6).integers(1, 1 << 63, SHINGLE, np.uint64) | np.uint64(1)
_SEEDS = np.random.default_rng(60).integers(1, 1 << 63, 8, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as long as the longest buffer so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, word offset at which each text begins and the last ends)."""
    raw = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    space = _SPACE[raw]
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    up, down = _Powers.get(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    hashes = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    return hashes, np.searchsorted(starts, first)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out += words[k : k + n] * _PLACES[k]
    return _mix(out)


def window_minima(values: np.ndarray, length: int, most: int = 1 << 24) -> np.ndarray:
    """Positions that are the leftmost minimum of some window of this length.

    Positions are compared in the low 24 bits of the values, so more than 2**24 values are taken piece by piece.
    """
    if len(values) > most:
        step = most - length + 1
        parts = [window_minima(values[lo : lo + most], length, most) + lo for lo in range(0, len(values) - length + 1, step)]
        return np.unique(np.concatenate(parts))
    keyed = (values & ~_POSITION) | np.arange(len(values), dtype=np.uint64)
    width = 1
    while 2 * width <= length:
        keyed = np.minimum(keyed[:-width], keyed[width:])
        width *= 2
    if width < length:
        keyed = np.minimum(keyed[: len(keyed) - (length - width)], keyed[length - width :])
    at = (keyed & _POSITION).astype(np.int64)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def compact_windows(values: list[int], places: list[int]) -> tuple[list[int], list[int]]:
    """(l, r) of every node of the Cartesian tree: the places of the nearest smaller value before and after.

    Among equal values the leftmost is the smallest. Values that no long window has as its minimum may be
    left out: whatever bounds a long window is itself the minimum of a longer one.
    """
    n = len(values)
    left, right = [0] * n, [0] * n
    spine: list[int] = []
    for i in range(n):
        value = values[i]
        while spine and values[spine[-1]] > value:
            right[spine.pop()] = places[i]
        left[i] = places[spine[-1]] if spine else -1
        spine.append(i)
    end = places[-1] + 1 if places else 0
    for i in spine:
        right[i] = end
    return left, right


def signatures(texts: list[bytes], length: int = LENGTH, bands=BANDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, signature, packed position) of every interval of starts that shares a band's min-hashes.

    Packed: the place c of the first function's minimum in the text's shingles, then c - lo and c - hi, which
    are below 64, of the interval of starts.
    """
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    words, first = word_hashes(texts)
    shingles = shingle_hashes(words)
    count = np.maximum(first[1:] - first[:-1] - SHINGLE + 1, 0)  # shingles of each text
    long = np.flatnonzero(count >= length)
    if not len(long):
        return nothing
    # long texts' shingles one after the other, one gap of a smallest value between them
    base = np.cumsum(count[long] + 1) - (count[long] + 1)
    size = int(base[-1] + count[long][-1] + 1)
    owner = np.repeat(np.arange(len(long)), count[long] + 1)
    inner = np.arange(size) - base[owner]
    gap = inner == count[long][owner]
    line = shingles[np.where(gap, 0, np.minimum(first[long][owner] + inner, len(shingles) - 1))]
    last = base + count[long] - length  # the last start of each text
    functions = sorted({f for band in bands for f in band})
    found = {}
    for f in functions:
        values = np.where(gap, np.uint64(0), _mix(line ^ _SEEDS[f]) | (_POSITION + np.uint64(1)))
        at = window_minima(values, length) if size >= length else np.zeros(0, np.int64)
        at = np.union1d(at, np.flatnonzero(gap))
        keyed = (values[at] & ~_POSITION).tolist()
        places = at.tolist()
        left, right = (np.array(x, np.int64) for x in compact_windows(keyed, places))
        lo = np.maximum(np.maximum(left + 1, at - length + 1), base[owner[at]])
        hi = np.minimum(np.minimum(at, right - length), last[owner[at]])
        good = (lo <= hi) & ~gap[at]
        order = np.argsort(lo[good], kind="stable")
        found[f] = lo[good][order], hi[good][order], at[good][order], values[at[good][order]]
    texts_out, keys_out, packed_out = [], [], []
    for b, band in enumerate(bands):
        starts = np.unique(np.concatenate([found[f][0] for f in band]))
        ends = np.append(starts[1:] - 1, last[-1])
        ends = np.minimum(ends, last[owner[starts]])
        key = np.full(len(starts), np.uint64(b + 1) * _ODD, np.uint64)
        for f in band:
            lo, _, at, values = found[f]
            key = _mix(key * _ODD + values[np.searchsorted(lo, starts, "right") - 1])
        lo, _, at, _ = found[band[0]]
        c = at[np.searchsorted(lo, starts, "right") - 1]
        texts_out.append(long[owner[starts]])
        keys_out.append(key.view(np.int64))
        packed_out.append(((c - base[owner[starts]]) << 12) | ((c - starts) << 6) | (c - ends))
    return np.concatenate(texts_out), np.concatenate(keys_out), np.concatenate(packed_out)


def _alike(a: np.ndarray, b: np.ndarray, at: np.ndarray, offset: int, length: int, similarity: float) -> np.ndarray:
    """Which of the passages of a that begin at these places are similar, as sets of shingles, to b's passage offset places before."""
    out = np.zeros(len(at), bool)
    for lo in range(0, len(at), CHECKED):
        own, other = at[lo : lo + CHECKED, None] + np.arange(length), at[lo : lo + CHECKED, None] - offset + np.arange(length)
        rows = [np.sort(x, axis=1) for x in (a[own], b[other], np.concatenate((a[own], b[other]), axis=1))]
        one, two, union = ((np.diff(x, axis=1) != 0).sum(axis=1) + 1 for x in rows)
        out[lo : lo + CHECKED] = one + two - union >= similarity * union - 1e-9
    return out


def _once(values: np.ndarray) -> np.ndarray:
    """Which values occur once."""
    order = np.argsort(values, kind="stable")
    new = np.concatenate(([True], values[order][1:] != values[order][:-1], [True]))
    out = np.empty(len(values), bool)
    out[order] = new[:-1] & new[1:]
    return out


class _Places:
    """Where each shingle of a is in b, for texts most of whose shingles occur once."""

    def __init__(self, a: np.ndarray, b: np.ndarray, length: int):
        again = [np.concatenate(([0], np.cumsum(~_once(x)))) for x in (a, b)]
        #: Passages, by their start, that hold a shingle which their text has more than once.
        self.mixed = [x[length:] - x[:-length] > 0 if len(x) > length else np.zeros(0, bool) for x in again]
        order = np.argsort(b, kind="stable")
        found = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
        self.own = np.flatnonzero(b[order][found] == a)
        self.other = order[found[self.own]]
        self.size = len(a)
        self.length = length

    def alike(self, at: np.ndarray, offset: int, similarity: float) -> np.ndarray:
        """_alike of passages neither of which is mixed: equal shingles are counted by the passages that hold both places."""
        there = self.other + offset
        lo, hi = np.maximum(self.own, there) - self.length + 1, np.minimum(self.own, there)
        good = (lo <= hi) & (hi >= 0) & (lo < self.size)
        steps = np.bincount(np.maximum(lo[good], 0), minlength=self.size + 1) - np.bincount(np.minimum(hi[good] + 1, self.size), minlength=self.size + 1)
        same = np.cumsum(steps)[at]
        return same >= similarity * (2 * self.length - same) - 1e-9


def similar_spans(a: np.ndarray, b: np.ndarray, offsets: list[int], length: int = LENGTH, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Spans of words of a that passages similar to b cover, both as shingles, at these offsets (place in a less place in b).

    One passage of a is compared with one of b, which begins offset places before: their sets of shingles must be
    similar, and as many shingles as that takes must be equal at the offset or up to SHIFT places beside it (a word put in
    or left out moves what follows by one; passages that are similar have room for one such word).
    Overlapping passages are one span, which begins and ends with shingles that b has.
    """
    places = np.arange(max(0, len(a) - length + 1))
    open_ = np.ones(len(places), bool)
    known = None
    equal = np.zeros(len(a), bool)  # shingles of accepted passages that b's have too
    for o in sorted(offsets, key=abs):
        lo, hi = max(0, o), min(len(a), len(b) + o)  # the part of a beside b
        here = slice(lo, max(lo, hi - length + 1))
        if not open_[here].any():
            continue
        at = a[lo:hi]
        near = at == b[lo - o : hi - o]
        whole = np.concatenate(([0], np.cumsum(near)))
        whole = whole[length:] - whole[:-length] == length  # equal word for word: similar without a look at the sets
        for shift in range(-SHIFT, SHIFT + 1):
            first, last = max(lo, o + shift), min(hi, len(b) + o + shift)
            near[first - lo : last - lo] |= a[first:last] == b[first - o - shift : last - o - shift]
        total = np.concatenate(([0], np.cumsum(near)))
        same = total[length:] - total[:-length]
        tried = np.flatnonzero(open_[here] & (same >= similarity * (2 * length - same) - 1e-9)) + lo
        sure = whole[tried - lo]
        doubt = tried[~sure]
        if len(doubt):
            known = known or _Places(a, b, length)
            mixed = known.mixed[0][doubt] | known.mixed[1][doubt - o]
            alike = np.empty(len(doubt), bool)
            alike[mixed] = _alike(a, b, doubt[mixed], o, length, similarity)
            alike[~mixed] = known.alike(doubt[~mixed], o, similarity)
            doubt = doubt[alike]
        good = np.concatenate((tried[sure], doubt))
        if len(good):
            open_[good] = False
            edges = np.zeros(len(a) + 1, np.int64)
            edges[good] += 1
            edges[good + length] -= 1
            equal[lo:hi] |= near & (np.cumsum(edges)[lo:hi] > 0)
    starts = places[~open_]
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    out = []
    for lo, hi in zip(starts[np.concatenate(([0], cut + 1))], starts[np.append(cut, len(starts) - 1)] + length):
        own = np.flatnonzero(equal[lo:hi]) + lo
        out.append((int(own[0]), int(own[-1]) + SHINGLE))
    return out


def _shingles(text: bytes | None) -> np.ndarray:
    return shingle_hashes(word_hashes([text or b""])[0])


def _identified(docs: DataFrame, id_col: str, text_col: str, uid_col: str) -> DataFrame:
    """docs with a uid of each row: the id where ids tell rows apart, else the row's place in a table written in their order."""
    key = F.col(id_col).cast("long")
    again = docs.groupBy(key.alias("k")).agg(F.count("*").alias("n")).filter("n > 1 or k is null").limit(1)
    if again.isEmpty():
        return docs.withColumn(uid_col, key)
    order = [key, F.xxhash64(F.col(text_col).cast("string"))]
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.withColumn(uid_col, F.monotonically_increasing_id()), "passages-rows")


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about PIECE bytes of text and SLICE rows at most."""
    sizes = [len(t.as_py()) for t in batch.column(1).cast(pa.binary())]
    lo = held = 0
    for i, n in enumerate(sizes):
        if i > lo and (held + n > PIECE or i - lo >= SLICE):
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def _candidates(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                with np.errstate(over="ignore"):
                    at, key, packed = signatures([t.as_py() for t in part.column(1).cast(pa.binary())])
                uids = part.column(0).to_numpy()[at]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(uids), pa.array(packed)], ["key", "uid", "packed"])

    return rows.select("uid", "text").mapInArrow(run, "key long, uid long, packed long")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, lead, offsets, text, lead_text) -> (uid, lead, starts, ends) in words."""
    lead, lead_shingles = None, np.zeros(0, np.uint64)
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for uid, first, offsets, text, lead_text in zip(*(c for c in batch.columns)):
            with np.errstate(over="ignore"):
                if first.as_py() != lead:
                    lead, lead_shingles = first.as_py(), _shingles(lead_text.as_py().encode())
                spans = similar_spans(_shingles(text.as_py().encode()), lead_shingles, offsets.as_py())
            for column, x in zip(out, (uid.as_py(), lead, [s[0] for s in spans], [s[1] for s in spans])):
                column.append(x)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, out, kinds)), ["uid", "lead", "starts", "ends"])


#: Shingles that a row carries on each side of its place: those of any passage that holds it, and what shifts reach.
_REACH = LENGTH - 1 + SHIFT


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, rows of (key, packed, asks), text) -> (key, uid, packed, asks, content, near).

    near: the shingles around a row's place in 32 bits each, 0 beyond what its passages, shifted or not, reach; content: a hash of that and of its starts.
    """
    for batch in batches:
        rows = batch.column(1)
        number = np.diff(rows.offsets.to_numpy())
        flat = rows.flatten()
        key, packed, asks = flat.field("key"), flat.field("packed"), flat.field("asks")
        values, at, near, contents = packed.to_numpy(), 0, [], []
        for n, text in zip(number.tolist(), batch.column(2).cast(pa.binary())):
            with np.errstate(over="ignore"):
                shingles = _shingles(text.as_py())
            line = np.zeros(len(shingles) + 2 * _REACH, np.uint32)
            line[_REACH : _REACH + len(shingles)] = np.maximum(shingles >> np.uint64(32), np.uint64(1))
            for x in values[at : at + n].tolist():
                low, high = _REACH - SHIFT - (x >> 6 & 63), _REACH + SHIFT + LENGTH - (x & 63)
                own = line[(x >> 12) + low : (x >> 12) + high].tobytes()
                near.append(bytes(4 * low) + own + bytes(4 * (2 * _REACH + 1 - high)))
                contents.append(xxhash.xxh3_64_intdigest(own, x & 4095) - (1 << 63))
            at += n
        uids = pa.array(np.repeat(batch.column(0).to_numpy(), number))
        yield pa.RecordBatch.from_arrays([key, uids, packed, asks, pa.array(contents, pa.int64()), pa.array(near, pa.binary())], ["key", "uid", "packed", "asks", "content", "near"])


def _alike_starts(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, start) where a passage of a may be similar to b's that begins as far from its place; starts are lo..hi, counted from LENGTH - 1 before the places.

    As in similar_spans, that many shingles must be equal at their place or up to SHIFT places beside it.
    """
    inner = slice(SHIFT, SHIFT + 2 * LENGTH - 1)
    near = np.zeros((len(a), 2 * LENGTH - 1), bool)
    for shift in range(2 * SHIFT + 1):
        near |= a[:, inner] == b[:, shift : shift + 2 * LENGTH - 1]
    least = int(np.ceil(2 * LENGTH * SIMILARITY / (1 + SIMILARITY) - 1e-9))
    some = np.flatnonzero(near.sum(axis=1) >= least)
    total = np.zeros((len(some), 2 * LENGTH), np.int16)
    np.cumsum(near[some], axis=1, out=total[:, 1:])
    start = np.arange(LENGTH)
    good = (total[:, LENGTH:] - total[:, :LENGTH] >= least) & (start >= lo[some, None]) & (start <= hi[some, None])
    pair, at = np.nonzero(good)
    return some[pair], at


def _first_alike(near: np.ndarray, own: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of (row, row it meets, start), in the order in which a row's start tries others: the places of the first similar as sets of shingles."""
    group = np.cumsum(np.concatenate(([0], (own[1:] != own[:-1]) | (at[1:] != at[:-1])))) if len(own) else own
    tried, last = np.flatnonzero(np.diff(group, prepend=-1)), len(group)
    out = []
    while len(tried):
        width = SHIFT + at[tried, None] + np.arange(LENGTH)
        good = np.concatenate([np.zeros(0, bool), *(
            _alike(near[own[t]].ravel(), near[other[t]].ravel(), np.arange(len(t)) * near.shape[1] + width[k : k + CHECKED, 0], 0, LENGTH, SIMILARITY)
            for k in range(0, len(tried), CHECKED) for t in [tried[k : k + CHECKED]]
        )])
        out.append(tried[good])
        after = tried[~good] + 1
        after = after[after < last]
        tried = after[group[after] == group[after - 1]]
    return np.concatenate([np.zeros(0, np.int64), *out])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (rows of asks, uid, packed, near) -> (uid, start, lead, offset): for every start of a row that asks, the first earlier text of the cell with a similar passage."""
    for batch in batches:
        for cell in batch.column(0):
            rows = cell.values
            asks, uid, packed = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("asks", "uid", "packed"))
            near = np.frombuffer(b"".join(rows.field("near").to_pylist()), np.uint32).reshape(len(uid), -1)
            order = np.argsort(uid, kind="stable")
            asking = order[asks[order]]
            told = order[~asks[order]]
            # starts as _alike_starts counts them
            low, high = LENGTH - 1 - (packed >> 6 & 63), LENGTH - 1 - (packed & 63)
            before = np.searchsorted(uid[told], uid[asking])  # who asks meets these
            step = max(1, PAIRS // max(1, len(told)))
            for k in range(0, len(asking), step):
                some, number = asking[k : k + step], before[k : k + step]
                own = np.repeat(some, number)
                other = told[np.arange(len(own)) - np.repeat(np.cumsum(number) - number, number)]
                lo, hi = np.maximum(low[own], low[other]), np.minimum(high[own], high[other])
                fit = np.flatnonzero(lo <= hi)
                own, other = own[fit], other[fit]
                pair, at = _alike_starts(near[own], near[other], lo[fit], hi[fit])
                sort = np.lexsort((pair, at, own[pair]))
                own, other, at = own[pair[sort]], other[pair[sort]], at[sort]
                found = _first_alike(near, own, other, at)
                own, other, place = own[found], other[found], packed >> 12
                columns = uid[own], place[own] + at[found] - LENGTH + 1, uid[other], place[own] - place[other]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["uid", "start", "lead", "offset"])


_SPANS = "array<struct<start:long,end:long>>"


def _uncovered(members: DataFrame, spans: DataFrame) -> DataFrame:
    """members (key, uid, packed, lead) whose starts no span (uid, start, end) covers; a text has no more rows than words."""
    own = members.groupBy("uid").agg(F.collect_list(F.struct(*(c for c in members.columns if c != "uid"))).alias("own"))
    done = spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("done"))
    low = lambda m: _place(m["packed"]) - F.shiftrightunsigned(m["packed"], 6).bitwiseAND(F.lit(63))
    high = lambda m: _place(m["packed"]) - m["packed"].bitwiseAND(F.lit(63)) + LENGTH + SHINGLE - 1
    covered = lambda m: F.exists(F.coalesce("done", F.array().cast(_SPANS)), lambda d: (d["start"] <= low(m)) & (high(m) <= d["end"]))
    rows = own.join(done, "uid", "left").select("uid", F.explode(F.filter("own", lambda m: ~covered(m))).alias("m"))
    return rows.select("m.key", "uid", *(f"m.{c}" for c in members.columns if c not in ("key", "uid")))


def _place(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 12)


def _near(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(uid, lead, start, end): what of members is similar to their leader, at the offsets that their places propose."""
    leads = materialize(members.filter("uid = lead").groupBy("key").agg(F.min("packed").alias("lead_packed")), "passages-leads")
    others = members.filter("uid <> lead").join(leads, "key")
    found = _verified(others.select("uid", "lead", (_place(F.col("packed")) - _place(F.col("lead_packed"))).alias("offset")), texts)
    release(leads)
    return found


def _verified(others: DataFrame, texts: DataFrame) -> DataFrame:
    """(uid, lead, offset) -> (uid, lead, start, end): what of the text uid is similar to the text lead at these offsets."""
    pairs = others.groupBy("uid", "lead").agg(F.collect_set("offset").alias("offsets"))  # as long as the text at most
    pairs = materialize(pairs, "passages-pairs")  # so that joins with a popular leader can be split
    both = pairs.join(texts, "uid").join(texts.select(F.col("uid").alias("lead"), F.col("text").alias("lead_text")), "lead")
    found = both.select("uid", "lead", "offsets", "text", "lead_text").mapInArrow(_verify, "uid long, lead long, starts array<long>, ends array<long>")
    found = found.select("uid", "lead", F.explode(F.arrays_zip("starts", "ends")).alias("x"))
    found = materialize(found.select("uid", "lead", F.col("x.starts").alias("start"), F.col("x.ends").alias("end")), "passages-verified")
    release(pairs)
    return found


def _met(open_: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """(uid, lead, offset): for every start of the open rows, earlier texts with a similar passage under the same signature.

    Of a signature's rows of equal content the first text answers for all; the others repeat it. What stays is dealt to
    blocks: a cell compares a block of open rows with a block of rows.
    """
    keys = open_.select("key").distinct()
    every = members.join(keys, "key", "left_semi").select("key", "uid", "packed", F.lit(False).alias("asks"))
    rows = every.union(open_.select("key", "uid", "packed", F.lit(True).alias("asks")))
    own = rows.groupBy("uid").agg(F.collect_list(F.struct("key", "packed", "asks")).alias("rows"))  # as many as the text has words, a few times over
    near = own.join(texts, "uid").select("uid", "rows", "text").mapInArrow(_around, "key long, uid long, packed long, asks boolean, content long, near binary")
    near = materialize(near, "passages-near")
    first = near.filter("not asks").groupBy("key", "content").agg(F.min(F.struct("uid", "packed")).alias("first"), F.first("near").alias("near"))
    first = materialize(first.select("key", "content", F.col("first.uid").alias("lead"), F.col("first.packed").alias("lead_packed"), "near"), "passages-first")
    asking = near.filter("asks").drop("asks").join(first.drop("near"), ["key", "content"])
    asking = materialize(asking, "passages-asking")
    place, offset = _place(F.col("packed")), _place(F.col("packed")) - _place(F.col("lead_packed"))
    starts = F.sequence(place - F.shiftrightunsigned("packed", 6).bitwiseAND(F.lit(63)), place - F.col("packed").bitwiseAND(F.lit(63)))
    same = asking.filter("lead < uid").select("uid", F.explode(starts).alias("start"), "lead", offset.alias("offset"))
    asks = asking.filter("lead = uid").select("key", F.lit(True).alias("asks"), "uid", "packed", "near")
    told = first.select("key", F.lit(False).alias("asks"), F.col("lead").alias("uid"), F.col("lead_packed").alias("packed"), "near")
    told = told.join(asks.select("key").distinct(), "key", "left_semi")
    both = materialize(asks.union(told), "passages-cells")
    blocks = [F.ceil(F.count_if(x) / BLOCK).cast("int") for x in (F.col("asks"), ~F.col("asks"))]
    sizes = materialize(both.groupBy("key").agg(blocks[0].alias("ni"), blocks[1].alias("nj")), "passages-blocks")
    mixed = F.xxhash64("uid", "packed")
    cells = both.join(sizes, "key").withColumn("block", F.pmod(mixed, F.when(F.col("asks"), F.col("ni")).otherwise(F.col("nj"))).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("nj")).otherwise(F.col("ni")) - 1)))
    cell = [F.when(F.col("asks"), F.col(a)).otherwise(F.col(b)).alias(name) for a, b, name in (("block", "other", "i"), ("other", "block", "j"))]
    cells = cells.select("key", *cell, F.struct("asks", "uid", "packed", "near").alias("row")).groupBy("key", "i", "j").agg(F.collect_list("row").alias("rows"))
    cells = cells.filter("size(rows) > 1")
    found = cells.select("rows").mapInArrow(_meet, "uid long, start long, lead long, offset long").union(same)
    # one text for each start, whichever signature named it
    found = found.groupBy("uid", "start").agg(F.min(F.struct("lead", "offset")).alias("x")).select("uid", "x.lead", "x.offset").distinct()
    found = materialize(found, "passages-met")
    release(near, first, asking, both, sizes)
    return found


def _led(members: DataFrame) -> DataFrame:
    """(key, lead) of each signature that two texts share, written: a join with it can be split at a popular key."""
    first = members.groupBy("key").agg(F.min("uid").alias("lead"), F.max("uid").alias("top"))
    return materialize(first.filter("lead < top").select("key", "lead"), "passages-led")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (uid, doc_id, text); spans (uid, lead, start, end), words start..end-1 of uid repeat text lead."""
    (uid,) = fresh(docs, "uid")
    return _spans_of(_identified(docs, id_col, text_col, uid), id_col, text_col, uid)


def _spans_of(docs: DataFrame, id_col: str, text_col: str, uid_col: str) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col(uid_col).alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = _candidates(rows)  # computed once for the signatures and once for their rows: cheaper than a written table
    led = _led(found)
    members = materialize(found.join(led, "key").select("key", "uid", "packed", "lead"), "passages-members")
    release(led)
    texts = materialize(rows.join(members.select("uid").distinct(), "uid", "left_semi").select("uid", "text"), "passages-texts")
    spans = _near(members, texts)
    open_ = rest = materialize(_uncovered(members.filter("uid <> lead"), spans), "passages-open")
    for _ in range(ROUNDS - 1):
        again = rest.drop("lead")
        led = _led(again)
        if led.isEmpty():
            break
        again = again.join(led, "key").select("key", "uid", "packed", "lead")
        more = _near(again, texts)
        spans = spans.union(more)
        # a round's leader has met all others: it leads no further round, but stays open
        after = materialize(_uncovered(again.filter("uid <> lead"), more), "passages-rest")
        still = materialize(_uncovered(open_, more), "passages-open")
        release(led, open_, *([rest] if rest is not open_ else []))
        rest, open_ = after, still
    met = _met(open_, members, texts)
    more = _verified(met, texts)
    release(met, members)
    return rows, spans.union(more)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, n_repeated words, repeat_of ids, spans of words), a row for each text with a repeated passage."""
    rows, spans = repeated_spans(docs, id_col, text_col)
    return _by_text(rows, spans)


def _by_text(rows: DataFrame, spans: DataFrame) -> DataFrame:
    ids = rows.select(F.col("uid").alias("lead"), F.col("doc_id").alias("lead_id"))
    merged = _merged(spans.join(ids, "lead"))
    return merged.join(rows.select("uid", "doc_id"), "uid").select("uid", "doc_id", "n_repeated", "repeat_of", "spans")


def _merged(spans: DataFrame) -> DataFrame:
    """A row for each uid, its overlapping spans merged; a text has no more spans than words."""
    grouped = spans.groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("raw"), F.sort_array(F.collect_set("lead_id")).alias("repeat_of"))
    kind = "array<struct<start:long,end:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for spans in batch.column(1):
                out: list[dict] = []
                for s in spans.as_py():
                    if out and s["start"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], s["end"])
                    else:
                        out.append(dict(s))
                merged.append(out)
            n = pa.array([sum(s["end"] - s["start"] for s in out) for out in merged], pa.int64())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n, pa.array(merged, kind)], ["uid", "repeat_of", "n_repeated", "spans"])

    return grouped.mapInArrow(run, f"uid long, repeat_of array<long>, n_repeated long, spans {kind}")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans and the white space before each of them."""
    raw = text.encode()
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    ends = edges[1::2]
    out, at = [], 0
    for lo, hi in spans:
        out.append(raw[at : int(ends[lo - 1]) if lo else 0])
        at = int(ends[hi - 1])
    out.append(raw[at:])
    return b"".join(out).decode()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs without repeated passages, each kept where it occurs first; texts of which nothing stays are dropped.

    A column chars_col, if there is one, is counted anew where a text was cut. Rows without an id are left alone.
    """
    cut_id, cut_spans, uid = fresh(docs, "cut_id", "cut_spans", "cut_uid")
    known = _identified(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, uid)
    spans = _by_text(*_spans_of(known, id_col, text_col, uid))
    cuts = spans.select(F.col("uid").alias(cut_id), F.col("spans").alias(cut_spans))
    joined = known.join(cuts, F.col(uid) == F.col(cut_id), "left")
    names = joined.columns
    at, where = names.index(text_col), names.index(cut_spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at), batch.column(where)):
                texts.append(cut_words(text.as_py() or "", [(s["start"], s["end"]) for s in spans.as_py()]) if spans.is_valid else text.as_py())
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    whole = joined.filter(F.col(cut_spans).isNull())
    cut = joined.filter(F.col(cut_spans).isNotNull()).mapInArrow(run, joined.schema)
    cut = cut.filter(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    if chars_col in docs.columns:
        cut = cut.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return whole.select(*docs.columns).union(cut.select(*docs.columns)).union(docs.filter(F.col(id_col).isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    return repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_repeated", "repeat_of", "spans")
