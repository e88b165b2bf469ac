"""Periodic runs: stretches of words that repeat with a period, found by comparing a text with itself at every lag.

A run is a maximal stretch of words with smallest period q and at least max(MIN_WORDS, MIN_EXP * q) words. At lag q it
shows as a stretch of at least need(q) = max(MIN_WORDS, MIN_EXP * q) - q places i with word[i] = word[i + q]. Every lag from 1 to
n / MIN_EXP is compared, vectorised over word ids. Since a stretch that counts is that long, lag q is first compared
at every stride-th place, stride = need(q) / 4: only where four neighbouring places of that comb agree can a stretch
be, and there every place is compared and true stretches are run-length coded. All lags of a text of n words take some
n log n comparisons instead of n * n / 8, and nothing is missed. A stretch at a multiple of a run's period is the run itself;
its period is reduced to the smallest divisor that holds, and combs that lie inside a known run at a multiple of
its period are passed over.

A text whose combs hold more than COMPARISONS comparisons is dealt out: rows of (text, range of lags), ranges of equal
work, at most MAX_RANGES for a text since each carries the word ids; their runs meet again by the text's hash. Others are
scanned where they are read.

Collapsing a text keeps a run's first period and drops the words after it; overlapping runs drop the union.

Defined cases: a null, empty or blank text has no words and no runs; repeated rows stay and are treated alike; null ids
stay; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, read_table

MIN_WORDS, MIN_EXP = 6, 4
COMPARISONS, MAX_RANGES = 1 << 17, 8
TEETH = 4  # neighbouring places of a comb inside any stretch that counts
_PLANNED, _BLOCK = 4096, 1 << 18
Run = tuple[int, int, int]  # start, length, period


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def need(lag: int | np.ndarray) -> int | np.ndarray:
    """Places in which a run of this period agrees with itself."""
    return np.maximum(MIN_WORDS, MIN_EXP * lag) - lag


def _stride(lag: int | np.ndarray) -> int | np.ndarray:
    return np.maximum(1, need(lag) // TEETH)


def _comb(size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lag, place) of the combs of lags low to high - 1 in size words, lag after lag, each followed by a gap of lag 0."""
    lags = np.arange(low, high, dtype=np.int64)
    strides = _stride(lags)
    counts = (size - lags - 1) // strides + 2
    first = np.cumsum(counts) - counts
    lag = np.repeat(lags, counts)
    place = (np.arange(len(lag)) - np.repeat(first, counts)) * np.repeat(strides, counts)
    gap = first + counts - 1
    lag[gap] = 0
    place[gap] = 0
    return lag.astype(np.int32), place.astype(np.int32), gap


@lru_cache(maxsize=128)
def _planned(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _comb(size, 1, size // MIN_EXP + 1)


def _teeth(agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of TEETH or more true values; agree ends with a false one."""
    edges = np.flatnonzero(np.diff(agree.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= TEETH
    return starts[long], ends[long] - 1


def _clusters(ids: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(lag, first place, last place) of combs that agree in TEETH or more neighbouring places, in order of lag."""
    n = len(ids)
    if n <= _PLANNED and (low, high) == (1, n // MIN_EXP + 1):
        size = -(-n // 16) * 16  # texts of similar lengths share a plan; what is added agrees with nothing
        padded = np.concatenate((ids, -1 - np.arange(size - n, dtype=np.int32)))
        yield from _agreeing(padded, *_planned(size))
        return
    lag = low
    while lag < high:
        stride = int(_stride(lag))
        if (n - lag) // stride >= _BLOCK // 16:
            agree = np.append(ids[: n - lag : stride] == ids[lag::stride], False)
            for a, b in zip(*(x.tolist() for x in _teeth(agree))):
                yield lag, a * stride, b * stride
            lag += 1
        else:
            until = min(high, lag + max(1, _BLOCK // ((n - lag) // stride + 2)))
            yield from _agreeing(ids, *_comb(n, lag, until))
            lag = until


def _agreeing(ids: np.ndarray, lag: np.ndarray, place: np.ndarray, gap: np.ndarray) -> Iterator[tuple[int, int, int]]:
    agree = ids[place] == ids[place + lag]
    agree[gap] = False
    a, b = _teeth(agree)
    yield from zip(lag[a].tolist(), place[a].tolist(), place[b].tolist())


def _smallest(ids: np.ndarray, start: int, length: int, lag: int) -> int:
    """The smallest period of a stretch that has period lag and MIN_EXP times its words: it divides lag."""
    part = ids[start : start + 2 * lag]
    for d in _divisors(lag):
        if np.array_equal(part[:-d], part[d:]):
            return d
    return lag


@lru_cache(maxsize=4096)
def _divisors(n: int) -> list[int]:
    small = [d for d in range(1, int(n**0.5) + 1) if n % d == 0]
    return sorted({*small, *(n // d for d in small)} - {n})


def runs_at(ids: np.ndarray, low: int, high: int) -> set[Run]:
    """The runs that show at lags low to high - 1, with their smallest periods, which may be below low."""
    n, found = len(ids), set()
    known: list[Run] = []  # by start: runs that explain combs at multiples of their periods
    for lag, first, last in _clusters(ids, low, high):
        if _explained(known, lag, first, last):
            continue
        stride, least = int(_stride(lag)), int(need(lag))
        lo, hi = max(0, first - stride), min(n - lag, last + stride + 1)
        same = np.append(ids[lo:hi] == ids[lo + lag : hi + lag], False)
        edges = np.flatnonzero(np.diff(same.view(np.int8), prepend=np.int8(0)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= least:
                run = (lo + a, b - a + lag, _smallest(ids, lo + a, b - a + lag, lag))
                if run not in found:
                    found.add(run)
                    known.insert(bisect_right(known, run), run)
    return found


def _explained(known: list[Run], lag: int, first: int, last: int) -> bool:
    """Whether a run that began before covers these places, at a multiple of its period. Passing over too few is harmless."""
    at = bisect_right(known, (first, 1 << 62, 0))
    return any(s <= first and last + lag < s + length and lag % q == 0 for s, length, q in known[max(0, at - 3) : at])


def find_runs(ids: np.ndarray) -> list[Run]:
    """All runs, by start and period."""
    return sorted(runs_at(ids, 1, len(ids) // MIN_EXP + 1), key=lambda r: (r[0], r[2])) if len(ids) >= MIN_WORDS else []


def comparisons(n: int) -> np.ndarray:
    """Comparisons in combs of lags 1, 2, ... of n words."""
    lags = np.arange(1, n // MIN_EXP + 1, dtype=np.int64)
    return (n - lags) // _stride(lags) + 1


def lag_ranges(n: int, most: int = COMPARISONS) -> list[tuple[int, int]]:
    """Ranges of lags of about equal work, one where all lags take at most this many comparisons."""
    if n < MIN_WORDS:
        return [(1, n // MIN_EXP + 1)]
    total = np.cumsum(comparisons(n))
    parts = int(min(MAX_RANGES, -(-total[-1] // most)))
    cuts = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts) + 2
    bounds = sorted({1, *cuts.tolist(), n // MIN_EXP + 1})
    return list(zip(bounds, bounds[1:]))


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run drops."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s + q for s, _, q in runs], 1)
    np.add.at(edge, [s + length for s, length, _ in runs], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


_SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _result(ids: pa.Array, runs: list[list[Run]], texts: list[bytes]) -> pa.RecordBatch:
    rows = [[dict(zip(("start", "length", "period"), r)) for r in some] for some in runs]
    return pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> results."""
    for batch in batches:
        found, texts = [], []
        for raw in batch.column(1).cast(pa.binary()):
            words = raw.as_py().split()
            runs = find_runs(word_ids(words))
            found.append(runs)
            texts.append(b" ".join(kept_words(words, runs)))
        yield _result(batch.column(0), found, texts)


def _dealt(most: int) -> Callable:
    """(doc_id, key, text) -> (doc_id, key, low, high, ids), a row for each range of lags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(batch.column(2).cast(pa.binary())):
                ids = word_ids(raw.as_py().split()).tobytes()
                for low, high in lag_ranges(len(ids) // 4, most):
                    same = batch.slice(k, 1)
                    yield pa.RecordBatch.from_arrays(
                        [same.column(0), same.column(1), pa.array([low], pa.int64()), pa.array([high], pa.int64()), pa.array([ids], pa.binary())],
                        ["doc_id", "key", "low", "high", "ids"],
                    )

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, low, high, ids) -> (key, start, length, period)."""
    for batch in batches:
        keys, rows = [], []
        for key, low, high, raw in zip(*(c.to_pylist() for c in batch.columns)):
            ids = np.frombuffer(raw, np.int32)
            some = runs_at(ids, low, high) if len(ids) >= MIN_WORDS else set()
            keys += [key] * len(some)
            rows += some
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["key", "start", "length", "period"])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, runs) -> results; runs null where there are none."""
    for batch in batches:
        found, texts = [], []
        for raw, some in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
            runs = sorted(((r["start"], r["length"], r["period"]) for r in some or []), key=lambda r: (r[0], r[2]))
            found.append(runs)
            texts.append(b" ".join(kept_words(raw.as_py().split(), runs)))
        yield _result(batch.column(0), found, texts)


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = COMPARISONS) -> DataFrame:
    """(doc_id, runs, collapsed), a row for each of docs: runs (start, length, period) by start and period, and the words kept, joined by spaces."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # n words take at least two bytes each but the last
    short = F.octet_length("text") < 2 * _most_words(most)
    small = source.filter(short).mapInArrow(_scan, _SCHEMA)
    large = source.filter(~short).withColumn("key", F.sha2("text", 256))
    parts = large.select("doc_id", "key", "text").mapInArrow(_dealt(most), "doc_id long, key string, low long, high long, ids binary")
    parts = parts.repartition(F.xxhash64("doc_id", "key", "low")).select("key", "low", "high", "ids")
    found = parts.mapInArrow(_ranges, "key string, start long, length long, period long").distinct()
    found = found.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    found = materialize(found, "periodic-runs")
    rest = large.join(found, "key", "left").select("doc_id", "text", "runs").mapInArrow(_collapse, _SCHEMA)
    return small.union(rest)


@lru_cache(maxsize=16)
def _most_words(most: int) -> int:
    """The least number of words whose lags take more comparisons."""
    n = 16
    while comparisons(2 * n).sum() <= most:
        n *= 2
    low, high = n, 2 * n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if comparisons(mid).sum() <= most else (low, mid)
    return high


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents of a tenth of the ids with their ends made periodic, as op13's contract says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                h = zlib.crc32(b"" if d is None else str(d).encode())
                words = raw.split() if raw and h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    raw = b" ".join(words[:a] + [words[a + k % p] for k in range(n - a)])
                texts.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, runs, collapsed) -> the contract's columns."""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for batch in batches:
        rows = []
        for some, text in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            best = None
            for r in some:  # by start and period: the first of equals stays
                if best is None or r["length"] * best["period"] > best["length"] * r["period"]:
                    best = r
            listed = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in some)
            first = (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4
            rows.append((len(some), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.as_buffer()).hexdigest()))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names)


def query(spark, sf_dir: str) -> DataFrame:
    found = collapse(planted(read_table(spark, sf_dir, "documents")))
    return found.mapInArrow(_digest, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
