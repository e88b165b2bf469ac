"""Exact top-k inner-product search by the three-phase uniform threshold.

A vector's dimensions are split into LISTS segments; a segment's inner product with a query is that vector's
entry in one score list, and a score is the sum over the lists. Vectors stay in the partitions they are read in;
queries go in blocks of about QUERY_BLOCK, each broadcast, and the lists of a block are computed as blocked integer
matrix products, a list at a time.

Phase 1 gathers each list's best local entries, resolves only those exactly and takes for each query the k-th best
of them: at least k vectors score that much, so it is a safe cutoff. Phase 2 sends the cutoff back; with
m lists a vector below cutoff / m in every list stays below the cutoff, so each list reports the entries at or
above cutoff / m, and no answer can be missed. Phase 3 resolves the remaining scores of those reported
exactly and merges the best k of every task. Scores of vectors that no list reports are never added up.

A task sends at most k rows for each query and phase, whatever the number of ties; what the driver sees of a block,
its vectors and its cutoffs, is bounded by QUERY_BLOCK rows.

Defined cases: vectors that are null or hold null or non-finite components take no part, as queries or as
candidates; vectors of different lengths are compared on zero-extended components; a query has fewer than k
answers when there are fewer candidates; ties go to the smaller vec_id; a vec_id's own rows are never its
answers, repeated rows of another id are answers each; a query id is asked once, with the smallest of its vectors;
null ids take no part; scores beyond the range of a long count as its limit; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, read_table

K = 10
LISTS = 4
SCALE = 1024
#: Queries of one broadcast; queries and candidates of one matrix product.
QUERY_BLOCK = 16_384
ROWS, COLUMNS = 1024, 2048
#: Sums below these are exact in doubles and in longs.
_EXACT, _LONG = 2**53, 2**63


def quantise(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<double> of floor(scale * x)) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        row = x.values.to_numpy(zero_copy_only=False)
        out[i, : len(row)] = row
    return out


def _width(column: pa.Array) -> int:
    return max((len(x.values) for x in column), default=0)


def _lists(q: np.ndarray, c: np.ndarray, lists: int) -> Iterator[np.ndarray]:
    """The score lists, one after the other: for each segment, every query's integer products with every candidate."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound >= _LONG:
        q, c = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, c))
    elif bound >= _EXACT:
        q, c = q.astype(np.int64), c.astype(np.int64)
    cuts = np.linspace(0, q.shape[1], lists + 1).astype(int)
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield q[:, a:b] @ c[:, a:b].T


def _top(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each row, by score and then by the smaller id."""
    order = np.lexsort((ids, ~scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.searchsorted(rows, rows)
    good = np.arange(len(rows)) - first < k
    return rows[good], ids[good], scores[good]


def reported(parts: list[np.ndarray], k: int, cutoffs: np.ndarray | None, banned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what the lists report: their best k of each row or, given cutoffs, all that reach their share of it."""
    found = np.zeros(parts[0].shape, bool)
    for part in parts:
        if cutoffs is not None:
            found |= part >= (cutoffs / len(parts) - np.abs(cutoffs) * 1e-15)[:, None]  # rounding must not raise it
        elif part.shape[1] <= k + 1:
            found[:] = True
        else:
            values = part if part.dtype != object else part.astype(float)
            best = np.argpartition(-values, k, axis=1)[:, : k + 1]  # one more, as the query's own may be among them
            np.put_along_axis(found, best, True, axis=1)
    return np.nonzero(found & ~banned)


def _search(q_ids: np.ndarray, queries: np.ndarray, cutoffs: np.ndarray | None, k: int, lists: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = {lo: (none, none, none) for lo in range(0, len(q_ids), ROWS)}
        for batch in batches:
            for at in range(0, batch.num_rows, COLUMNS):
                part = batch.slice(at, COLUMNS)
                width = max(queries.shape[1], _width(part.column(1)))
                c_ids, c = part.column(0).to_numpy(), _matrix(part.column(1), width)
                for lo in best:
                    q = np.zeros((len(q_ids[lo : lo + ROWS]), width))
                    q[:, : queries.shape[1]] = queries[lo : lo + ROWS]
                    parts = list(_lists(q, c, lists))
                    rows, columns = reported(parts, k, None if cutoffs is None else cutoffs[lo : lo + ROWS], q_ids[lo : lo + ROWS, None] == c_ids)
                    scores = sum(p[rows, columns] for p in parts)  # phase 3, and the exact values of phase 1
                    if scores.dtype == object:
                        scores = np.array([min(max(x, -_LONG), _LONG - 1) for x in scores], np.int64)
                    new = (rows, c_ids[columns], scores.astype(np.int64))
                    best[lo] = _top(*(np.concatenate(x) for x in zip(best[lo], new)), k)
        for lo, (rows, ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[lo + rows]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """found with rank, the k best of each query; Spark cuts each part to k rows a query before it shuffles."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(queries: DataFrame, vectors: DataFrame, k: int = K, lists: int = LISTS, block: int = QUERY_BLOCK) -> DataFrame:
    """queries and vectors: (vec_id, v) of integers -> (query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    vectors = materialize(vectors, "topk-vectors")
    queries = materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    blocks = max(1, -(-queries.count() // block))
    out = None
    for number in range(blocks):
        table = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).orderBy("vec_id").toArrow()  # about `block` rows
        q_ids = table["vec_id"].to_numpy()
        q = _matrix(table["v"], _width(table["v"]))

        def phase(cutoffs: np.ndarray | None, q_ids=q_ids, q=q) -> DataFrame:
            shared = spark.sparkContext.broadcast((q_ids, q, cutoffs))
            run = lambda batches: _search(*shared.value, k, lists)(batches)
            return _merged(vectors.mapInArrow(run, "query_id long, vec_id long, score long"), k)

        first = {r["query_id"]: r["score"] for r in phase(None).filter(F.col("rank") == k).select("query_id", "score").collect()}
        known = (first.get(i, -_LONG) for i in q_ids.tolist())
        cutoffs = np.array([float(x) if x > -_LONG else -np.finfo(float).max for x in known])
        answers = materialize(phase(cutoffs).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk-answers")
        out = answers if out is None else out.union(answers)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    vectors = quantise(read_table(spark, sf_dir, "embeddings"))
    return search(vectors.filter("vec_id % 100 = 0"), vectors)


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
