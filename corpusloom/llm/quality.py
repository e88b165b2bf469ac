"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text becomes a bag of hashed terms: its words (runs of letters, digits and bytes above ASCII, ASCII lower case),
its runs of other marks, and pairs of neighbours among both; what equals its predecessor counts as the one term
"again" in its place. Terms weigh 1 + log(count), times the inverse document frequency over all documents. A truncated singular value
decomposition, taken by random projection of a bounded sample of the labelled texts, gives the latent space; the
sample's vectors, their labels and the projection are broadcast (MAX_LABELLED x RANK and TERMS x RANK floats, 8 MB
at most). Every document is projected in blocks, its exact cosine products with all labelled vectors are taken as
blocked matrix products, and the labels of its NEIGHBOURS nearest vote with their similarity as weight. No lengths,
rates or thresholds enter.

Labels, language, source and id are never inputs of a score: the id only decides which labels are learned.

Defined cases: a null text counts as empty; a text without terms has the zero vector, all of whose similarities
are 0, and scores the share of good labels in the sample; repeated rows are scored alike; rows of labels whose
quality is null, or whose document is absent, teach nothing, nor does an id whose labels disagree; of several
texts under one labelled id the smallest teaches; without any label every score is 0.5; further columns pass
through classify(), whose new columns get underscores until their names are free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import crc_bucket, fresh, materialize, read_table
from corpusloom.llm.passages import _mix, _Powers

#: The most labelled rows that are learned (the smallest hashes of the id win) and the size of the space.
MAX_LABELLED = 4000
RANK = 64
NEIGHBOURS = 15
TERMS = 1 << 15
#: Dimensions of the random projection that the decomposition is taken in, and how many of them a term adds to.
SKETCH, SPREAD = 2048, 4
BLOCK = 256
#: Bytes of text whose terms are found together.
PIECE = 4_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_AGAIN = np.uint64(0xD6E8FEB86659FD93)
_SPACE, _WORD, _MARK = 0, 1, 2


def _kinds() -> np.ndarray:
    """Byte -> white space, part of a word, or mark."""
    table = np.full(256, _MARK, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = _SPACE
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[lo:hi] = _WORD
    return table


_KIND = _kinds()


def _terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, term) of every word, run of marks and pair of neighbours."""
    raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    kind = _KIND[raw]
    edge = np.flatnonzero(np.diff(kind, prepend=_SPACE))  # where a run begins
    ends = np.append(edge[1:], len(raw))
    solid = kind[edge] != _SPACE
    starts, ends = edge[solid], ends[solid]
    up, down = _Powers.get(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    found = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, first)))
    same = owner[1:] == owner[:-1]
    found[1:][same & (found[1:] == found[:-1])] = _AGAIN
    pair = _mix(found[:-1] * _ODD + found[1:])
    return np.concatenate((owner, owner[1:][same])), np.concatenate((found, pair[same])) % np.uint64(TERMS)


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, term, count) of every distinct term of each text, by text."""
    none = np.zeros(0, np.int64)
    owners, terms, counts = [none], [none], [none]
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < PIECE):
            size += len(texts[upto])
            upto += 1
        with np.errstate(over="ignore"):
            owner, term = _terms(texts[at:upto])
        keys = np.sort(owner * TERMS + term.astype(np.int64))
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        owners.append(keys[new] // TERMS + at)
        terms.append(keys[new] % TERMS)
        counts.append(np.diff(np.append(new, len(keys))))
        at = upto
    return np.concatenate(owners), np.concatenate(terms), np.concatenate(counts)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _weighted(texts: list[bytes], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, weights) of each text, the weights of length 1."""
    owner, term, n = bags(texts)
    weight = ((1 + np.log(n)) * idf[term]).astype(np.float32)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield term[a:b], weight[a:b] / np.sqrt(max(weight[a:b] @ weight[a:b], 1e-9))


#: A sparse random projection, the same everywhere: each term adds to SPREAD of SKETCH dimensions, with a sign.
_PLACES = np.random.default_rng(2).integers(0, SKETCH, (TERMS, SPREAD))
_SIGNS = np.random.default_rng(3).choice(np.array([-1, 1], np.float32), (TERMS, SPREAD)) / np.float32(np.sqrt(SPREAD))


def sketches(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    """The randomly projected bag of each text."""
    parts = [np.bincount(_PLACES[t].ravel(), (_SIGNS[t] * w[:, None]).ravel(), SKETCH) for t, w in _weighted(texts, idf)]
    return np.array(parts, np.float32).reshape(-1, SKETCH)


class Model:
    """The latent space (a row of matrix for each term) and the labelled vectors in it; small enough to broadcast."""

    def __init__(self, idf: np.ndarray, matrix: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.idf, self.matrix = idf.astype(np.float32), matrix.astype(np.float32)
        self.vectors, self.labels = _unit(vectors).astype(np.float32), labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5

    @classmethod
    def decompose(cls, x: np.ndarray, labels: np.ndarray, idf: np.ndarray, rank: int = RANK) -> Model:
        """From the sketches of the sample: their right singular vectors span the latent space."""
        basis = np.random.default_rng(5).normal(size=(SKETCH, rank + 16)).astype(np.float32)
        for _ in range(6):  # subspace iteration
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        _, turn = np.linalg.eigh(((x @ basis).T @ (x @ basis)).astype(np.float64))
        basis = np.ascontiguousarray(basis @ turn[:, ::-1][:, :rank], np.float32)
        return cls(idf, sum(_SIGNS[:, k, None] * basis[_PLACES[:, k]] for k in range(SPREAD)), x @ basis, labels)

    def vote(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Scores of projected texts."""
        if not len(self.labels):
            return np.full(len(vectors), 0.5)
        k = min(neighbours, len(self.labels))
        products = _unit(vectors) @ self.vectors.T
        near = np.argpartition(-products, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(products, near, axis=1), 0)
        total = weights.sum(axis=1)
        vote = (weights * self.labels[near]).sum(axis=1)
        return np.where(total > 0, vote / np.maximum(total, 1e-9), self.prior)

    def vectors_of(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), self.matrix.shape[1]), np.float32)
        for i, (term, weight) in enumerate(_weighted(texts, self.idf)):
            out[i] = weight @ self.matrix[term]
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.clip(self.vote(self.vectors_of(texts)), 0.0, 1.0).astype(np.float64)


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The weight of each term by the number of documents that hold it: an array of sums for each task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                texts = _bytes(batch.column(0).slice(lo, BLOCK))
                total[:TERMS] += np.bincount(bags(texts)[1], minlength=TERMS)
                total[TERMS] += len(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    table = texts.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # TERMS + 1 rows at most
    seen = np.zeros(TERMS + 1)
    seen[table["i"].to_numpy()] = table["n"].to_numpy()
    return np.log((1 + seen[TERMS]) / (1 + seen[:TERMS])) + 0.3


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `most` rows (text, label), those of the smallest hashes of their ids; ids whose remainder is 1 aren't used."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
    marks = marks.agg(F.min("quality").alias("label"), F.max("quality").alias("other")).filter("label = other").drop("other")
    chosen = marks.filter(crc_bucket("_id", 3) != 1).orderBy(F.xxhash64("_id"), "_id").limit(most)
    chosen = materialize(chosen, "quality-chosen")  # at most `most` rows: small enough to broadcast
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    return found.groupBy("_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model. Only projections of the sample reach the driver: at most `most` rows of SKETCH floats, as bytes."""
    idf = inverse_frequencies(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(idf.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.astype(np.float16).tobytes() for x in sketches(_bytes(batch.column(0)), shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(rows, pa.binary())], ["label", "x"])

    sample = labelled_sample(docs, labels, most, id_col, text_col).mapInArrow(run, "label int, x binary")
    rows = sorted((bytes(r["x"]), r["label"]) for r in sample.collect())
    x = np.stack([np.frombuffer(r[0], np.float16).astype(np.float32) for r in rows]) if rows else np.zeros((0, SKETCH), np.float32)
    return Model.decompose(x, np.array([r[1] for r in rows], np.float32), idf)


def classify(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, higher where label 1 is likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    (score_col,) = fresh(docs, score_col)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType(), False)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(lo, BLOCK)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(_bytes(batch.column(at))))], names)

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score at least the threshold, columns as they were."""
    scored = classify(docs, fit(docs, labels))
    return scored.filter(F.col(scored.columns[-1]) >= threshold).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, fit(docs, read_table(spark, sf_dir, "labels"))).drop("text")
    return scored.select(
        "doc_id",
        (crc_bucket("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
