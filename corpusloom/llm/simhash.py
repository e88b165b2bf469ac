"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprint: 64 bits over the XXH64 (seed 42) values of a text's word shingles, repeats included; a bit is
set when more than half the values have it. Two fingerprints that differ in at most 2r bits both reach some
variant within r bits of each, so each distinct fingerprint emits its whole ball of radius r, one shuffle
brings equal variants together, and members of one variant's group differ by 2r bits at most: each is linked
to the smallest of its group and the link is verified. A group holds at most one ball (65 at radius 1), so
no list of pairs arises however many documents share a fingerprint.

That is op9's contract (near_prints). near_duplicates, the pipeline's stage, links the same fingerprints in the same
way. For whole documents 64 bits are too coarse alone: a similarity of 0.8 over five-word shingles is some 10 bits.
So it adds the links that min-hashes of the shingles find: texts that agree on all ROWS minima of one of BANDS bands are
candidates, each is compared with the band's leader by exact shingle sets, and those it doesn't explain are compared
again under a leader of their own, in groups split by one more min-hash, until no group has two or the EXTRA hashes are
used up. A pair of similarity 0.8 shares no band with probability 0.2 %.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; a text with
fewer words than a shingle is one shingle; repeated rows and null ids keep their rows; a component whose ids
are all null has a null component_id; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import fresh, materialize
from corpusloom.llm.graph import components
from corpusloom.llm.passages import shingle_hashes, word_hashes

SHINGLE = 3
RADIUS = 1
SEED = 42
#: Least similarity (equal shingles over the union) of near-duplicate documents, over shingles of five words.
SIMILARITY = 0.8
BANDS, ROWS, EXTRA = 16, 5, 8
_DRAW = np.random.default_rng(9).integers(1, 1 << 63, (2, BANDS * ROWS + EXTRA), np.uint64)
_TIMES, _PLUS = _DRAW[0] << np.uint64(1) | np.uint64(1), _DRAW[1]


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    values = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = values[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints fp of nodes within 2 * radius bits (radius 0 or 1)."""
    flips = "transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))" if radius else "array()"
    ball = F.expr(f"explode(concat(array(fp), {flips}))" if radius else "explode(array(fp))")
    variants = nodes.select("fp", ball.alias("variant")).repartition("variant")
    shared = variants.groupBy("variant").agg(F.min("fp").alias("v"), F.max("fp").alias("top")).filter("v < top")
    pairs = variants.join(shared, "variant").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    return pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2 * radius)


def near_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id), a row for each of docs; component_id is the smallest id reachable."""
    prints = materialize(with_fingerprint(docs, id_col, text_col, shingle), "simhash-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(links(nodes, radius), "simhash-links").select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = materialize(rooted.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: bytes | None) -> tuple[int, np.ndarray]:
    """(hash of the words, sorted distinct hashes of the five-word shingles); fewer words are one shingle, none an empty set."""
    with np.errstate(over="ignore"):
        words = word_hashes([text or b""])[0]
        found = shingle_hashes(words)
    node = xxhash.xxh3_64_intdigest(words.tobytes())
    if len(words) and not len(found):
        found = np.array([node], np.uint64)
    return node - (1 << 63), np.unique(found)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty."""
    out = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            np.minimum(out, (shingles[at : at + 2048, None] * _TIMES + _PLUS).min(axis=0), out=out)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / max(1, len(a) + len(b) - same)


def _nodes(docs: DataFrame, hashed: bool) -> DataFrame:
    """(doc_id, text) -> (doc_id, node, fp, keys, extra) with the bands' keys, or (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, keys, extras = [], [], [], []
            for t in batch.column(1).cast(pa.binary()):
                node, shingles = shingle_set(t.as_py())
                nodes.append(node)
                if hashed:
                    prints.append(fingerprint(t.as_py()))
                    low = minima(shingles) if len(shingles) else np.zeros(0, np.uint64)
                    bands = low[: BANDS * ROWS].reshape(-1, ROWS)
                    keys.append([xxhash.xxh3_64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(bands)])
                    extras.append(low[BANDS * ROWS :].view(np.int64))
            if hashed:
                fps = pa.array(np.array(prints, np.uint64).view(np.int64))
                arrays = [batch.column(0), pa.array(nodes, pa.int64()), fps, pa.array(keys, pa.list_(pa.int64())), pa.array(extras, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "node", "fp", "keys", "extra"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column(1)], ["node", "text"])

    return docs.mapInArrow(run, "doc_id long, node long, fp long, keys array<long>, extra array<long>" if hashed else "node long, text string")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, text, other) -> those (u, v) that are similar enough."""
    held, shingles = None, np.zeros(0, np.uint64)
    for batch in batches:
        good = []
        for v, text, other in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())):
            if v != held:
                held, shingles = v, shingle_set(other.as_py())[1]
            good.append(similarity(shingle_set(text.as_py())[1], shingles) >= SIMILARITY)
        kept = batch.filter(pa.array(good, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["u", "v"])


def similar_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (u, v) of nodes (node, keys, extra) whose texts are at least SIMILARITY alike."""
    members = nodes.select("node", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("top")).filter("lead < top").select("key")
    open_ = materialize(members.join(shared, "key").select("key", "node"), "simhash-open")
    texts = _nodes(docs, False).join(open_.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = materialize(texts, "simhash-texts")
    found = None
    for turn in range(EXTRA + 1):
        leads = open_.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("top")).filter("v < top").select("key", "v")
        led = materialize(open_.withColumnRenamed("node", "u").join(leads, "key").filter("u <> v"), "simhash-led")
        if led.isEmpty():
            break
        pairs = led.select("u", "v").distinct()
        pairs = pairs.join(texts.select(F.col("node").alias("u"), "text"), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("other")), "v")
        good = materialize(pairs.select("u", "v", "text", "other").mapInArrow(_similar, "u long, v long"), "simhash-similar")
        found = good if found is None else found.union(good)
        if turn < EXTRA:
            rest = led.join(good, ["u", "v"], "left_anti").join(nodes.select(F.col("node").alias("u"), F.col("extra")[turn].alias("more")), "u")
            open_ = materialize(rest.select(F.xxhash64("key", "more").alias("key"), F.col("u").alias("node")), "simhash-open")
    return docs.sparkSession.createDataFrame([], "u long, v long") if found is None else found


def print_links(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all nodes (node, fp) whose fingerprints differ in 2 * RADIUS bits at most."""
    firsts = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "simhash-fps")
    same = nodes.join(firsts, "fp").filter("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    near = links(firsts.select("fp"))
    for end in ("u", "v"):
        near = near.join(firsts.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node")), end)
    return same.union(near.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, root, component_id), a row for each of docs; component_id is the smallest id reachable over near fingerprints and similar texts.

    node stands for the text's words, root for the component.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = materialize(_nodes(source, True), "simhash-prints")
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("extra").alias("extra"))
    nodes = materialize(nodes, "simhash-nodes")
    edges = print_links(nodes.select("node", "fp")).union(similar_links(source, nodes))
    roots = components(edges, "simhash-links").select(F.col("node").alias("u"), "root")
    rooted = nodes.join(roots, F.col("node") == F.col("u"), "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = materialize(rooted.join(least, "root").select("node", "root", "component_id"), "simhash-classes")
    return prints.join(classes, "node").select("doc_id", "node", "root", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest id, and of several rows of that id one.

    Rows of one id whose texts aren't similar belong to components of their own: each stays. Rows with a null id can't
    be told apart by name; they all stay.
    """
    node_col, first_node, first_id = fresh(docs, "node", "first_node", "first_id")
    known = docs.filter(F.col(id_col).isNotNull())
    found = near_duplicates(known, id_col, text_col)
    # the smallest node of a component's smallest id names the rows to keep
    firsts = found.filter("doc_id = component_id").groupBy("root").agg(F.min("doc_id").alias(first_id), F.min("node").alias(first_node))
    firsts = materialize(firsts.drop("root"), "simhash-firsts")
    again = materialize(firsts.groupBy(first_id).agg(F.count("*").alias("n")).filter("n > 1").select(first_id), "simhash-again")
    repeated = known.groupBy(F.col(id_col).cast("long").alias("k")).agg(F.count("*").alias("n")).filter("n > 1").select("k")
    apart = materialize(repeated.union(again.select(F.col(first_id).alias("k"))).distinct(), "simhash-apart")
    here = F.col(id_col).cast("long")
    # ids of one row need no look at the text
    plain = known.join(apart, here == F.col("k"), "left_anti").join(firsts, here == F.col(first_id), "left_semi")
    rest = known.join(apart, here == F.col("k"), "left_semi")
    rest = with_node(rest, text_col, node_col)
    rest = rest.join(firsts, (here == F.col(first_id)) & (F.col(node_col) == F.col(first_node)), "left_semi")
    rest = rest.dropDuplicates([id_col, node_col]).drop(node_col)
    return plain.select(*docs.columns).union(rest.select(*docs.columns)).union(docs.filter(F.col(id_col).isNull()))


def with_node(docs: DataFrame, text_col: str, node_col: str) -> DataFrame:
    """docs with the hash of each text's words."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(node_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [shingle_set(t.as_py())[0] for t in batch.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], schema.names)

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from corpusloom.llm.common import read_table

    found = near_prints(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
