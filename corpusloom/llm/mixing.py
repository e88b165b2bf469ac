"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a weight and shares a budget of words by it; what exceeds a source's cap is shared anew by
weight among the others. A document of the source then gets target / size copies in expectation: the whole
part is certain, the fraction is rounded. Fractional documents are paired and words move between them, at
random in the direction and by the amount that keep every document's expected copies, until one of them is
integral; the total stays the same to the word. In a leaf of a few hundred documents of one source this goes from
the largest down, each with the next. Of two documents the larger tends to stay fractional, so one that is more than
twice its next is settled against all smaller ones together instead, as long as these can give or take what it needs
without becoming integral themselves; so what is left of a leaf is small as a rule. It meets those of other leaves in
groups of LEAF, pair by pair, and so on: a reduction tree whose every level is one shuffle of narrow rows, a hot source
being many leaves. Only the last document of a source is rounded alone.

Randomness comes from hashes of the seed and the document, so reruns agree.

Defined cases: a document is the set of rows with one id and one source (a null source is a source of its own); each
of its rows is taken as often as the others. Rows without an id are told apart by their texts. Texts without words have size 0 and are
never taken more than once. A source of size 0 has target 0. A budget above the sum of the caps fills all
caps. Further columns pass through mix(), whose new columns get underscores until their names are free.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, fresh, materialize, read_table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
LEAF = 256
SEED = 17


def words(text: Column) -> Column:
    """The number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> with weight and target. Sources rank by code point, null last; weights repeat by rank."""
    order = F.col("source").asc_nulls_last()
    ranged = materialize(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-ranged")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    parts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int"))
    table = ranged.join(parts, "part").select("source", "source_size", weight.cast("double").alias("weight"))
    table = materialize(table, "mix-sources")
    budget = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # each round fills at least one more source; two or three rounds as a rule
        over = F.col("weight") * level >= cap * F.col("source_size")
        row = table.agg(
            F.count_if(over).alias("n"),
            F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if row["n"] == full or not row["open"]:
            break
        full, level = row["n"], (budget - cap * row["held"]) / row["open"]
    target = F.least(F.col("weight") * F.lit(level), cap * F.col("source_size")) if row["open"] else cap * F.col("source_size")
    return table.withColumn("target", target.cast("double"))


def _draw(*key: object) -> float:
    """A number in [0, 1) from the key alone."""
    digest = hashlib.blake2b("\x1f".join(map(str, key)).encode(), digest_size=8).digest()
    return (int.from_bytes(digest, "little") >> 11) / (1 << 53)


def _pair(a: list, b: list, seed: int) -> tuple[list, list]:
    """Move words between two fractional documents [id, size, x]; returns (the integral one, the other one).

    Raising a by s/size_a lowers b by s/size_b, so the words stay. The larger step up or down that makes one
    of them 0 or 1 is taken with the probability that keeps both expectations.
    """
    up = min((1 - a[2]) * a[1], b[2] * b[1])
    down = min(a[2] * a[1], (1 - b[2]) * b[1])
    if _draw(seed, a[0], b[0]) * (up + down) < down:
        a_done = (1 - a[2]) * a[1] <= b[2] * b[1]
        a[2], b[2] = (1.0, b[2] - up / b[1]) if a_done else (a[2] + up / a[1], 0.0)
    else:
        a_done = a[2] * a[1] <= (1 - b[2]) * b[1]
        a[2], b[2] = (0.0, b[2] + down / b[1]) if a_done else (a[2] - down / a[1], 1.0)
    if a_done and (b[2] <= 1e-12 or b[2] >= 1 - 1e-12):
        b[2] = float(round(b[2]))
    if not a_done and (a[2] <= 1e-12 or a[2] >= 1 - 1e-12):
        a[2] = float(round(a[2]))
    return (a, b) if a_done else (b, a)


def _first_leaf(docs: list[list], x: float, seed: int) -> None:
    """Settle all documents [id, size, x] of one leaf but one; all begin with the fraction x."""
    docs.sort(key=lambda d: (-d[1], d[0]))
    rest = sum(d[1] for d in docs)  # words of the documents that nothing has touched yet
    held = None
    for doc in docs:
        doc[2] = x
        rest -= doc[1]
        whole = rest + doc[1]
        up, down = ((1 - held[2]) * held[1], held[2] * held[1]) if held else (0.0, 0.0)
        if held and 2 * doc[1] < held[1] and up < x * whole and down < (1 - x) * whole:
            moved = up if _draw(seed, held[0], "rest") * (up + down) < down else -down
            held[2] = float(moved > 0)
            x = doc[2] = x - moved / whole
            held = None
        if held is None:
            held = doc
        else:
            _, held = _pair(held, doc, seed)
        if not 0.0 < held[2] < 1.0:
            held = None


def _later_leaf(docs: list[list], seed: int) -> None:
    """Settle all documents [id, size, x] of one leaf but one, pair by pair from the largest down."""
    docs.sort(key=lambda d: (-d[1], d[0]))
    held = None
    for doc in docs:
        if held is None:
            held = doc
        else:
            _, held = _pair(held, doc, seed)
        if not 0.0 < held[2] < 1.0:
            held = None


def _leaves(seed: int, level: int):
    """Rows sorted by leaf -> the rows, all of a leaf integral but one."""

    def settled(node: tuple, docs: list[list]) -> pd.DataFrame:
        if level == 0:
            _first_leaf(docs, docs[0][2], seed)
        else:
            _later_leaf(docs, seed + level)
        return pd.DataFrame([[*node, *d] for d in docs], columns=["source_id", "leaf", "unit", "size", "x"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, docs = None, []
        for batch in batches:
            for source_id, leaf, *doc in zip(*(batch[c].tolist() for c in ("source_id", "leaf", "unit", "size", "x"))):
                if (source_id, leaf) != node:
                    if docs:
                        yield settled(node, docs)
                    node, docs = (source_id, leaf), []
                docs.append(doc)
        if docs:
            yield settled(node, docs)

    return run


def round_fractions(units: DataFrame, seed: int = SEED, leaf: int = LEAF) -> DataFrame:
    """(unit, source_id, size, x in [0, 1), the same for all of a source) -> (unit, up 0 or 1): the reduction tree."""
    fields = "source_id long, leaf long, unit long, size long, x double"
    settled = units.filter("x <= 0 or size <= 0").select("unit", F.lit(0).alias("up"))
    live = units.filter("x > 0 and size > 0")
    counts = live.groupBy("source_id").agg(F.count("*").alias("n"))
    spread = F.pmod(F.xxhash64("unit", F.lit(seed)), F.ceil(F.col("n") / leaf))
    live = live.join(F.broadcast(counts) if _small(counts) else counts, "source_id").withColumn("leaf", spread)
    parts = [settled]
    level = 0
    while True:
        dealt = live.select("source_id", "leaf", "unit", "size", "x").repartition("source_id", "leaf")
        dealt = dealt.sortWithinPartitions("source_id", "leaf")
        out = materialize(dealt.mapInPandas(_leaves(seed, level), fields), f"mix-level{level}")
        parts.append(out.filter("x <= 0 or x >= 1").select("unit", F.col("x").cast("int").alias("up")))
        live = out.filter("x > 0 and x < 1")
        last = live.groupBy("source_id").agg(F.max("leaf").alias("top")).agg(F.max("top")).first()[0]
        if not last:
            break
        live = live.withColumn("leaf", F.floor(F.col("leaf") / leaf))
        level += 1
    chance = F.pmod(F.xxhash64("unit", F.lit(seed + 1000)), F.lit(1 << 30)) / float(1 << 30)
    parts.append(live.select("unit", (chance < F.col("x")).cast("int").alias("up")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _small(sources: DataFrame, most: int = 20_000) -> bool:
    """Whether a table of one row for each source is small enough to broadcast."""
    return sources.limit(most + 1).count() <= most


def _row_key(id_col: str, text_col: str) -> Column:
    """What tells rows without an id apart: their text; 0 for rows with one."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col).cast("string"))).otherwise(F.lit(0).cast("long"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, row, size, source_size, target, copies), a row for each of docs; row tells rows without an id apart."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), _row_key(id_col, text_col).alias("row"))
    sized = materialize(sized, "mix-sizes")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights)
    sources = materialize(sources.withColumn("source_id", F.xxhash64("source")), "mix-targets")
    small = F.broadcast(sources) if _small(sources) else sources
    key = F.xxhash64(F.col("doc_id").cast("string"), "source", "row", F.lit(seed))
    keyed = sized.withColumn("unit", key).join(small.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    keyed = keyed.withColumn("sure", F.floor(ratio + 1e-12)).withColumn("x", F.greatest(ratio - F.col("sure"), F.lit(0.0)))
    units = keyed.groupBy("unit").agg(F.first("source_id").alias("source_id"), F.sum("size").alias("size"), F.first("x").alias("x"))
    ups = round_fractions(materialize(units, "mix-units"), seed)
    copies = (F.col("sure") + F.coalesce("up", F.lit(0))).cast("int")
    return keyed.join(ups, "unit", "left").select("doc_id", "source", "row", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        copy_col: str = "copy", **options) -> DataFrame:
    """The mixed rows: each of docs as often as the mix takes it, with the number of the copy (from 1)."""
    plan = plan_mix(docs, id_col, source_col, text_col, **options)
    (copy_col, a, b, r, n) = fresh(docs, copy_col, "_a", "_b", "_r", "_n")
    taken = plan.filter("copies > 0").groupBy(F.col("doc_id").alias(a), F.col("source").alias(b), F.col("row").alias(r)).agg(F.max("copies").alias(n))
    same = docs[id_col].eqNullSafe(taken[a]) & docs[source_col].cast("string").eqNullSafe(taken[b]) & (_row_key(id_col, text_col) == taken[r])
    return docs.join(taken, same).withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(a, b, r, n)


def query(spark, sf_dir: str) -> DataFrame:
    plan = plan_mix(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
