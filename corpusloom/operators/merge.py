"""Answers of several calls to one document merged, checked and explained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as t

# --- Fixed values -----------------------------------------------------------------------------------------
#: A field is null unless the field that it depends on has a value.
DEPENDS = {
    "notice_period_unit": "notice_period_value", "notice_period_value": "notice_period_unit", "renewal_period_unit": "renewal_period_value",
    "renewal_period_value": "renewal_period_unit", "currency": "amount", "payment_interval": "amount",
}
#: list field -> (key fields, most items, primary key).
LISTS = {"sites": (("name", "street", "zip", "city"), 10, None), "assets": (("name", "location"), 50, "serial_number")}
# ----------------------------------------------------------------------------------------------------------


def authoritative(answers: DataFrame) -> DataFrame:
    """(doc_id, field, call_no, value, owner) -> the owners' rows of a field, or all rows if none owns it."""
    owners = F.max(F.col("owner").cast("int")).over(Window.partitionBy("doc_id", "field"))
    return answers.withColumn("owners", owners).filter("owner or owners = 0").drop("owners")


def merge_scalars(answers: DataFrame, order: tuple[str, ...] = ("call_no",)) -> DataFrame:
    """A10: (doc_id, field, value, conflict): one distinct value stays in its first spelling, several are null and a conflict."""
    rows = authoritative(answers).withColumn("key", t.scalar_key(F.col("value")))
    first = F.min_by(F.when(F.col("value").isNotNull(), F.col("value")), F.when(F.col("value").isNotNull(), F.struct(*order)))
    grouped = rows.groupBy("doc_id", "field").agg(F.count_distinct("key").alias("n"), first.alias("first"))
    return grouped.select("doc_id", "field", F.when(F.col("n") == 1, F.col("first")).alias("value"), (F.col("n") > 1).alias("conflict"))


def null_dependents(merged: DataFrame) -> DataFrame:
    """A field loses its value where the field it depends on has none."""
    pairs = F.create_map(*(F.lit(x) for pair in DEPENDS.items() for x in pair))
    doc = Window.partitionBy("doc_id")
    filled = F.collect_set(F.when(F.col("value").isNotNull(), F.col("field"))).over(doc)
    rows = merged.withColumn("filled", filled).withColumn("needs", F.try_element_at(pairs, F.col("field")))
    keeps = F.col("needs").isNull() | F.array_contains("filled", F.col("needs"))
    return rows.withColumn("value", F.when(keeps, F.col("value"))).drop("filled", "needs")


def item_key(item: Column, keys: tuple[str, ...], primary: str | None) -> Column:
    """The identity of a list item: its normalised primary key, else its normalised fields together."""
    combined = F.concat_ws("\x1f", *(F.coalesce(t.scalar_key(item[k]), F.lit("")) for k in keys))
    if primary is None:
        return combined
    own = t.serial_key(item[primary])
    return F.when(F.coalesce(own, F.lit("")) != "", F.concat(F.lit("#"), own)).otherwise(combined)


def merge_lists(items: DataFrame, field: str) -> DataFrame:
    """(doc_id, call_no, pos, item) -> (doc_id, items): distinct items in order, as many as the field may hold."""
    keys, most, primary = LISTS[field]
    names = (*keys, *([primary] if primary else []))
    filled = F.coalesce(*(F.when(F.trim(F.col("item")[k]) != "", F.lit(True)) for k in names), F.lit(False))
    rows = items.filter(filled).withColumn("key", item_key(F.col("item"), keys, primary))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("call_no", "pos"))).filter("rn = 1")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("call_no", "pos"))).filter(F.col("place") <= most)
    grouped = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "item"))).alias("rows"))
    return grouped.select("doc_id", F.col("rows.item").alias("items"))


def merge_notes(notes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(doc_id, notes): distinct notes in call order, then a sentence for each field in conflict."""
    rows = notes.filter(F.trim("note") != "").groupBy("doc_id", "note").agg(F.min("call_no").alias("at")).select("doc_id", F.lit(0).alias("kind"), F.col("at").cast("string").alias("at"), "note")
    said = conflicts.filter("conflict").select("doc_id", F.lit(1).alias("kind"), F.col("field").alias("at"), F.concat(F.lit("Conflicting values for "), "field", F.lit(".")).alias("note"))
    grouped = rows.union(said).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("kind", "at", "note"))).alias("rows"))
    return grouped.select("doc_id", F.array_join("rows.note", "\n").alias("notes"))


def strict_sum(column: str) -> Column:
    """The sum, or null when any value is unknown."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def probe_counts(texts: DataFrame, probes: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """How often each probe occurs in each of the columns, without overlaps."""
    count = lambda c, p: ((F.length(c) - F.length(F.replace(F.col(c), F.lit(p), F.lit("")))) / len(p)).cast("int")
    return texts.withColumns({f"{c}_{i}": count(c, p) for c in columns for i, p in enumerate(probes)})


def gold_check(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold (doc_id, field, kind, expected array) against results (doc_id, field, value): with passed.

    kind: equals (null expected: null), contains (all, case aside), excludes (none) or any_of.
    """
    rows = gold.join(results, ["doc_id", "field"], "left")
    value = F.coalesce(F.lower("value"), F.lit(""))
    inside = lambda x: F.contains(value, F.lower(x))
    passed = (
        F.when(F.col("kind") == "contains", F.forall("expected", inside))
        .when(F.col("kind") == "excludes", ~F.exists("expected", inside))
        .when(F.col("kind") == "any_of", F.coalesce(F.array_contains("expected", F.col("value")), F.lit(False)))
        .otherwise(F.col("expected")[0].eqNullSafe(F.col("value")))
    )
    return rows.withColumn("passed", passed)


def findings(results: DataFrame) -> DataFrame:
    """Suspicious answers: an amount below 1000 with three decimals, a notice text without value, a renewal without period."""
    three = F.abs("amount").between(0, 999.9999) & F.col("amount").cast("string").rlike(r"^-?\d{1,3}\.\d{3}$")
    found = F.array_compact(
        F.array(
            F.when(three, "amount_thousands_separator"),
            F.when((F.trim("notice_period") != "") & F.col("notice_period_value").isNull(), "notice_without_value"),
            F.when(F.col("auto_renewal") & F.col("renewal_period_value").isNull(), "renewal_without_period"),
        )
    )
    return results.withColumn("findings", found)
