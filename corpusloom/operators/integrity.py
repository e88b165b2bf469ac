"""Declared constraints over registry and data tables, compiled into one plan that returns what violates them.

P31, U6, U7, S11. Each constraint names its rule; violations() gives (rule, key, n): the offending key as JSON and how
many rows have it. Every rule is an aggregate or an anti-join on its key, so it works on tables of any size; keys are
counted where they lie before they are shuffled, so a hot key is a few partial sums.

Defined cases: nulls violate Matches and Within unless optional, are one key for Unique, satisfy Refers (as in SQL) and
are an element for SameSet; an empty table violates nothing but SameSet.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def _keyed(rows: DataFrame, rule: str, columns: Sequence[str]) -> DataFrame:
    """Rows with a count n as (rule, key, n); nulls stay in the key."""
    key = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return rows.select(F.lit(rule).alias("rule"), key.alias("key"), F.col("n").cast("long").alias("n"))


def _counted(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Unique:
    """No two rows share the columns."""

    rule: str
    table: str
    columns: tuple[str, ...]

    def plan(self, tables: Tables) -> DataFrame:
        return _keyed(_counted(tables[self.table], self.columns).filter("n > 1"), self.rule, self.columns)


@dataclass(frozen=True)
class Refers:
    """Each value of the columns occurs in the other table; also unknown keys, with the known ones as the other table."""

    rule: str
    table: str
    columns: tuple[str, ...]
    other: str
    other_columns: tuple[str, ...]

    def plan(self, tables: Tables) -> DataFrame:
        names = list(self.columns)
        mine = _counted(tables[self.table].dropna(subset=names), names)
        known = tables[self.other].select(*(F.col(o).alias(c) for c, o in zip(names, self.other_columns, strict=True))).distinct()
        return _keyed(mine.join(known, names, "left_anti"), self.rule, names)


@dataclass(frozen=True)
class Holds:
    """A condition (SQL text) is true in each row; rows are told by the key columns. Null isn't true unless optional."""

    rule: str
    table: str
    key: tuple[str, ...]
    condition: str
    optional: bool = False

    def _bad(self) -> Column:
        return ~F.coalesce(F.expr(self.condition), F.lit(self.optional))

    def plan(self, tables: Tables) -> DataFrame:
        return _keyed(_counted(tables[self.table].filter(self._bad()), self.key), self.rule, self.key)


def matches(rule: str, table: str, key: tuple[str, ...], column: str, pattern: str, optional: bool = False) -> Holds:
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return Holds(rule, table, key, f"{column} rlike '{quoted}'", optional)


def within(rule: str, table: str, key: tuple[str, ...], column: str, least: float | None = None, most: float | None = None, optional: bool = False) -> Holds:
    bounds = [f"{column} >= {least}"] * (least is not None) + [f"{column} <= {most}"] * (most is not None)
    return Holds(rule, table, key, " and ".join(bounds) or "true", optional)


@dataclass(frozen=True)
class SameSet:
    """Both tables hold the same set of values; the key tells the side that lacks one."""

    rule: str
    table: str
    columns: tuple[str, ...]
    other: str
    other_columns: tuple[str, ...]

    def plan(self, tables: Tables) -> DataFrame:
        names = list(self.columns)
        a = tables[self.table].select(*names)
        b = tables[self.other].select(*(F.col(o).alias(c) for c, o in zip(names, self.other_columns, strict=True)))
        tagged = a.withColumn("_side", F.lit(1)).union(b.withColumn("_side", F.lit(2)))
        sides = tagged.groupBy(*names).agg(F.count("*").alias("n"), F.min("_side").alias("_least"), F.max("_side").alias("_most"))
        lacking = sides.filter("_least = _most").withColumn("missing_in", F.when(F.col("_least") == 1, self.other).otherwise(self.table))
        return _keyed(lacking, self.rule, [*names, "missing_in"])


Constraint = Unique | Refers | Holds | SameSet


def violations(tables: Tables, constraints: Sequence[Constraint]) -> DataFrame:
    """(rule, key, n) of all constraints in one plan."""
    return reduce(DataFrame.union, [c.plan(tables) for c in constraints])


def enforce(tables: Tables, constraints: Sequence[Constraint], shown: int = 10) -> None:
    """Raise before any work is done if a constraint is violated; the message shows some of the violations."""
    found = violations(tables, constraints).limit(shown).collect()
    if found:
        raise ValueError("config_error: " + "; ".join(f"{r['rule']}: {r['key']}" for r in found))


#: The least context window, the supported provider, and the keys of a text-optimization section.
MIN_CONTEXT_WINDOW = 2048
PROVIDERS = ("ollama",)


def registry_constraints(min_window: int = MIN_CONTEXT_WINDOW, providers: Sequence[str] = PROVIDERS) -> list[Constraint]:
    """P31, U6 for tables profiles (profile, provider, model, timeout_seconds, temperature, context_window_tokens), modes (mode,
    subdir, default_profile, default_version), overrides (client_id, mode, profile), prompts (subdir, version, layer: base
    layer's rows alone), settings (mode, key, value) and known_keys (key, least, most: bounds of the value)."""
    listed = ", ".join(f"'{p}'" for p in providers)
    profile = ("profile",)
    return [
        Unique("profile_unique", "profiles", profile),
        Holds("profile_provider", "profiles", profile, f"provider in ({listed})"),
        Holds("profile_model", "profiles", profile, "model <> ''"),
        Holds("profile_timeout", "profiles", profile, "timeout_seconds > 0"),
        within("profile_temperature", "profiles", profile, "temperature", least=0),
        within("profile_window", "profiles", profile, "context_window_tokens", least=min_window, optional=True),
        Refers("mode_profile", "modes", ("default_profile",), "profiles", ("profile",)),
        Refers("mode_prompt", "modes", ("subdir", "default_version"), "prompts", ("subdir", "version")),
        Refers("override_mode", "overrides", ("mode",), "modes", ("mode",)),
        Holds("override_named", "overrides", ("client_id", "mode"), "profile <> ''"),
        Refers("override_profile", "overrides", ("profile",), "profiles", ("profile",)),
        Refers("setting_mode", "settings", ("mode",), "modes", ("mode",)),
        Refers("setting_key", "settings", ("key",), "known_keys", ("key",)),
        Holds("setting_value", "bounded_settings", ("mode", "key"), "value >= least and (most is null or value <= most)"),
    ]


def bounded_settings(settings: DataFrame, known_keys: DataFrame) -> DataFrame:
    """Settings of known keys with their bounds, values as numbers (null where they are none)."""
    return settings.join(known_keys, "key").withColumn("value", F.expr("try_cast(value as double)"))
