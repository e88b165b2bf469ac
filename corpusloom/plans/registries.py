"""Queries over registries as files, constraints and metrics, and their DuckDB side."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import integrity
from corpusloom.plans.catalogue import _table, query
from corpusloom.sources import metrics, registry
from corpusloom.sources.shared import shared_dir

#: The star schema's own rules; most are broken somewhere in the tables.
STAR = [
    integrity.Unique("line_unique", "lineitem", ("l_orderkey", "l_linenumber")),
    integrity.Unique("line_supplier_unique", "lineitem", ("l_orderkey", "l_suppkey")),
    integrity.Refers("order_customer", "orders", ("o_custkey",), "good_customer", ("c_custkey",)),
    integrity.Refers("line_small_part", "lineitem", ("l_partkey",), "small_part", ("p_partkey",)),
    integrity.within("order_price", "orders", ("o_orderkey",), "o_totalprice", 1000, 400000),
    integrity.matches("customer_segment", "customer", ("c_custkey",), "c_mktsegment", "^[A-F]"),
    integrity.SameSet("good_customers_order", "good_customer", ("c_custkey",), "large_order", ("o_custkey",)),
]


@query(
    "p31_violations",
    """with v as (
    select 'line_unique' as rule, '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || '}' as key, count(*) n from lineitem group by l_orderkey, l_linenumber having count(*) > 1
    union all select 'line_supplier_unique', '{"l_orderkey":' || l_orderkey || ',"l_suppkey":' || l_suppkey || '}', count(*) from lineitem group by l_orderkey, l_suppkey having count(*) > 1
    union all select 'order_customer', '{"o_custkey":' || o_custkey || '}', count(*) from orders where o_custkey not in (select c_custkey from customer where c_acctbal >= 0) group by o_custkey
    union all select 'line_small_part', '{"l_partkey":' || l_partkey || '}', count(*) from lineitem where l_partkey not in (select p_partkey from part where p_size <= 45) group by l_partkey
    union all select 'order_price', '{"o_orderkey":' || o_orderkey || '}', count(*) from orders where not (o_totalprice >= 1000 and o_totalprice <= 400000) group by o_orderkey
    union all select 'customer_segment', '{"c_custkey":' || c_custkey || '}', count(*) from customer where not regexp_matches(c_mktsegment, '^[A-F]') group by c_custkey
    union all select 'good_customers_order', '{"c_custkey":' || c_custkey || ',"missing_in":"large_order"}', count(*) from customer where c_acctbal >= 0 and c_custkey not in (select o_custkey from orders where o_totalprice > 300000) group by c_custkey
    union all select 'good_customers_order', '{"c_custkey":' || o_custkey || ',"missing_in":"good_customer"}', count(*) from orders where o_totalprice > 300000 and o_custkey not in (select c_custkey from customer where c_acctbal >= 0) group by o_custkey)
    select rule, key, n::bigint as n from v""",
)
def _(spark, sf_dir):
    tables = {name: _table(spark, sf_dir, name) for name in ("lineitem", "orders", "customer")}
    tables["small_part"] = _table(spark, sf_dir, "part").filter("p_size <= 45")
    tables |= {"good_customer": tables["customer"].filter("c_acctbal >= 0"), "large_order": tables["orders"].filter("o_totalprice > 300000")}
    return integrity.violations(tables, STAR)


@query(
    "s17_counted_write",
    """select 'orders' as stage, count(*) as n, sum(cast(round(o_totalprice * 100) as bigint))::bigint as cents, count(distinct o_custkey)::bigint as customers, max(o_orderkey) as last from orders""",
)
def _(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    root = f"{shared_dir(spark)}/counted-{uuid.uuid4().hex}"
    counters = {"n": F.count("*"), "cents": F.sum("cents"), "last": F.max("o_orderkey")}
    metrics.write_counted(rows, f"{root}/rows", counters, f"{root}/metrics", "orders")
    customers = spark.read.parquet(f"{root}/rows").agg(F.countDistinct("o_custkey").alias("customers")).withColumn("stage", F.lit("orders"))
    return spark.read.parquet(f"{root}/metrics").select("stage", "n", "cents", "last").join(customers, "stage")


_DRAFTS = """d as (select p_partkey, 'mode_' || p_partkey % 9 as subdir,
  case when p_partkey % 11 = 0 then 'w' || p_partkey when p_partkey % 3 = 0 then 'v' || p_partkey % 5 else 'v' || p_partkey end as version,
  case when p_partkey % 7 = 0 then p_name || ' {other}' when p_partkey % 13 = 0 then '  ' when p_partkey % 17 = 0 then repeat(p_name || ' {text}', 40) else p_name || ' {{x}} {text}' end as content from part)"""


@query(
    "x05_checked_drafts",
    f"""with {_DRAFTS}, taken as (select distinct 'mode_' || p_partkey % 9 as subdir, 'v' || p_partkey % 5 as version from part where p_partkey % 4 = 0 and p_partkey % 5 > 0),
    e as (select d.*, case when d.subdir = 'mode_8' then 'unknown_mode' when contains(content, '{{other}}') then 'invalid_prompt'
      when not regexp_matches(d.version, '^v[1-9][0-9]*$') then 'invalid_prompt_version' when trim(content) = '' then 'invalid_prompt'
      when length(content) > 200 then 'prompt_too_large' when t.version is not null then 'prompt_version_exists' end as error
      from d left join taken t on t.subdir = d.subdir and t.version = d.version)
    select subdir, version, sha256(content) as draft, case when error is null and row_number() over (partition by subdir, version, error is null order by content) > 1
      then 'prompt_version_exists' else error end as error_code from e""",
)
def _(spark, sf_dir):
    part, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    subdir = F.concat(F.lit("mode_"), (k % 9).cast("string"))
    version = F.when(k % 11 == 0, F.concat(F.lit("w"), k)).when(k % 3 == 0, F.concat(F.lit("v"), k % 5)).otherwise(F.concat(F.lit("v"), k))
    whole = F.concat("p_name", F.lit(" {text}"))
    content = F.when(k % 7 == 0, F.concat("p_name", F.lit(" {other}"))).when(k % 13 == 0, "  ").when(k % 17 == 0, F.repeat(whole, 40)).otherwise(F.concat("p_name", F.lit(" {{x}} {text}")))
    drafts = part.select(subdir.alias("subdir"), version.alias("version"), content.alias("content"))
    taken = part.filter((k % 4 == 0) & (k % 5 > 0)).select(subdir.alias("subdir"), F.lit("prompt").alias("kind"), F.concat(F.lit("v"), k % 5).alias("version"))
    modes = drafts.select("subdir").distinct().filter("subdir <> 'mode_8'")
    rows = registry.checked_drafts(drafts, modes, taken, 200)
    return rows.select("subdir", "version", F.sha2(F.col("content").cast("binary"), 256).alias("draft"), "error_code")
