"""Named queries over the test tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.functions import validate
from corpusloom.operators import lines, merge, model, planning, routing, runs, scoring
from corpusloom.plans import duck
from corpusloom.sources import files, synthetic
from corpusloom.streaming import landing

BOM = chr(0xFEFF)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.view(spark, sf_dir, synthetic.CONTRACTS)


def _contract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clean_lines(lines.explode_lines(_contracts(spark, sf_dir)))


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clean_lines(lines.explode_lines(_table(spark, sf_dir, "documents")))


def _digest(rows: DataFrame) -> DataFrame:
    """One row for each document: its lines counted and hashed in order."""
    ordered = F.sort_array(F.collect_list(F.struct("page_no", "line_no", "line")))
    grouped = rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"), ordered.alias("rows"))
    return grouped.select("doc_id", "n_lines", "chars", F.sha2(F.array_join("rows.line", "\n").cast("binary"), 256).alias("digest"))


# --- Projections and predicates ---------------------------------------------------------------------------
@query("n05_n08_collapse_lines", duck.lines(synthetic.CONTRACTS) + "select doc_id, page_no, line_no, line from col")
def _(spark, sf_dir):
    rows = lines.collapsed(lines.explode_lines(_contracts(spark, sf_dir)))
    return rows.select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.col("line_no").cast("long").alias("line_no"), "line")


@query("n12_meaningful_chars", r"select doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))::bigint as chars from documents")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", t.meaningful_chars(F.col("text")).alias("chars"))


@query("n13_value_keys")
def _(spark, sf_dir):
    return _contracts(spark, sf_dir).select("doc_id", t.value_keys(F.col("text")).alias("value_keys"))


@query("n14_token_estimate", "select doc_id, (floor(length(text) / 3.2::double) + 1)::int as tokens from documents")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", t.token_estimate(F.length("text")).alias("tokens"))


@query(
    "n15_call_budget",
    "select doc_id, greatest(1500, floor((4096 * 0.9::double - (floor(n_chars / 3.2::double) + 1) - 512) * 3.2::double)::int) as budget from documents",
)
def _(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", t.call_budget(F.lit(4096), F.col("n_chars")).alias("budget"))


@query(
    "n19_history_block",
    """with r as (select conv_id, turn, case when role = 'assistant' then 'Assistant' else 'User' end || ': ' || coalesce(text, '') as line,
      row_number() over (partition by conv_id order by turn desc) as rn from conversations)
    select conv_id, string_agg(line, chr(10) order by turn) as history from r where rn <= 8 group by conv_id""",
)
def _(spark, sf_dir):
    return routing.history_block(_table(spark, sf_dir, "conversations"))


_TEMPLATE = "Answer from this text only.\n---\n{text}\n---\nLanguage: {lang}. Literal braces stay as the text has them."


@query("n17_n22_prompt_hash", f"select doc_id, sha256({duck.rendered(_TEMPLATE, {'text': 'text', 'lang': 'lang'})}) as prompt_sha256 from documents")
def _(spark, sf_dir):
    prompt = routing.render(_TEMPLATE, {"text": F.col("text"), "lang": F.col("lang")})
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(prompt.cast("binary"), 256).alias("prompt_sha256"))


@query("p01_text_sufficient", r"select doc_id from documents where length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 30")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "documents").filter(t.meaningful(F.col("text"))).select("doc_id")


_PREDICATES: dict[str, tuple[Callable[[Column], Column], str]] = {
    "p02_page_number_lines": (t.is_page_number, duck.matches(t.PAGE_NUMBER)),
    "p03_symbol_noise": (t.is_symbol_noise, duck.NOISE),
    "p05_protected_values": (t.is_protected_value, duck.PROTECTED),
    "p06_table_like": (t.is_table_like, duck.TABLE_LIKE),
    "p07_may_be_header": (t.may_be_header, duck.MAY_BE_HEADER),
    "p09_heading_start": (t.is_heading_start, duck.matches(t.HEADING_START)),
    "p11_field_label": (t.is_field_label, duck.matches(t.FIELD_LABEL, False)),
}


def _predicate(name: str, test: Callable[[Column], Column], sql: str) -> None:
    @query(name, duck.lines(synthetic.CONTRACTS) + f"select doc_id, page_no, line_no from col where line <> '' and {sql}")
    def _(spark, sf_dir):
        rows = lines.collapsed(lines.explode_lines(_contracts(spark, sf_dir)))
        rows = rows.filter((F.col("line") != "") & test(F.col("line")))
        return rows.select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.col("line_no").cast("long").alias("line_no"))


for _name, (_test, _sql) in _PREDICATES.items():
    _predicate(_name, _test, _sql)


# --- Lines, pages and paragraphs --------------------------------------------------------------------------
@query("w02_page_edges", duck.lines(synthetic.CONTRACTS) + duck.PAGE_EDGES + duck.digest("kept"))
def _(spark, sf_dir):
    return _digest(lines.drop_page_edges(_contract_lines(spark, sf_dir)))


@query("w03_page_numbers", duck.lines(synthetic.NUMBERED) + duck.PAGE_NUMBERS + duck.digest("kept"))
def _(spark, sf_dir):
    rows = lines.clean_lines(lines.explode_lines(synthetic.view(spark, sf_dir, synthetic.NUMBERED)))
    return _digest(lines.drop_page_numbers(rows))


@query("w05_contents", duck.lines(synthetic.CONTRACTS) + duck.CONTENTS + duck.digest("kept"))
def _(spark, sf_dir):
    return _digest(lines.drop_toc(_contract_lines(spark, sf_dir)))


@query("w06_repeated_lines", duck.lines("select doc_id, text from documents") + duck.REPEATS + duck.digest("kept"))
def _(spark, sf_dir):
    return _digest(lines.drop_repeats(_document_lines(spark, sf_dir)))


@query("w07_consecutive_duplicates", duck.lines("select doc_id, text from documents") + duck.CONSECUTIVE + duck.digest("kept"))
def _(spark, sf_dir):
    return _digest(lines.drop_consecutive(_document_lines(spark, sf_dir)))


@query(
    "w08_paragraphs",
    duck.lines(synthetic.CONTRACTS) + duck.PARAGRAPHS + """select doc_id, dense_rank() over (partition by doc_id order by island)::int - 1 as para_no,
    count(*)::int as n_lines, sha256(string_agg(line, chr(10) order by page_no, line_no)) as digest from par group by doc_id, island""",
)
def _(spark, sf_dir):
    paras = lines.to_paragraphs(_contract_lines(spark, sf_dir))
    joined = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return paras.select("doc_id", F.col("para_no").cast("int").alias("para_no"), F.size("lines").alias("n_lines"), F.sha2(joined.cast("binary"), 256).alias("digest"))


@query("w09_duplicate_paragraphs", duck.lines(synthetic.CONTRACTS) + duck.PARAGRAPHS + duck.DUPLICATE_PARAGRAPHS)
def _(spark, sf_dir):
    paras = lines.to_paragraphs(_contract_lines(spark, sf_dir))
    plain = paras.select("doc_id", "para_no", F.transform(F.filter("lines", lambda x: ~x["is_barrier"]), lambda x: x["line"]).alias("lines"))
    kept = lines.drop_duplicate_paragraphs(plain.filter(F.size("lines") > 0))
    text = F.array_join("lines", "\n")
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.sum(F.length(text)).alias("chars"))


@query("c01_clean_documents", duck.lines("select doc_id, text from documents") + duck.CONSECUTIVE + duck.CLEANED)
def _(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    kept = lines.drop_consecutive(_document_lines(spark, sf_dir))
    clean = kept.groupBy("doc_id").agg(F.sum(F.length("line")).alias("clean_chars"), F.count("*").alias("n_lines"), F.sum(t.meaningful_chars(F.col("line"))).alias("meaningful_chars"))
    return clean.join(docs.select("doc_id", F.length("text").cast("long").alias("raw_chars")), "doc_id").withColumn("sufficient", F.col("meaningful_chars") >= 30)


@query("c01_normalize_contracts")
def _(spark, sf_dir):
    return lines.normalize(_contracts(spark, sf_dir))


# --- Blocks and scores ------------------------------------------------------------------------------------
def _scores(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    blocks = scoring.segment(lines.normalize(_contracts(spark, sf_dir)))
    return scoring.score(scoring.unit_values(blocks), scoring.VARIANTS[version])


@query("c02_segment")
def _(spark, sf_dir):
    return scoring.segment(lines.normalize(_contracts(spark, sf_dir)))


for _version in scoring.VARIANTS:

    def _block_scores(spark, sf_dir, version=_version):
        rows = synthetic.view(spark, sf_dir, synthetic.CONTRACTS)
        pages = rows.select("doc_id", F.posexplode(F.split("text", "\f", -1)).alias("block_no", "chunk"))
        return scoring.score(pages, scoring.VARIANTS[version]).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "grp", "score", F.array_join("strong", ",").alias("strong"), F.array_join("heading_strong", ",").alias("heading_strong"))

    query(f"a05_block_scores_v{_version}", duck.scores(synthetic.CONTRACTS, scoring.VARIANTS[_version]) + "select doc_id, block_no, grp, score, strong, heading_strong from s")(_block_scores)


def _page_scores(spark, sf_dir):
    pages = synthetic.view(spark, sf_dir, synthetic.CONTRACTS).select("doc_id", F.posexplode(F.split("text", "\f", -1)).alias("block_no", "chunk"))
    return scoring.score(pages.withColumn("block_no", F.col("block_no").cast("long")), scoring.VARIANTS[4])


@query(
    "a07_best_weak",
    duck.scores(synthetic.CONTRACTS, scoring.VARIANTS[4]) + """select doc_id, grp, arg_max(block_no, score * 1000 - block_no) as block_no,
    arg_max(score, score * 1000 - block_no) as score from s where score > 0 and score < 10 group by doc_id, grp""",
)
def _(spark, sf_dir):
    return scoring.best_weak(_page_scores(spark, sf_dir))


@query(
    "w15_interleaved",
    duck.scores(synthetic.CONTRACTS, scoring.VARIANTS[4]) + """, r as (select *, row_number() over (partition by doc_id, grp order by score desc, block_no) as rk from s where score > 0),
    f as (select doc_id, block_no, min(rk * 100 + grp_no) as turn from r group by 1, 2)
    select doc_id, block_no, row_number() over (partition by doc_id order by turn)::int as place from f""",
)
def _(spark, sf_dir):
    return scoring.interleaved(_page_scores(spark, sf_dir))


@query("w13_unit_values")
def _(spark, sf_dir):
    blocks = scoring.segment(lines.normalize(_contracts(spark, sf_dir)))
    return scoring.unit_values(blocks).select("doc_id", "block_no", "links_next", "unit_values")


@query("w14_coverage")
def _(spark, sf_dir):
    return scoring.coverage(_scores(spark, sf_dir, 4))


@query("c05_plan")
def _(spark, sf_dir):
    return planning.plan(lines.normalize(_contracts(spark, sf_dir)), 900, scoring.VARIANTS[4], planning.Settings(direct=800, target=800, chunk_target=600, supporting=200, head=200, tail=100))


@query("c06_reduced_plan")
def _(spark, sf_dir):
    return planning.reduced(_scores(spark, sf_dir), 2000)


# --- Routing and registries -------------------------------------------------------------------------------
@query("c09_route", duck.route(synthetic.QUESTIONS) + "select question_id, mode, matched_rule from r")
def _(spark, sf_dir):
    rows = synthetic.view(spark, sf_dir, synthetic.QUESTIONS)
    return rows.select("question_id", routing.route(F.col("question")).alias("r")).select("question_id", "r.mode", "r.matched_rule")


@query("c10_route_domains", duck.route(synthetic.QUESTIONS) + duck.ROUTE_DOMAINS)
def _(spark, sf_dir):
    rows = synthetic.view(spark, sf_dir, synthetic.QUESTIONS)
    domains = F.filter(F.split("domains", ","), lambda d: d != "")
    out = rows.select("question_id", routing.route_with_domains(F.col("question"), domains).alias("r"))
    return out.select("question_id", "r.mode", "r.matched_rule")


@query("c11_warmup_mode", duck.warmup(synthetic.QUESTIONS))
def _(spark, sf_dir):
    domains = F.filter(F.split("domains", ","), lambda d: d != "")
    return synthetic.view(spark, sf_dir, synthetic.QUESTIONS).select("question_id", routing.warmup_mode(domains, "hotel_health_summary").alias("mode"))


@query(
    "p27_p28_question_guards",
    """with q as (%s), d as (select *, list_filter(string_split(domains, ','), lambda x: x <> '') as ds from q)
    select question_id, case when len(list_filter(ds, lambda x: x in ('projects', 'defects'))) > 0 then 'invalid_request' end as error_code from d""" % synthetic.QUESTIONS,
)
def _(spark, sf_dir):
    domains = F.transform(F.filter(F.split("domains", ","), lambda d: d != ""), lambda d: F.when(d.isin("projects", "defects"), "unknown").otherwise(d))
    return synthetic.view(spark, sf_dir, synthetic.QUESTIONS).select("question_id", routing.question_error(F.col("question"), domains).alias("error_code"))


def _registry(spark):
    clients = spark.sql("select * from values ('k1', 'a', true, map('contract_extraction', 'large')), ('k2', 'b', true, map('contract_extraction', 'gone')), ('k3', 'c', false, map()) as t(api_key, client_id, enabled, model_overrides)")
    modes = spark.sql("select * from values ('contract_extraction', 'small'), ('inspection_extraction', 'small'), ('odd', 'missing') as t(mode, default_profile)")
    return clients, modes, spark.sql("select * from values ('small'), ('large') as t(profile)")


@query("j01_j03_resolve_profile", duck.RESOLVE)
def _(spark, sf_dir):
    requests = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"), F.concat(F.lit("k"), (F.col("c_custkey") % 5).cast("string")).alias("api_key"),
        F.element_at(F.array(*map(F.lit, ("contract_extraction", "inspection_extraction", "odd", "none"))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("mode"),
    )
    return routing.resolve_profiles(requests, *_registry(spark)).select("request_id", "client_id", F.when(F.col("error_code").isNull(), F.col("profile")).alias("profile"), "error_code")


def _versions(spark, sf_dir) -> DataFrame:
    parts = _table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 13 == 0, "draft").otherwise(F.concat(F.lit("v"), (F.col("p_partkey") % 12).cast("string")))
    return parts.select(F.concat(F.lit("mode_"), (F.col("p_partkey") % 7).cast("string")).alias("subdir"), name.alias("version"), (F.col("p_partkey") % 2).cast("int").alias("layer"), F.concat(F.lit("text "), F.col("p_partkey").cast("string")).alias("content"), "p_partkey")


@query("u01_k01_versions", duck.VERSIONS + "select subdir, string_agg(version, ',' order by n) as versions from (select distinct subdir, version, n from v where n is not null) group by subdir")
def _(spark, sf_dir):
    return routing.list_versions(_versions(spark, sf_dir)).select("subdir", F.array_join("versions", ",").alias("versions"))


@query("u02_layered_prompts", duck.VERSIONS + "select subdir, version, arg_min(content, layer * 1000000000 + p_partkey) as content from v group by 1, 2")
def _(spark, sf_dir):
    rows = _versions(spark, sf_dir).withColumn("layer", F.struct("layer", "p_partkey"))
    return routing.load_prompts(rows)


@query("j04_active_versions", duck.VERSIONS + duck.ACTIVE)
def _(spark, sf_dir):
    modes = spark.sql("select concat('mode_', cast(id as string)) as subdir, 'v1' as default_version from range(9)")
    active = spark.sql("select concat('mode_', cast(id as string)) as subdir, concat('v', cast(id * 3 as string)) as version from range(9)")
    return routing.active_versions(modes, active, _versions(spark, sf_dir))


@query("j05_schema_as_of", duck.VERSIONS + "select version, case when n >= 4 then 'schema.v4' when n >= 2 then 'schema.v2' else 'schema' end as schema from (select distinct version, n from v)")
def _(spark, sf_dir):
    schemas = spark.sql("select * from values (0, 'schema'), (2, 'schema.v2'), (4, 'schema.v4') as t(min_version, schema)")
    return routing.schema_as_of(_versions(spark, sf_dir).select("version").distinct(), schemas)


# --- Merging and reports ----------------------------------------------------------------------------------
@query("a10_merge_scalars", duck.answers(synthetic.ANSWERS) + "select doc_id, field, value, conflict from m")
def _(spark, sf_dir):
    return merge.merge_scalars(synthetic.view(spark, sf_dir, synthetic.ANSWERS), ("call_no", "seq"))


@query("j09_null_dependents", duck.answers(synthetic.ANSWERS) + duck.DEPENDENTS)
def _(spark, sf_dir):
    merged = merge.merge_scalars(synthetic.view(spark, sf_dir, synthetic.ANSWERS), ("call_no", "seq"))
    return merge.null_dependents(merged).select("doc_id", "field", "value")


@query("a11_merge_lists", duck.ITEMS)
def _(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    item = F.struct(
        F.concat(F.lit("Lift "), (F.col("o_orderkey") % 3).cast("string")).alias("name"), F.lit("Yard").alias("location"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("sn-"), (F.col("o_orderkey") % 5).cast("string"))).otherwise("").alias("serial_number"),
    )
    rows = orders.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 3).cast("int").alias("call_no"), F.col("o_orderkey").alias("pos"), item.alias("item"))
    merged = merge.merge_lists(rows, "assets")
    return merged.select("doc_id", F.array_join(F.transform("items", lambda i: F.concat(i["name"], F.lit("/"), i["serial_number"])), ",").alias("items"))


@query("a12_merge_notes", duck.answers(synthetic.ANSWERS) + duck.NOTES)
def _(spark, sf_dir):
    rows = synthetic.view(spark, sf_dir, synthetic.ANSWERS)
    conflicts = merge.merge_scalars(rows, ("call_no", "seq"))
    return merge.merge_notes(rows.filter("field = 'vendor_name'").select("doc_id", "call_no", F.col("value").alias("note")), conflicts)


@query("a13_strict_token_sums", "select o_custkey as doc_id, case when count(n) = count(*) then sum(n) end as tokens from (select o_custkey, case when o_orderkey % 9 = 0 then null else o_orderkey % 100 end as n from orders) group by 1")
def _(spark, sf_dir):
    n = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey") % 100)
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), n.alias("n"))
    return rows.groupBy("doc_id").agg(merge.strict_sum("n").alias("tokens"))


@query("a16_probe_counts", "select doc_id, ((length(text) - length(replace(text, 'the', ''))) / 3)::int as text_0, ((length(text) - length(replace(text, 'License', ''))) / 7)::int as text_1 from documents")
def _(spark, sf_dir):
    return merge.probe_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), ("the", "License"), ("text",)).drop("text")


@query("p29_gold_check", duck.answers(synthetic.ANSWERS) + duck.GOLD)
def _(spark, sf_dir):
    results = merge.merge_scalars(synthetic.view(spark, sf_dir, synthetic.ANSWERS), ("call_no", "seq"))
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    rules = spark.sql("select * from values ('amount', 'equals', array('450')), ('vendor_name', 'contains', array('MUSTER', 'gmbh')), ('currency', 'any_of', array('EUR', 'CHF')), ('notice_period_value', 'excludes', array('1')) as t(field, kind, expected)")
    return merge.gold_check(results, docs.crossJoin(F.broadcast(rules))).select("doc_id", "field", "passed")


@query(
    "c19_findings",
    """select o_orderkey as doc_id, concat_ws(',', case when o_orderkey % 4 = 0 then 'amount_thousands_separator' end,
    case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then 'notice_without_value' end, case when o_orderkey % 5 = 0 and o_orderkey % 2 = 1 then 'renewal_without_period' end) as findings from orders""",
)
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(
        k.alias("doc_id"), F.when(k % 4 == 0, F.lit(1.234)).otherwise(F.lit(1234.5)).alias("amount"), F.when(k % 3 == 0, "three months").otherwise(" ").alias("notice_period"),
        F.when(k % 2 == 1, 3).alias("notice_period_value"), (k % 5 == 0).alias("auto_renewal"), F.when(k % 2 == 0, 12).alias("renewal_period_value"),
    )
    return merge.findings(rows).select("doc_id", F.array_join("findings", ",").alias("findings"))


# --- Files, calls, checks and reports ---------------------------------------------------------------------
@query(
    "s02_s07_magic_check",
    """with f as (select doc_id, case doc_id % 4 when 0 then 'pdf' when 1 then 'png' when 2 then 'txt' else 'exe' end as ext, case when doc_id % 3 = 0 then '%PDF-' || text else text end as body from documents)
    select doc_id, case when ext = 'exe' then 'unsupported_format' when ext = 'pdf' and not starts_with(body, '%PDF-') then 'invalid_file' when ext = 'png' then 'invalid_file' end as error_code from f""",
)
def _(spark, sf_dir):
    k = F.col("doc_id")
    ext = F.when(k % 4 == 0, "pdf").when(k % 4 == 1, "png").when(k % 4 == 2, "txt").otherwise("exe")
    body = F.when(k % 3 == 0, F.concat(F.lit("%PDF-"), "text")).otherwise(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", files.magic_error(body.cast("binary"), ext).alias("error_code"))


@query("s08_decode_text", "select doc_id, sha256(text) as digest from documents")
def _(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(BOM), "text")).otherwise(F.col("text")).cast("binary")
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(files.decode_text(raw).cast("binary"), 256).alias("digest"))


_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["amount", "currency"],
    "properties": {"amount": {"type": ["number", "null"], "minimum": 0}, "currency": {"type": ["string", "null"], "pattern": "^[A-Z]{3}$"}},
}


@query(
    "p23_schema_validity",
    """select o_orderkey as doc_id, concat_ws(',', case when o_orderkey % 4 = 0 then '$.currency: required' end,
    case when o_orderkey % 5 = 0 then '$.extra: additionalProperties' end, case when o_orderkey % 3 = 0 then '$.amount: minimum' end) as problems from orders""",
)
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.concat(
        F.lit('{"amount": '), F.when(k % 3 == 0, "-1").otherwise("1.5"), F.when(k % 4 != 0, ', "currency": "EUR"').otherwise(""),
        F.when(k % 5 == 0, ', "extra": 1').otherwise(""), F.lit("}"),
    )
    rows = _table(spark, sf_dir, "orders").select(k.alias("doc_id"), validate.invalid(raw, _SCHEMA).alias("p"))
    return rows.select("doc_id", F.array_join("p", ",").alias("problems"))


@query("c07_run_calls")
def _(spark, sf_dir):
    docs = lines.normalize(_contracts(spark, sf_dir))
    settings = planning.Settings(direct=800, target=800, chunk_target=600, supporting=200, head=200, tail=100)
    schema = {"type": "object", "properties": {f: {} for g in scoring.VARIANTS[4] for f in g.fields}}
    return runs.extract(docs, model.EchoClient(invalid_first=True), model.Profile("small", "echo"), schema, 1500, scoring.VARIANTS[4], settings)[1]


@query(
    "c22_corpus_report",
    """select coalesce(lang, 'all') as lang, coalesce(bucket, 'all') as bucket, count(*) as n, sum(n_chars)::bigint as chars from
    (select lang, n_chars, case when n_chars <= 8000 then 'direct' else 'reduced' end as bucket from documents) group by rollup (lang, bucket)""",
)
def _(spark, sf_dir):
    bucket = F.when(F.col("n_chars") <= 8000, "direct").otherwise("reduced").alias("bucket")
    rows = _table(spark, sf_dir, "documents").select("lang", bucket, "n_chars")
    done = rows.rollup("lang", "bucket").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return done.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("bucket", F.lit("all")).alias("bucket"), "n", "chars")


@query("st_windowed_events", "select time_bucket(interval '5 minutes', ts) as start, event_type, count(*) as n from events group by 1, 2")
def _(spark, sf_dir):
    return landing.windowed_counts(_table(spark, sf_dir, "events"), "ts", "event_type")


from corpusloom.plans import diagnosis, records, registries  # noqa: E402, F401  (register further queries)
