"""Further queries: prompt blocks, limits, telemetry and planted lines, and the SQL that gives the same rows."""

from __future__ import annotations

from itertools import islice

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import lines, model, planning, prompts, scoring
from corpusloom.plans import duck
from corpusloom.plans.catalogue import _digest, _table, query
from corpusloom.sources import files, synthetic

_ODD = "\u200b"
#: Lines with every kind of character that cleaning changes.
_DIRTY = (
    f"select c_custkey as doc_id, concat('o{_ODD}dd\u00a0{chr(0x2003)}', c_name, '\ufb01n\ufb00e \ufb03x', case when c_custkey % 2 = 0 then '\r\n' else '\u2028' end, 'next\u00ad line', '\ufeff', case when c_custkey % 3 = 0 then '\x0b' else '\x7f' end, 'end') as text from customer"
)


@query(
    "n01_n04_clean_characters",
    f"""with d as ({_DIRTY}), a as (select doc_id, regexp_replace(text, '\\r\\n|[\\r\\x0b]|\u0085|\u2028|\u2029', chr(10), 'g') as x from d),
    b as (select doc_id, regexp_replace(x, '[\u200b\u00ad\ufeff\\x7f]', '', 'g') as x from a)
    select doc_id, sha256(replace(replace(replace(replace(translate(x, '\u00a0\u2003', '  '), '\ufb01', 'fi'), '\ufb00', 'ff'), '\ufb03', 'ffi'), '\ufb02', 'fl')) as digest from b""",
)
def _(spark, sf_dir):
    rows = synthetic.view(spark, sf_dir, _DIRTY)
    return rows.select("doc_id", F.sha2(t.clean_characters(t.unify_line_ends(F.col("text"))).cast("binary"), 256).alias("digest"))


_MARKED = "select c_custkey as doc_id, concat(case c_custkey % 5 when 0 then 'a) ' when 1 then 'iv. ' when 2 then '(a) ' when 3 then 'xx) ' else 'A) ' end, c_name) as text from customer"


@query("p10_list_marker", f"with d as ({_MARKED}) select doc_id, text from d where regexp_matches(text, '^(?:[a-z]|[ivx]{{1,4}})[).]\\s')")
def _(spark, sf_dir):
    return synthetic.view(spark, sf_dir, _MARKED).filter(t.is_list_marker(F.col("text"))).select("doc_id", "text")


@query("p14_heading_only", f"with d as ({_MARKED}), h as (select doc_id, case doc_id % 4 when 0 then '§ 7 ' when 1 then '2.1 ' else '' end || text as text from d) select doc_id from h where length(text) <= 80 and regexp_matches(text, {duck.quoted('(?i)' + t.HEADING_START)})")
def _(spark, sf_dir):
    k = F.col("doc_id") % 4
    rows = synthetic.view(spark, sf_dir, _MARKED).withColumn("text", F.concat(F.when(k == 0, "§ 7 ").when(k == 1, "2.1 ").otherwise(""), "text"))
    alone = (F.length("text") <= scoring.HEADING_CHARS) & (F.instr("text", "\n") == 0) & t.is_heading_start(F.col("text"))
    return rows.filter(alone).select("doc_id")


_WRAPPED = """select c_custkey as doc_id, concat('Vertrag ', case c_custkey % 4 when 0 then 'gilt' when 1 then 'Der' when 2 then '30' else 'Nord' end) as line,
  case c_custkey % 3 when 0 then 'Tage.' when 1 then 'Haus' else 'Monate, dann' end as following from customer"""


@query(
    "p12_ends_mid_sentence",
    f"""with d as ({_WRAPPED}), w as (select doc_id, split_part(line, ' ', 2) as w, rtrim(split_part(following, ' ', 1), '.,;') as u from d)
    select doc_id from w where regexp_matches(w, '^[a-zäöüß][A-Za-zÄÖÜäöüß]*$') or w in ({", ".join(map(duck.quoted, t.ARTICLES))})
    or (regexp_matches(w, '^\\d[\\d.,]*$') and u in ({", ".join(map(duck.quoted, t.UNIT_WORDS))}))""",
)
def _(spark, sf_dir):
    return synthetic.view(spark, sf_dir, _WRAPPED).filter(t.ends_mid_sentence(F.col("line"), F.col("following"))).select("doc_id")


_REPEATING = "select c_custkey as doc_id, concat(%s) as text from customer" % ", chr(10), ".join(
    f"concat('Objekt Nord ', case when c_custkey % 4 = 0 then '{n}' else '' end, chr(10), 'Text {n} ', repeat('w', case when c_custkey % 3 = 0 then 300 else 1200 end), ' ende.')" for n in range(4)
)


@query("w06_planted_repeats", duck.lines(_REPEATING) + duck.REPEATS + duck.digest("kept"))
def _(spark, sf_dir):
    return _digest(lines.drop_repeats(lines.clean_lines(lines.explode_lines(synthetic.view(spark, sf_dir, _REPEATING)))))


@query("a03_repeat_gaps", duck.lines(_REPEATING) + duck.REPEATS + "select doc_id, count(*) as dropped from gp_dropped group by 1".replace("gp_dropped", "(select * from ag where key is not null and n >= 3 and least >= 1000 and rn > 1)"))
def _(spark, sf_dir):
    rows = lines.clean_lines(lines.explode_lines(synthetic.view(spark, sf_dir, _REPEATING)))
    kept = lines.drop_repeats(rows).groupBy("doc_id").agg(F.count("*").alias("kept"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(kept, "doc_id").filter("n > kept").select("doc_id", (F.col("n") - F.col("kept")).alias("dropped"))


@query("n26_german_money", "select o_orderkey, translate(format('{:,.2f}', o_totalprice), ',.', '.,') as shown from orders")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", t.german_money(F.col("o_totalprice")).alias("shown"))


@query("n29_milliseconds", "select event_id, round_even(value * 1000 / 1000000::double, 1) as ms from events where value is not null")
def _(spark, sf_dir):
    @F.pandas_udf("double")
    def milliseconds(nanoseconds: pd.Series) -> pd.Series:
        return nanoseconds.map(model.milliseconds)

    return _table(spark, sf_dir, "events").filter("value is not null").select("event_id", milliseconds(F.col("value") * 1000).alias("ms"))


@query("n30_n31_call_seconds", "select p_partkey, least(greatest(p_size * 5, 120), 180) as warmup, case when 90 - p_size * 2 > 0 then least(60, 90 - p_size * 2) end as bound, case when 90 - p_size * 2 <= 0 then 'ai_timeout' end as error_code from part")
def _(spark, sf_dir):
    left = 90 - F.col("p_size") * 2
    warm = F.least(F.greatest(F.col("p_size") * 5, F.lit(120)), F.lit(180))
    bound, error = F.when(left > 0, F.least(F.lit(60), left)), F.when(left <= 0, "ai_timeout")
    return _table(spark, sf_dir, "part").select("p_partkey", warm.alias("warmup"), bound.alias("bound"), error.alias("error_code"))


_NAMES = "case p_partkey % 6 when 0 then 'contracts' when 1 then 'contracts/v2' when 2 then '../etc' when 3 then 'a/b/c' when 4 then 'Upper' else 'under_score/x_1' end"


@query("p25_subdirs", f"select p_partkey, {_NAMES} as name from part where regexp_matches({_NAMES}, '^[a-z0-9_]+(/[a-z0-9_]+)?$')")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", F.expr(_NAMES).alias("name")).filter(t.is_subdir(F.col("name")))


@query("p19_direct", "select doc_id, length(text) <= 8000 and length(text) <= 5200 as direct from documents")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", planning.goes_direct("text", 5200).alias("direct"))


@query("p21_fallback_possible", "select doc_id, length(text) >= 2000 and (doc_id % 90) * 0.35::double >= 15 as possible from documents")
def _(spark, sf_dir):
    @F.pandas_udf("boolean")
    def possible(chars: pd.Series, seconds: pd.Series) -> pd.Series:
        return pd.Series([model.fallback_possible(c, model.Profile("p", "m", s)) for c, s in zip(chars, seconds)], dtype="boolean")

    return _table(spark, sf_dir, "documents").select("doc_id", possible(F.length("text"), F.col("doc_id") % 90).alias("possible"))


_EXT = "case doc_id % 5 when 0 then 'pdf' when 1 then 'png' when 2 then 'txt' when 3 then 'docx' else 'exe' end"


@query("j12_converter_routes", f"select doc_id, {_EXT} as ext, case {_EXT} {' '.join(f'when {duck.quoted(k)} then {duck.quoted(v[1])}' for k, v in files.FORMATS.items())} end as route from documents")
def _(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_EXT).alias("ext"))
    return rows.withColumn("route", files.converter_route(F.col("ext")))


@query("w17_even_places", "select p_partkey, string_agg(floor(p_size * k / d)::int::varchar, ',' order by d, k) as places from part, (values (1, 2.0), (1, 4.0), (3, 4.0), (1, 8.0), (3, 8.0), (5, 8.0), (7, 8.0)) s(k, d) group by 1")
def _(spark, sf_dir):
    def places(batches):
        for rows in batches:
            rounds = [islice(planning.even_rounds(n), 3) for n in rows["p_size"]]
            yield rows[["p_partkey"]].assign(places=[",".join(str(unit[0][0]) for tries in r for _, unit in tries) for r in rounds])

    return _table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInPandas(places, "p_partkey long, places string")


@query("n16_n18_context_blocks", """select c_custkey, case when c_custkey % 4 = 0 then '(none provided)' else 'document_type: ' || c_mktsegment || chr(10) || 'name: ' || c_name end as extraction,
  case when c_custkey % 4 = 0 then '(no context provided)' else '{' || chr(10) || '  "document_type": ' || to_json(c_mktsegment)::varchar || ',' || chr(10) || '  "name": ' || to_json(c_name || ' "ü"')::varchar || chr(10) || '}' end as assistant from customer""")
def _(spark, sf_dir):
    none = F.create_map().cast("map<string,string>")
    context = lambda name: F.when(F.col("c_custkey") % 4 == 0, none).otherwise(F.create_map(F.lit("document_type"), "c_mktsegment", F.lit("name"), name))
    return _table(spark, sf_dir, "customer").select("c_custkey", prompts.context_block(context(F.col("c_name"))).alias("extraction"), prompts.assistant_context(context(F.concat("c_name", F.lit(' "ü"')))).alias("assistant"))


_ASK = "Context:\n{context_block}\nEarlier:\n{history_block}\nQuestion: {question}"


@query(
    "n19_n20_assistant_prompts",
    f"""with r as (select conv_id, turn, case when role = 'assistant' then 'Assistant' else 'User' end || ': ' || coalesce(text, '') as line, row_number() over (partition by conv_id order by turn desc) as rn from conversations),
    h as (select conv_id, string_agg(line, chr(10) order by turn) as history from r where rn <= 8 group by 1)
    select c_custkey as conv_id, sha256({duck.rendered(_ASK, {"context_block": "'(no context provided)'", "history_block": "coalesce(history, '(no previous messages)')", "question": "c_name"})}) as digest
    from customer left join h on c_custkey = conv_id""",
)
def _(spark, sf_dir):
    from corpusloom.operators import routing

    asked = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("conv_id"), "c_name")
    rows = prompts.with_history(asked, _table(spark, sf_dir, "conversations"))
    values = {"context_block": F.lit(prompts.NO_ASSISTANT_CONTEXT), "history_block": F.col("history"), "question": F.col("c_name")}
    return rows.select("conv_id", F.sha2(routing.render(_ASK, values).cast("binary"), 256).alias("digest"))


_TEMPLATES = "case when p_partkey % 3 = 0 then 'no sections' else 'TASK ' || p_name || chr(10) || 'CONTEXT:' || chr(10) || '{context_block} TEXT {text}' || chr(10) || chr(10) || 'OUTPUT' || chr(10) || 'json ' || p_partkey || '  ' || chr(10) end"


@query("n27_output_first", f"select p_partkey, case when p_partkey % 3 <> 0 then 'TASK ' || p_name || chr(10) || 'OUTPUT' || chr(10) || 'json ' || p_partkey || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || '{{context_block}} TEXT {{text}}' || chr(10) end as moved from part")
def _(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_TEMPLATES).alias("template"))
    return rows.select("p_partkey", prompts.output_first(F.col("template")).alias("moved"))


@query(
    "n28_k05_probe_contexts",
    """with recursive p as (select doc_id, text, string_split(text, ' the ') as x from documents), h as (select doc_id, text, x, unnest(range(1, least(len(x), 6))) as i from p),
    o as (select doc_id, text, i, list_sum(list_transform(x[1:i], lambda y: length(y) + 5))::bigint - 5 as place from h)
    select doc_id, i as hit, replace(substr(text, greatest(place - 20, 0) + 1, least(place, 20) + 25), chr(10), ' ⏎ ') as context from o""",
)
def _(spark, sf_dir):
    found = prompts.probe_contexts(F.col("text"), " the ", 20)
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("hit", "context"))
    return rows.select("doc_id", (F.col("hit") + 1).cast("long").alias("hit"), "context")


_SPEC = "case p_partkey % 4 when 0 then 'v' || p_size when 1 then 'v3-output-first' when 2 then 'file:draft.txt' else 'file:other' end"


@query("n32_spec_versions", f"select p_partkey, case p_partkey % 4 when 0 then 'v' || p_size when 1 then 'v3' when 2 then 'v4' else 'v2' end as version from part")
def _(spark, sf_dir):
    draft = F.when(F.col("p_partkey") % 4 == 2, "v4")
    return _table(spark, sf_dir, "part").select("p_partkey", prompts.spec_version(F.expr(_SPEC), draft, "v2").alias("version"))


@query("p26_input_limits", "select doc_id, case when length(text) * 10 > case when doc_id % 2 = 0 then 20000 else 80000 end then 'input_too_large' end as error_code from documents")
def _(spark, sf_dir):
    mode = F.when(F.col("doc_id") % 2 == 0, prompts.CLASSIFICATION).otherwise("contract_extraction")
    return _table(spark, sf_dir, "documents").select("doc_id", prompts.input_error(F.repeat("text", F.lit(10)), mode).alias("error_code"))


@query(
    "p27_context_and_history_limits",
    """with c as (select conv_id, count(*) as n, max(length(coalesce(text, '')) * case when conv_id % 3 = 0 then 8 else 1 end) as longest, sum(length(coalesce(text, ''))) * 40 as context from conversations group by 1)
    select conv_id, case when context > 100000 then 'input_too_large' when n > 8 then 'invalid_request' when longest > 2000 then 'input_too_large' end as error_code from c""",
)
def _(spark, sf_dir):
    turn = F.repeat(F.coalesce("text", F.lit("")), F.when(F.col("conv_id") % 3 == 0, 8).otherwise(1))
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(turn).alias("turns"), F.repeat(F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), ""), F.lit(40)).alias("context"))
    return rows.select("conv_id", prompts.context_error(F.col("context"), F.col("turns")).alias("error_code"))


_HEADER = "case c_custkey % 6 when 0 then 'Bearer k1' when 1 then 'bearer  k2 ' when 2 then 'Basic k1' when 3 then 'BEARER k3' when 4 then 'Bearer ' else null end"


@query(
    "p30_access",
    """select c_custkey, case c_custkey % 6 when 0 then 'a' when 1 then 'b' end as client_id,
    case when c_custkey % 6 > 1 then 'unauthorized' when c_custkey % 6 = 0 and c_custkey % 4 = 2 then 'service_disabled' when c_custkey % 6 = 1 and c_custkey % 4 <> 1 then 'service_disabled' end as error_code from customer""",
)
def _(spark, sf_dir):
    clients = spark.sql("select * from values ('k1', 'a', true, array('documents', 'ai', 'x')), ('k2', 'b', true, array('ai')), ('k3', 'c', false, array('ai')) as t(api_key, client_id, enabled, services)")
    service = F.element_at(F.array(*map(F.lit, ("documents", "ai", "assistant", "x"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    asked = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_HEADER).alias("authorization"), service.alias("service"))
    return prompts.access_error(asked, clients).select("c_custkey", "client_id", "error_code")


@query("c14_capabilities", """select c_custkey, concat_ws(',', case when c_custkey % 2 = 0 then 'extract_text' end, case when c_custkey % 2 = 0 then 'convert_to_pdf' end, case when c_custkey % 6 = 0 then 'ocr_fallback' end,
  case when c_custkey % 5 < 2 then 'analyze' end, case when c_custkey % 7 = 0 then 'prompt_lab' end, case when c_custkey % 3 = 1 then 'assistant' end) as features from customer""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    services = F.array_compact(F.array(F.when(k % 2 == 0, "documents"), F.when(k % 5 < 2, "ai"), F.when(k % 7 == 0, "prompt_lab"), F.when(k % 3 == 1, "assistant")))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.array_join(prompts.capabilities(services, k % 3 == 0), ",").alias("features"))


@query("a09_plan_stats", """select l_orderkey as doc_id, count(*) as n_calls, sum(l_partkey)::bigint as text_chars, sum(l_suppkey)::bigint as mandatory_chars, sum(l_partkey - l_suppkey)::bigint as supporting_chars,
  sum(l_linenumber)::bigint as passages, sum(l_linenumber % 2)::bigint as dropped, sum(l_linenumber * 2)::bigint as candidates from lineitem group by 1""")
def _(spark, sf_dir):
    calls = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("text_chars"), F.col("l_suppkey").alias("mandatory_chars"), (F.col("l_partkey") - F.col("l_suppkey")).alias("supporting_chars"),
        F.col("l_linenumber").alias("passages"), (F.col("l_linenumber") % 2).alias("dropped"), (F.col("l_linenumber") * 2).alias("candidates"),
    )
    return prompts.plan_stats(calls)


@query(
    "a14_a15_a18_run_totals",
    """with c as (select l_orderkey as doc_id, case when l_partkey % 7 > 0 then l_partkey end as p, case when l_suppkey % 11 > 0 then l_suppkey end as o, l_partkey % 50 + 0.5::double as m, case when l_linenumber % 3 = 0 then 2.25::double end as r from lineitem)
    select doc_id, count(*) as n_calls, case when count(p) = count(*) then sum(p)::bigint end as prompt_tokens_total, case when count(o) = count(*) then sum(o)::bigint end as output_tokens_total,
    sum(m) as primary_ms, case when count(*) = 1 then min(r) else round(sum(r), 1) end as repair_ms, sum(m) as total_ms, count(r) as repairs from c group by 1""",
)
def _(spark, sf_dir):
    primary = F.col("l_partkey") % 50 + F.lit(0.5)
    calls = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_partkey") % 7 > 0, F.col("l_partkey")).alias("prompt_tokens"), F.when(F.col("l_suppkey") % 11 > 0, F.col("l_suppkey")).alias("output_tokens"),
        primary.alias("primary_ms"), F.when(F.col("l_linenumber") % 3 == 0, F.lit(2.25)).alias("repair_ms"), primary.alias("total_ms"),
    )
    return prompts.run_totals(calls)


@query("u08_ordered_domains", f"with q as ({synthetic.QUESTIONS}), d as (select question_id, unnest(string_split(domains || ',' || domains, ',')) as x, generate_subscripts(string_split(domains || ',' || domains, ','), 1) as i from q), f as (select question_id, x, min(i) as i from d where x <> '' group by 1, 2) select question_id, string_agg(x, ',' order by i) as domains from f group by 1")
def _(spark, sf_dir):
    rows = synthetic.view(spark, sf_dir, synthetic.QUESTIONS)
    twice = F.filter(F.split(F.concat("domains", F.lit(","), "domains"), ","), lambda d: d != "")
    return rows.select("question_id", F.array_join(prompts.ordered_distinct(twice), ",").alias("domains")).filter("domains <> ''")


@query("s08_code_page", "select doc_id, case when doc_id % 2 = 0 then 'Grüße \u20ac ' || doc_id else 'Größe ' || doc_id end as text from documents")
def _(spark, sf_dir):
    old = F.concat(F.unhex(F.lit("4772FCDF6520")), F.unhex(F.lit("8020")), F.col("doc_id").cast("string").cast("binary"))
    new = F.concat(F.lit("Größe "), F.col("doc_id").cast("string")).cast("binary")
    return _table(spark, sf_dir, "documents").select("doc_id", files.decode_text(F.when(F.col("doc_id") % 2 == 0, old).otherwise(new)).alias("text"))
