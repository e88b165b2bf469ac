"""Prompt blocks, request limits, access flags and run telemetry as column expressions and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators.merge import strict_sum

# --- Fixed values -----------------------------------------------------------------------------------------
NO_CONTEXT, NO_ASSISTANT_CONTEXT, NO_HISTORY = "(none provided)", "(no context provided)", "(no previous messages)"
MAX_INPUT, MAX_CLASSIFIED, CLASSIFICATION = 80_000, 20_000, "contract_document_classification"
MAX_CONTEXT, MAX_TURNS, MAX_TURN = 100_000, 8, 2_000
MAX_PROBES = 5
#: feature -> the service flag that grants it (ocr_fallback also asks for OCR).
FEATURES = (("extract_text", "documents"), ("convert_to_pdf", "documents"), ("ocr_fallback", "documents"), ("analyze", "ai"), ("prompt_lab", "prompt_lab"), ("assistant", "assistant"))
ABLATION, ABLATION_VERSION = "v3-output-first", "v3"
#: Durations that the calls of a run add up to.
DURATIONS = ("primary_ms", "repair_ms", "total_ms")
# ----------------------------------------------------------------------------------------------------------


def context_block(context: Column) -> Column:
    """map<string,string> -> a line for each entry, in order."""
    lines = F.transform(F.map_entries(context), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))))
    return F.when(F.coalesce(F.size(context), F.lit(0)) <= 0, NO_CONTEXT).otherwise(F.array_join(lines, "\n"))


def assistant_context(context: Column) -> Column:
    """map<string,string> as JSON, an entry a line, indented by two spaces."""
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    lines = F.transform(F.map_entries(context), lambda e: F.concat(F.lit("  "), quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    return F.when(F.coalesce(F.size(context), F.lit(0)) <= 0, NO_ASSISTANT_CONTEXT).otherwise(F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}")))


def with_history(requests: DataFrame, turns: DataFrame, most: int = MAX_TURNS) -> DataFrame:
    """Requests (conv_id, ...) with history, the last `most` turns of a conversation, oldest first."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    name = F.when(F.col("role") == "assistant", "Assistant").otherwise("User")
    rows = turns.withColumn("rn", last).filter(F.col("rn") <= most).select("conv_id", "turn", F.concat(name, F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
    blocks = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda r: r["line"]), "\n").alias("history"))
    return requests.join(blocks, "conv_id", "left").withColumn("history", F.coalesce("history", F.lit(NO_HISTORY)))


def output_first(template: Column) -> Column:
    """The trailing OUTPUT section before CONTEXT; null where the template has none to move."""
    body, output = F.split_part(template, F.lit("\n\nOUTPUT\n"), F.lit(1)), F.substr(template, F.instr(template, "\n\nOUTPUT\n") + 9)
    mark = "\nCONTEXT:\n"
    head, tail = F.substring_index(body, mark, 1), F.substr(body, F.instr(body, mark) + len(mark))
    moved = F.concat(head, F.lit("\nOUTPUT\n"), F.regexp_replace(output, t.exact(r"\s+$"), ""), F.lit("\n\nCONTEXT:\n"), tail, F.lit("\n"))
    return F.when((F.instr(template, "\n\nOUTPUT\n") > 0) & (F.instr(body, mark) > 0), moved)


def probe_contexts(text: Column, probe: str, width: int, most: int = MAX_PROBES) -> Column:
    """Up to `most` hits of a probe with width characters around each, line feeds shown."""
    pieces = F.slice(F.split(text, "\\Q" + probe + "\\E", -1), 1, most + 1)
    before = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x) + len(probe)) - len(probe)
    hits = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), before)
    cut = lambda at: F.substr(text, F.greatest(at - width, F.lit(0)) + 1, F.least(at, F.lit(width)) + len(probe) + width)
    found = F.transform(hits, lambda at: F.replace(cut(at), F.lit("\n"), F.lit(" ⏎ ")))
    return F.when(F.size(pieces) > 1, found).otherwise(F.array().cast("array<string>"))


def spec_version(spec: Column, draft: Column, default: str) -> Column:
    """A version is itself, the ablation its base, a draft what is given or the default."""
    return F.when(t.version_number(spec).isNotNull(), spec).when(spec == ABLATION, ABLATION_VERSION).otherwise(F.coalesce(draft, F.lit(default)))


def input_error(text: Column, mode: Column) -> Column:
    """P26."""
    most = F.when(mode == CLASSIFICATION, MAX_CLASSIFIED).otherwise(MAX_INPUT)
    return F.when(F.length(text) > most, "input_too_large")


def context_error(context_json: Column, turns: Column) -> Column:
    """The limits of an assistant's context and of its history, array<string>."""
    long = F.exists(turns, lambda x: F.length(x) > MAX_TURN)
    return F.when(F.length(context_json) > MAX_CONTEXT, "input_too_large").when(F.size(turns) > MAX_TURNS, "invalid_request").when(long, "input_too_large")


def bearer_key(header: Column) -> Column:
    """The key of an authorization header, null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(header, "(?is)^bearer (.*)$", 1)), F.lit(""))


def access_error(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """Requests (authorization, service) with client_id and error_code; clients (api_key, client_id, enabled, services array)."""
    rows = requests.withColumn("api_key", bearer_key(F.col("authorization"))).join(clients, "api_key", "left")
    error = F.when(~F.coalesce("enabled", F.lit(False)), "unauthorized").when(~F.array_contains("services", F.col("service")), "service_disabled")
    return rows.withColumn("error_code", error).withColumn("client_id", F.when(F.coalesce("enabled", F.lit(False)), F.col("client_id"))).drop("api_key", "enabled", "services")


def capabilities(services: Column, ocr: Column) -> Column:
    """C14: the features that a client's services grant, in order."""
    granted = [F.when(F.array_contains(services, s) & (ocr if f == "ocr_fallback" else F.lit(True)), f) for f, s in FEATURES]
    return F.array_compact(F.array(*granted))


def plan_stats(calls: DataFrame) -> DataFrame:
    """(doc_id, n_calls, sums) over the planned calls of each document."""
    sums = ("text_chars", "mandatory_chars", "supporting_chars", "passages", "dropped", "candidates")
    return calls.groupBy("doc_id").agg(F.count("*").alias("n_calls"), *(F.sum(c).alias(c) for c in sums))


def run_totals(calls: DataFrame) -> DataFrame:
    """Token totals (null unless every call's is known), durations and repairs of each run.

    One call's durations stay as they are; those of several are added up where known.
    """
    times = [F.when(F.count("*") == 1, F.first(c)).otherwise(F.round(F.sum(c), 1)).alias(c) for c in DURATIONS]
    tokens = [strict_sum(c).alias(f"{c}_total") for c in ("prompt_tokens", "output_tokens")]
    return calls.groupBy("doc_id").agg(F.count("*").alias("n_calls"), *tokens, *times, F.count_if(F.col("repair_ms").isNotNull()).alias("repairs"))


def ordered_distinct(domains: Column) -> Column:
    """U8."""
    return F.array_distinct(domains)
