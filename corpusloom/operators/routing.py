"""Questions to modes, by ordered keyword rules and domains; resolution of profiles, versions and schemas.

Rules and registries are small tables. Rules become one CASE expression, lookups broadcast joins of registry
tables, which hold a few rows for each mode or client that an operator of the system has configured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as t

# --- Fixed values: (rule, mode, keywords), highest priority first -----------------------------------------
RULES = (
    ("document_keywords", "document_question", ("dokument", "bericht", "rechnung", "beleg", "protokoll", "urkunde", "document", "report", "invoice", "receipt", "record")),
    ("contract_keywords", "contract_question", ("vertrag", "verträge", "vertraege", "kündigung", "kuendigung", "laufzeit", "contract", "termination", "expir")),
    ("inspection_keywords", "inspection_question", ("prüfung", "pruefung", "tüv", "tuev", "inspektion", "zertifikat", "inspection", "certificate", "certification")),
    ("maintenance_keywords", "maintenance_question", ("wartung", "instandhaltung", "service", "maintenance")),
    (
        "hotel_health_keywords",
        "hotel_health_summary",
        (
            "technischer zustand", "technischen zustand", "technisch da", "technisch aufgestellt", "gesamtzustand", "hotel gesund", "kritisch",
            "technical state", "technical condition", "hotel health", "how healthy", "critical issues",
        ),
    ),
)
DEFAULT_MODE = "general_hotel_question"
CROSS_MODE = "cross_domain_question"
#: domain -> (default mode, whether a document question may be answered by document_question).
DOMAINS = {
    "hotel_health": (None, False),
    "contracts": ("contract_question", True),
    "maintenance": ("maintenance_question", True),
    "inspections": ("inspection_question", True),
    "documents": ("document_question", False),
    "projects": (CROSS_MODE, False),
    "defects": (CROSS_MODE, False),
}
MAX_DOMAINS, MAX_QUESTION = 4, 5000
# ----------------------------------------------------------------------------------------------------------


def _any_of(question: Column, keywords: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in keywords:
        found = found | F.lower(question).contains(word)
    return found


def route(question: Column, rules=RULES) -> Column:
    """struct<mode, matched_rule> of the first rule with a keyword in the question."""
    answer = lambda mode, rule: F.struct(F.lit(mode).alias("mode"), F.lit(rule).alias("matched_rule"))
    out = None
    for name, mode, keywords in rules:
        hit = _any_of(question, keywords)
        out = F.when(hit, answer(mode, name)) if out is None else out.when(hit, answer(mode, name))
    return out.otherwise(answer(DEFAULT_MODE, "fallback"))


def route_with_domains(question: Column, domains: Column) -> Column:
    """Domains: array of distinct names; none or hotel_health alone routes by keywords."""
    struct = lambda mode, rule: F.struct(mode.alias("mode"), rule.alias("matched_rule"))
    out = F.when((F.size(domains) == 0) | ((F.size(domains) == 1) & (domains[0] == "hotel_health")), route(question))
    out = out.when(F.size(domains) > 1, struct(F.lit(CROSS_MODE), F.concat(F.lit("domains:"), F.array_join(domains, "+"))))
    document = _any_of(question, RULES[0][2])
    for name, (mode, allows) in DOMAINS.items():
        if allows:
            out = out.when((domains[0] == name) & document, struct(F.lit("document_question"), F.lit(f"domain:{name}+document_keywords")))
        out = out.when(domains[0] == name, struct(F.lit(mode or CROSS_MODE), F.lit(f"domain:{name}")))
    return out


def warmup_mode(domains: Column, fallback: str) -> Column:
    """C11: the mode that a conversation in these domains runs first."""
    out = F.when((F.size(domains) == 0) | ((F.size(domains) == 1) & (domains[0] == "hotel_health")), F.lit(fallback))
    out = out.when(F.size(domains) > 1, F.lit(CROSS_MODE))
    for name, (mode, _) in DOMAINS.items():
        out = out.when(domains[0] == name, F.lit(mode or CROSS_MODE))
    return out


def question_error(question: Column, domains: Column) -> Column:
    """An error code, or null."""
    names = F.array(*map(F.lit, DOMAINS))
    return (
        F.when(F.trim(F.coalesce(question, F.lit(""))) == "", "invalid_request")
        .when(F.length(question) > MAX_QUESTION, "input_too_large")
        .when(F.size(F.array_except(domains, names)) > 0, "invalid_request")
        .when(F.size(F.array_distinct(domains)) > MAX_DOMAINS, "invalid_request")
    )


def history_block(turns: DataFrame, most: int = 8) -> DataFrame:
    """(conv_id, history) of the last `most` turns, oldest first."""
    name = F.when(F.col("role") == "assistant", "Assistant").otherwise("User")
    line = F.concat(name, F.lit(": "), F.coalesce("text", F.lit("")))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("rows"))
    last = F.slice("rows", F.greatest(F.lit(1), F.size("rows") - most + 1), most)
    return grouped.select("conv_id", F.array_join(F.transform(last, lambda r: r["line"]), "\n").alias("history"))


def render(template: str, values: dict[str, Column]) -> Column:
    """The template with {name} placeholders filled in one pass; unknown placeholders raise."""
    import re

    parts: list[Column] = []
    for k, piece in enumerate(re.split(r"\{([a-z_]+)\}", template)):
        if k % 2 and piece not in values:
            raise ValueError(f"invalid_prompt: {piece}")
        parts.append(values[piece] if k % 2 else F.lit(piece))
    return F.concat(*parts)


def resolve_profiles(requests: DataFrame, clients: DataFrame, modes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requests (api_key, mode) with client_id, profile and error_code; a client's own choice wins, no other fallback."""
    rows = requests.join(clients, "api_key", "left").join(modes, "mode", "left")
    choice = F.coalesce(F.try_element_at("model_overrides", F.col("mode")), F.col("default_profile"))
    rows = rows.withColumn("profile", choice)
    known = profiles.select(F.col("profile"), F.lit(True).alias("known"))
    rows = rows.join(known, "profile", "left")
    error = (
        F.when(F.col("client_id").isNull(), "unauthorized")
        .when(~F.col("enabled"), "client_disabled")
        .when(F.col("default_profile").isNull(), "unknown_mode")
        .when(F.col("known").isNull(), "model_profile_unavailable")
    )
    return rows.withColumn("error_code", error).drop("known")


def active_versions(modes: DataFrame, active: DataFrame, versions: DataFrame) -> DataFrame:
    """(subdir, version): the runtime pointer where it names an existing version, else the mode's default."""
    real = active.join(versions.select("subdir", "version").distinct(), ["subdir", "version"], "left_semi")
    chosen = modes.select("subdir", "default_version").join(real, "subdir", "left")
    return chosen.select("subdir", F.coalesce("version", "default_version").alias("version"))


#: Schemas of one mode, which every version is compared with.
MAX_SCHEMAS = 1_000


def schema_as_of(versions: DataFrame, schemas: DataFrame) -> DataFrame:
    """(version, schema): the schema of the greatest least version that isn't above; other names take the base schema.

    At most MAX_SCHEMAS schemas, counted before they are broadcast.
    """
    if schemas.limit(MAX_SCHEMAS + 1).count() > MAX_SCHEMAS:
        raise ValueError(f"more than {MAX_SCHEMAS} schemas")
    rows = versions.withColumn("v", F.coalesce(t.version_number(F.col("version")), F.lit(0)))
    joined = rows.join(F.broadcast(schemas), F.col("v") >= F.col("min_version"))
    return joined.groupBy("version").agg(F.max_by("schema", "min_version").alias("schema"))


def list_versions(versions: DataFrame) -> DataFrame:
    """(subdir, versions): the distinct valid names of all layers in number order."""
    rows = versions.select("subdir", "version", t.version_number(F.col("version")).alias("n")).filter("n is not null").distinct()
    grouped = rows.groupBy("subdir").agg(F.sort_array(F.collect_list(F.struct("n", "version"))).alias("v"))
    return grouped.select("subdir", F.col("v.version").alias("versions"))


def load_prompts(versions: DataFrame) -> DataFrame:
    """(subdir, version, content): the runtime layer (0) shadows the base layer (1)."""
    return versions.groupBy("subdir", "version").agg(F.min_by("content", "layer").alias("content"))
