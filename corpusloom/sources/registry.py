"""Prompts, schemas and pointers as files below a base and a runtime folder.

<folder>/<subdir>/vN.txt is a prompt, schema.json and schema.vN.json are its result schemas, active.json (runtime folder
alone) points to a version. A subdir has one segment or two. Files are read by Spark's own text scan, so any file system
that Spark reads will do, and only the folders of the subdirs asked for are listed.

Prompts are written once: each goes to a temporary name and then takes its own name only if that is free, which the file
system decides, so of several writers one wins and the others get prompt_version_exists. Readers see a file whole or not
at all. Pointers are replaced by one rename.

Defined cases: a folder or subdir that doesn't exist is empty; files of other names are left out; a pointer that is no
JSON object, or names no version, counts as absent; null or empty contents are invalid_prompt.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import routing

RUNTIME, BASE = 0, 1
MAX_CHARS = 32_000
#: Drafts of one call: they are written by the driver, one small file each.
MAX_DRAFTS = 1_000
PLACEHOLDERS = ("context_block", "text")
FILES = "subdir string, kind string, version string, min_version int, layer int, content string"


def _file_system(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, pattern: str) -> bool:
    path, fs = _file_system(spark, pattern)
    return bool(fs.globStatus(path))


def read_files(spark: SparkSession, base: str, runtime: str, subdirs: Iterable[str] | None = None) -> DataFrame:
    """(subdir, kind, version, min_version, layer, content); kind is prompt, schema or pointer.

    min_version: of a schema, the least prompt version that it is for (0: schema.json).
    """
    wanted = ["*", "*/*"] if subdirs is None else sorted(set(subdirs))
    parts = []
    for layer, root in ((RUNTIME, runtime), (BASE, base)):
        for depth in (1, 2):
            patterns = [f"{root.rstrip('/')}/{w}/*.{end}" for w in wanted if w.count("/") == depth - 1 for end in ("txt", "json")]
            patterns = [p for p in patterns if _exists(spark, p)]
            if patterns:
                rows = spark.read.option("recursiveFileLookup", "true").text(patterns, wholetext=True)
                steps = F.split(F.col("_metadata.file_path"), "/")
                rows = rows.select(F.array_join(F.slice(steps, -1 - depth, depth), "/").alias("subdir"), F.element_at(steps, -1).alias("name"), F.lit(layer).alias("layer"), F.col("value").alias("content"))
                parts.append(rows)
    if not parts:
        return spark.createDataFrame([], FILES)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    name = F.col("name")
    version = F.nullif(F.regexp_extract(name, r"^(v[1-9][0-9]*)\.txt$", 1), F.lit(""))
    least = F.when(name == "schema.json", 0).otherwise(t.version_number(F.nullif(F.regexp_extract(name, r"^schema\.(v[1-9][0-9]*)\.json$", 1), F.lit(""))))
    kind = F.when(version.isNotNull(), "prompt").when(least.isNotNull(), "schema").when((name == "active.json") & (F.col("layer") == RUNTIME), "pointer")
    named = F.when(kind == "pointer", F.get_json_object("content", "$.version")).otherwise(version)
    rows = rows.select("subdir", kind.alias("kind"), named.alias("version"), least.alias("min_version"), "layer", "content")
    return rows.filter(F.col("kind").isNotNull() & t.is_subdir(F.col("subdir")))


def listing(files: DataFrame, modes: DataFrame) -> DataFrame:
    """Modes (subdir, default_version) -> (subdir, active, versions): one row for each, in number order."""
    prompts, pointers = files.filter("kind = 'prompt'"), files.filter("kind = 'pointer'").select("subdir", "version")
    active = routing.active_versions(modes, pointers, prompts).withColumnRenamed("version", "active")
    return active.join(routing.list_versions(prompts), "subdir", "left").withColumn("versions", F.coalesce("versions", F.array().cast("array<string>")))


def prompt_of(files: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (subdir, version) with content, schema and error_code (unknown_prompt_version)."""
    prompts = routing.load_prompts(files.filter("kind = 'prompt'"))
    rows = requests.join(prompts, ["subdir", "version"], "left")
    schemas = files.filter("kind = 'schema'").groupBy("subdir", "min_version").agg(F.min_by("content", "layer").alias("schema"))
    schemas = schemas.groupBy("subdir").agg(F.sort_array(F.collect_list(F.struct("min_version", "schema")), asc=False).alias("schemas"))
    number = F.coalesce(t.version_number(F.col("version")), F.lit(0))
    fitting = F.filter("schemas", lambda s: s["min_version"] <= number)
    rows = rows.join(schemas, "subdir", "left").withColumn("schema", F.get(fitting, F.lit(0))["schema"]).drop("schemas")
    return rows.withColumn("error_code", F.when(F.col("content").isNull(), "unknown_prompt_version"))


def renderable(content: Column, names: Sequence[str] = PLACEHOLDERS) -> Column:
    """Whether a template has no braces but doubled ones and those around known names."""
    plain = F.regexp_replace(content, r"\{\{|\}\}|\{(" + "|".join(names) + r")\}", "")
    return ~plain.rlike(r"[{}]")


def checked_drafts(drafts: DataFrame, modes: DataFrame, files: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Drafts (subdir, version, content) with error_code, null where the draft may be saved.

    A version that exists in either layer is taken; of several drafts for one version the least content is the first.
    """
    rows = drafts.select("subdir", "version", "content").join(modes.select("subdir", F.lit(True).alias("known")), "subdir", "left")
    taken = files.filter("kind = 'prompt'").select("subdir", "version", F.lit(True).alias("taken")).distinct()
    rows = rows.join(taken, ["subdir", "version"], "left")
    content = F.coalesce("content", F.lit(""))
    error = (
        F.when(F.col("known").isNull(), "unknown_mode")
        .when(~renderable(content), "invalid_prompt")
        .when(t.version_number(F.coalesce("version", F.lit(""))).isNull(), "invalid_prompt_version")
        .when(~content.rlike(r"\S"), "invalid_prompt")
        .when(F.length(content) > max_chars, "prompt_too_large")
        .when(F.col("taken").isNotNull(), "prompt_version_exists")
    )
    # Equal drafts are counted first, so that many drafts for one version are partial sums, not one sorted group.
    keys = ["subdir", "version", "content", "error_code"]
    rows = rows.withColumn("error_code", error).groupBy(*keys).agg(F.count("*").cast("int").alias("copies"))
    firsts = rows.filter("error_code is null").groupBy("subdir", "version").agg(F.min("content").alias("first"))
    rows = rows.join(firsts, ["subdir", "version"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    again = F.col("error_code").isNull() & ((F.col("content") > F.col("first")) | (F.col("copy") > 1))
    return rows.select("subdir", "version", "content", F.when(again, "prompt_version_exists").otherwise(F.col("error_code")).alias("error_code"))


def put(spark: SparkSession, path: str, content: str, replace: bool = False) -> bool:
    """Write a small file whole under a temporary name, then rename; without replace False if the name is taken."""
    target, fs = _file_system(spark, path)
    fs.mkdirs(target.getParent())
    if fs.getUri().getScheme() == "file":
        # A local rename replaces what is there, so that a link has to decide.
        name = target.toUri().getPath()
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        with open(temporary, "x", encoding="utf-8", newline="") as out:
            out.write(content)
        if replace:
            os.replace(temporary, name)
            return True
        try:
            os.link(temporary, name)
        except FileExistsError:
            return False
        finally:
            os.unlink(temporary)
        return True
    jvm = spark.sparkContext._jvm
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, False)
    out.write(bytearray(content.encode("utf-8")))
    out.close()
    if replace:
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.valueOf("OVERWRITE")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(temporary, target, options)
        return True
    done = not fs.exists(target) and fs.rename(temporary, target)
    if not done:
        fs.delete(temporary, False)
    return done


def save_versions(spark: SparkSession, drafts: DataFrame, modes: DataFrame, base: str, runtime: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """Save what checked_drafts lets through; (subdir, version, error_code), one row for each draft.

    At most MAX_DRAFTS drafts a call (more raise before anything is written). Whoever writes a version first keeps it.
    """
    checked = checked_drafts(drafts, modes, read_files(spark, base, runtime), max_chars)
    # No content of a rejected draft comes to the driver; limit() bounds what does, before the size is known.
    rows = checked.withColumn("content", F.when(F.col("error_code").isNull(), F.col("content"))).limit(MAX_DRAFTS + 1).collect()
    if len(rows) > MAX_DRAFTS:
        raise ValueError(f"more than {MAX_DRAFTS} drafts")
    found = []
    for r in rows:
        error = r["error_code"]
        if error is None and not put(spark, f"{runtime.rstrip('/')}/{r['subdir']}/{r['version']}.txt", r["content"]):
            error = "prompt_version_exists"
        found.append((r["subdir"], r["version"], error))
    return spark.createDataFrame(found, "subdir string, version string, error_code string")


def activate(spark: SparkSession, subdir: str, version: str, base: str, runtime: str) -> None:
    """Point subdir to a version that exists in either layer."""
    files = read_files(spark, base, runtime, [subdir])
    if files.filter((F.col("kind") == "prompt") & (F.col("version") == version)).isEmpty():
        raise ValueError(f"unknown_prompt_version: {version}")
    put(spark, f"{runtime.rstrip('/')}/{subdir}/active.json", json.dumps({"version": version}), replace=True)


def resolve_specs(spark: SparkSession, files: DataFrame, subdir: str, specs: Sequence[str], default_version: str,
                  draft_version: str | None = None, built_in: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """(spec, content, source, version) for specs vN, file:PATH and built-in ablations; unknown ones have null content.

    version is the one whose schema and plan the spec runs with; built_in: name -> (version, expression over content).
    """
    built_in = built_in or {}
    prompts = files.filter((F.col("kind") == "prompt") & (F.col("subdir") == subdir))
    prompts = prompts.groupBy("version").agg(F.min_by("content", "layer").alias("content"), F.min("layer").alias("layer"))
    rows = [(s, built_in[s][0] if s in built_in else s) for s in specs if not s.startswith("file:")]
    named = spark.createDataFrame(rows, "spec string, version string").join(prompts, "version", "left")
    layer = F.when(F.col("layer") == RUNTIME, "runtime").when(F.col("layer") == BASE, "base")
    content, source = F.col("content"), layer
    for name, (version, changed) in built_in.items():
        content = F.when(F.col("spec") == name, changed).otherwise(content)
        source = F.when(F.col("spec") == name, F.concat(F.lit(f"ablation of {version}, "), layer)).otherwise(source)
    found = named.select("spec", content.alias("content"), source.alias("source"), "version")
    for spec in (s for s in specs if s.startswith("file:")):
        draft = spark.read.text(spec[5:], wholetext=True)
        found = found.union(draft.select(F.lit(spec), "value", F.lit("draft"), F.lit(draft_version or default_version)))
    return found
