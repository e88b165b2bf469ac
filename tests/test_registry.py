"""Prompts as files, write-once saving, constraints and metrics."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import integrity, scoring
from corpusloom.sources import metrics, registry


@pytest.fixture
def folders(tmp_path):
    base, runtime = tmp_path / "base", tmp_path / "run time"
    for name, content in {
        "letters/v1.txt": "base one {text}", "letters/v2.txt": "base two {text}", "letters/v10.txt": "ten {text}", "letters/w1.txt": "no", "letters/active.json": '{"version": "v10"}',
        "letters/schema.json": "{}", "letters/schema.v2.json": '{"least": 2}', "letters/schema.v9.json": '{"least": 9}', "talk/plain/v1.txt": "nested {text}", "Bad/v1.txt": "x",
    }.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    (runtime / "letters").mkdir(parents=True)
    (runtime / "letters/v2.txt").write_text("runtime two {text}\nwith a line")
    return str(base), str(runtime)


MODES = [("letters", "v1"), ("talk/plain", "v1"), ("nothing", "v1")]


def modes(spark):
    return spark.createDataFrame(MODES, "subdir string, default_version string")


def test_files_layers_schemas_and_pointers(spark, folders):
    files = registry.read_files(spark, *folders)
    got = {(r["subdir"], r["kind"], r["version"], r["min_version"], r["layer"]) for r in files.collect()}
    prompts = {("letters", "prompt", v, None, 1) for v in ("v1", "v2", "v10")} | {("letters", "prompt", "v2", None, 0), ("talk/plain", "prompt", "v1", None, 1)}
    assert got == prompts | {("letters", "schema", None, n, 1) for n in (0, 2, 9)}  # the base layer's pointer isn't read
    asked = spark.createDataFrame([("letters", "v2"), ("letters", "v1"), ("letters", "v11"), ("talk/plain", "v1"), ("letters", "v10")], "subdir string, version string")
    rows = {(r["subdir"], r["version"]): r for r in registry.prompt_of(files, asked).collect()}
    assert rows["letters", "v2"]["content"] == "runtime two {text}\nwith a line" and rows["letters", "v2"]["schema"] == '{"least": 2}'
    assert rows["letters", "v1"]["schema"] == "{}" and rows["letters", "v10"]["schema"] == '{"least": 9}'
    assert rows["letters", "v11"]["error_code"] == "unknown_prompt_version" and rows["talk/plain", "v1"]["schema"] is None
    assert registry.read_files(spark, *folders, subdirs=["talk/plain"]).count() == 1
    assert registry.read_files(spark, "/nowhere/a", "/nowhere/b").count() == 0


def test_saving_and_pointing(spark, folders):
    base, runtime = folders
    drafts = [("letters", "v3", "three {text} {{x}}"), ("letters", "v2", "again {text}"), ("letters", "v4", "a {other}"), ("letters", "x", "a"), ("letters", "v5", " \n"), ("letters", "v6", "y" * 41),
              ("letters", "v7", None), ("foreign", "v1", "a"), ("letters", "v8", "b"), ("letters", "v8", "a"), ("talk/plain", "v2", "ü {context_block}"), ("letters", "v9", "open {text"), (None, None, None)]
    saved = registry.save_versions(spark, spark.createDataFrame(drafts, "subdir string, version string, content string"), modes(spark), base, runtime, 40)
    got = sorted((str(r["subdir"]), str(r["version"]), str(r["error_code"])) for r in saved.collect())
    errors = {"v2": "prompt_version_exists", "v4": "invalid_prompt", "x": "invalid_prompt_version", "v5": "invalid_prompt", "v6": "prompt_too_large", "v7": "invalid_prompt", "v9": "invalid_prompt"}
    wanted = [("letters", v, e) for v, e in errors.items()] + [("letters", "v3", "None"), ("letters", "v8", "None"), ("letters", "v8", "prompt_version_exists")]
    assert got == sorted([*wanted, ("foreign", "v1", "unknown_mode"), ("talk/plain", "v2", "None"), ("None", "None", "unknown_mode")])
    registry.activate(spark, "letters", "v8", base, runtime)
    registry.activate(spark, "letters", "v3", base, runtime)
    with pytest.raises(ValueError, match="unknown_prompt_version"):
        registry.activate(spark, "letters", "v44", base, runtime)
    files = registry.read_files(spark, base, runtime)
    assert files.filter("version = 'v8' and kind = 'prompt'").first()["content"] == "a"
    listed = {r["subdir"]: (r["active"], r["versions"]) for r in registry.listing(files, modes(spark)).collect()}
    assert listed == {"letters": ("v3", ["v1", "v2", "v3", "v8", "v10"]), "talk/plain": ("v1", ["v1", "v2"]), "nothing": ("v1", [])}


@pytest.mark.parametrize("pointer", ["no json", "[]", '{"version": 3}', '{"version": "v99"}', "{}", ""])
def test_pointers_that_name_nothing_are_absent(spark, folders, tmp_path, pointer):
    base, runtime = folders
    registry.put(spark, f"{runtime}/letters/active.json", pointer, replace=True)
    listed = {r["subdir"]: r["active"] for r in registry.listing(registry.read_files(spark, base, runtime, ["letters"]), modes(spark)).collect()}
    assert listed["letters"] == "v1"


def test_of_many_writers_one_wins(spark, tmp_path):
    path = f"{tmp_path}/letters/v1.txt"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: registry.put(spark, path, f"writer {k} " * 500), range(40)))
    assert sum(won) == 1
    assert open(path).read() == f"writer {won.index(True)} " * 500
    assert [p.name for p in (tmp_path / "letters").iterdir()] == ["v1.txt"]


def test_specs(spark, folders, tmp_path):
    draft = tmp_path / "draft.txt"
    draft.write_text("draft {text}\n")
    files = registry.read_files(spark, *folders)
    built_in = {"v2-short": ("v2", F.substring("content", 1, 7))}
    rows = registry.resolve_specs(spark, files, "letters", ["v1", "v2", "v2-short", f"file:{draft}", "v77"], "v1", "v4", built_in).collect()
    got = {r["spec"]: (r["content"], r["source"], r["version"]) for r in rows}
    assert got["v1"] == ("base one {text}", "base", "v1") and got["v2"][1] == "runtime"
    assert got["v2-short"] == ("runtime", "ablation of v2, runtime", "v2")
    assert got[f"file:{draft}"] == ("draft {text}\n", "draft", "v4") and got["v77"][:2] == (None, None)


GOOD = {
    "profiles": ([("small", "ollama", "m", 60, 0.0, None), ("large", "ollama", "n", 90, 0.5, 4096)], "profile string, provider string, model string, timeout_seconds int, temperature double, context_window_tokens int"),
    "modes": ([("a", "a", "small", "v1")], "mode string, subdir string, default_profile string, default_version string"),
    "overrides": ([("c", "a", "large")], "client_id string, mode string, profile string"),
    "prompts": ([("a", "v1", 1)], "subdir string, version string, layer int"),
    "settings": ([("a", "budget", "100")], "mode string, key string, value string"),
    "known_keys": ([("budget", 1.0, None), ("ratio", 0.2, 1.0)], "key string, least double, most double"),
}


def registry_tables(spark, **changed):
    tables = {n: spark.createDataFrame(changed.get(n, rows), schema) for n, (rows, schema) in GOOD.items()}
    return tables | {"bounded_settings": integrity.bounded_settings(tables["settings"], tables["known_keys"])}


def test_registry_constraints(spark):
    rules = integrity.registry_constraints()
    integrity.enforce(registry_tables(spark), rules)
    bad = registry_tables(
        spark, profiles=[("small", "other", "", 0, -1.0, 2047), ("small", "ollama", None, None, 0.0, 2048)], modes=[("a", "a", "gone", "v2")], overrides=[("c", "b", "large"), ("d", "a", "")],
        settings=[("z", "budget", "0"), ("a", "ratio", "1.5"), ("a", "odd", "1"), ("a", "budget", "many")],
    )
    got = sorted((r["rule"], r["n"]) for r in integrity.violations(bad, rules).collect())
    wanted = "mode_profile mode_prompt override_mode override_named override_profile override_profile profile_provider profile_temperature profile_unique profile_window setting_key setting_mode"
    twice = [("profile_model", 2), ("profile_timeout", 2)]  # both rows share the key
    assert [g for g in got if g[0] != "setting_value"] == sorted([(w, 1 if w != "profile_unique" else 2) for w in wanted.split()] + twice)
    assert sum(g[0] == "setting_value" for g in got) == 3
    with pytest.raises(ValueError, match="config_error"):
        integrity.enforce(bad, rules)


#: The fields of the fourth contract schema.
SCHEMA_4 = (
    "vendor_name contact_person contract_type contract_number service_description start_date end_date is_open_ended notice_period notice_period_value notice_period_unit "
    "renewal_terms auto_renewal renewal_period_value renewal_period_unit amount currency payment_interval customer_name customer_address sites assets notes"
).split()


def test_groups_cover_the_schema(spark):
    """The fields of the groups and notes are those of the result schema, both ways."""
    fields = sorted({(f,) for g in scoring.VARIANTS[4] for f in g.fields})
    tables = {"groups": spark.createDataFrame([*fields, ("notes",)], "field string"), "schema": spark.createDataFrame([(f,) for f in SCHEMA_4], "name string")}
    rule = [integrity.SameSet("covered", "groups", ("field",), "schema", ("name",))]
    assert integrity.violations(tables, rule).count() == 0
    tables["schema"] = tables["schema"].filter(F.col("name") != fields[0][0]).union(spark.sql("select 'new'"))
    got = {(json.loads(r["key"])["field"], json.loads(r["key"])["missing_in"]) for r in integrity.violations(tables, rule).collect()}
    assert got == {(fields[0][0], "schema"), ("new", "groups")}


def test_metrics_take_no_texts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "secret", "direct"), (2, None, "chunked")], "n long, text string, strategy string")
    with pytest.raises(ValueError, match="text"):
        metrics.append_metrics(rows, f"{tmp_path}/m")
    with pytest.raises(ValueError, match="sample"):
        metrics.write_counted(rows, f"{tmp_path}/rows", {"sample": F.max("text")}, f"{tmp_path}/m", "x")
    assert not (tmp_path / "rows").exists()
    found = metrics.write_counted(rows, f"{tmp_path}/rows", {"n": F.count("*"), "chars": F.sum(F.length("text"))}, f"{tmp_path}/m", "first")
    assert found == {"n": 2, "chars": 6}
    metrics.write_counted(rows.limit(0), f"{tmp_path}/none", {"n": F.count("*"), "chars": F.sum(F.length("text"))}, f"{tmp_path}/m", "second")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/m").select("stage", "n", "chars").collect()} == {("first", 2, 6), ("second", 0, None)}
    with pytest.raises(Exception, match="label too long"):
        metrics.append_metrics(spark.createDataFrame([("x" * 65,)], "status string"), f"{tmp_path}/m")
    metrics.write_report(rows, f"{tmp_path}/report")
    assert {json.loads(r[0])["text"] for r in spark.read.text(f"{tmp_path}/report").collect()} == {"secret", None}
