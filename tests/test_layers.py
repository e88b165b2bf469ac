"""Folds, files, calls, checks and streams by small cases."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.functions import validate
from corpusloom.operators import lines, model, planning, routing, runs, scoring
from corpusloom.sources import files
from corpusloom.streaming import landing


def paragraphs(spark, rows):
    made = [(1, i, [(x, False) if x != "#" else ("", True) for x in p]) for i, p in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id long, para_no int, lines array<struct<line string, is_barrier boolean>>")


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (["Die Kündigungs-", "frist beträgt drei Monate."], ["Die Kündigungsfrist beträgt drei Monate."]),
        (["Service-", "Vertrag"], ["Service-Vertrag"]),
        (["EU-", "weit"], ["EU-weit"]),
        (["Wartungs-", "und Pflegearbeiten"], ["Wartungs- und Pflegearbeiten"]),
        (["short line", "goes on"], ["short line", "goes on"]),
        (["this line is long enough to be prose", "and goes on"], ["this line is long enough to be prose and goes on"]),
        (["A sentence that ends here, it really does.", "and another"], ["A sentence that ends here, it really does.", "and another"]),
        (["Der Auftragnehmer übernimmt die regelmäßige Wartung der", "Aufzugsanlagen des Auftraggebers."], ["Der Auftragnehmer übernimmt die regelmäßige Wartung der Aufzugsanlagen des Auftraggebers."]),
        (["this line is long enough to be prose", "#", "and goes on"], ["this line is long enough to be prose", "and goes on"]),
        (["a | b", "c | d"], ["a | b", "c | d"]),
    ],
)
def test_wraps(spark, given, want):
    assert lines.repair_wraps(paragraphs(spark, [given])).first()["lines"] == want


def test_normalize_removes_no_other_characters(spark):
    text = "Head\n\nzero​width and no break\nﬁnal\f\nSeite 2\n-----\nEnd"
    got = lines.normalize(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["normalized"]
    assert got == "Head\n\nzerowidth and no break\nfinal\n\nEnd"


def pages(*texts):
    return "\f".join("\n".join(x) for x in texts)


def test_page_edges_are_those_before_anything_goes(spark):
    # the bare number is the third line from the end: once it is gone, "same fourth" mustn't count as an edge
    text = pages(*(["top %d" % n, "a%d" % n, "b%d" % n, "body text %d" % n, "same fourth", str(n), "x%d" % n, "y%d" % n] for n in (1, 2, 3, 4)))
    got = lines.normalize(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["normalized"]
    assert got.count("same fourth") == 4 and "\n1\n" not in got and got.count("top") == 4


def test_headers_stay_once_and_are_never_glued(spark):
    sentence = "Diese Vereinbarung regelt die Wartung aller Anlagen und gilt für alle"
    text = pages(*(["Muster Liegenschaften und Wartung im Norden", "Zeile %d a." % n, "Zeile %d b." % n, "Zeile %d c." % n, "Zeile %d d." % n, sentence] for n in (1, 2, 3)))
    got = lines.normalize(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["normalized"]
    assert got.count("Muster Liegenschaften") == 1 and got.count(sentence) == 1
    open_ = pages(["Erste Zeile.", "Der Auftragnehmer übernimmt die regelmäßige Wartung der"], ["anlagen im ganzen Haus.", "Ende."])
    assert "Wartung der anlagen" in lines.normalize(spark.createDataFrame([(1, open_)], "doc_id long, text string")).first()["normalized"]
    marked = [(1, 0, 0, "a line that is long enough to go on", False, False), (1, 1, 0, "and here it does", False, True)]
    rows = spark.createDataFrame(marked, "doc_id long, page_no int, line_no int, line string, is_barrier boolean, is_repeated boolean")
    assert lines.join_pages(rows).count() == 3 and lines.join_pages(rows.drop("is_repeated")).count() == 2


def test_a_text_service_is_asked_once_a_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_bytes(b"short" if k else b"a text that is long enough to do without any OCR")
    log = tmp_path / "asked"

    def extract(content):
        with open(log, "a") as f:
            f.write("x")
        return content.decode()

    got = files.extract_text(files.read_files(spark, f"file://{tmp_path}/in"), extract, lambda c: c + b", now with the letters that OCR has found")
    assert {r["method"] for r in got.collect()} == {"text", "ocr"} and len(log.read_text()) == 3 + 2
    got = spark.createDataFrame([(b"a\x00b",), (b"ab",)], "c binary").select(files.magic_error(F.col("c"), F.lit("txt")).alias("e"))
    assert [r["e"] for r in got.collect()] == ["invalid_file", None]


def test_segments_cover_the_text():
    text = "§ 1 Title\n\n" + "word " * 400 + "\n\n" + "\n".join("line %d ends." % i for i in range(300)) + "\n\n" + "x" * 3000
    blocks = scoring.segment_text(text)
    assert all(0 < b - a <= scoring.MAX_BLOCK for a, b in blocks)
    assert "".join("".join(text[a:b].split()) for a, b in blocks) == "".join(text.split())
    assert text[slice(*blocks[0])].startswith("§ 1 Title")


def test_long_lines_are_cut_at_sentences_then_spaces_then_hard():
    sentences = " ".join("Satz %03d %s." % (i, "w" * 80) for i in range(40))
    spans = scoring.segment_text(sentences)
    assert all(b - a <= scoring.MAX_BLOCK and sentences[b - 1] == "." for a, b in spans)
    assert all(scoring.SPLIT_AT - 100 <= b - a <= scoring.SPLIT_AT for a, b in spans[:-1])
    assert scoring.segment_text("ab " * 1000)[0] == (0, 1397) and scoring.segment_text("y" * 3000) == [(0, 1400), (1400, 2800), (2800, 3000)]


def test_table_rows_stick_together_and_headings_pair_up():
    rows = "\n".join("a%02d | %s" % (i, "x" * 45) for i in range(40))
    spans = scoring.segment_text(rows)
    assert spans[0][1] > scoring.SPLIT_AT and spans[0][1] <= scoring.MAX_BLOCK and rows[spans[1][0]] == "a"
    text = "§ 1 One\n\n§ 2 Two\n\nbody\n\n3. Three\n\n" + "z" * 1395
    assert [text[a:b].split("\n")[0] for a, b in scoring.segment_text(text)] == ["§ 1 One", "body", "3. Three", "z" * 1395]


def test_choice_respects_limits():
    spans = [(i * 102, i * 102 + 100) for i in range(30)]
    flags, cost = [False] * 30, np.full(30, 102)
    table = planning.tiers(cost, flags, flags, flags, [20, 10, 5], {20, 10}, {20}, [5], 150, 90)
    chosen, required = planning.choose(spans, table, 1200, 900, 200)
    assert {0, 1, 20, 5, 29} <= set(np.flatnonzero(chosen)) and set(np.flatnonzero(required)) == {0, 1, 20, 5}
    start, end = np.array(spans).T
    assert planning.rendered_chars(chosen, start, end) <= 1200
    none, _ = planning.choose(spans, planning.tiers(cost, flags, flags, flags, [], set(), set(), [], 150, 90), 1200, 900, None)
    assert none[15]
    tight, kept = planning.choose(spans, table, 320, 900, None)  # labels push out what came last, never the head
    assert tight[:2].all() and planning.rendered_chars(tight, start, end) <= 320 and kept[0]


def test_rendered_length_is_that_of_the_rendered_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    spans = [(i * 100, i * 100 + 98) for i in range(10)]
    start, end = np.array(spans).T
    for places in ([0], [9], [0, 1, 5, 9], [3, 4], list(range(10))):
        mask = np.isin(np.arange(10), places)
        rows = spark.createDataFrame([(1, i, *spans[i], 10) for i in places], "doc_id long, block_no int, start int, end int, n_blocks int")
        done = scoring.render_runs(rows, spark.createDataFrame([(1, text[:998])], "doc_id long, normalized string")).first()["text"]
        assert planning.rendered_chars(mask, start, end) == len(done)


def test_templates_fill_in_one_pass(spark):
    row = spark.createDataFrame([("{b} stays", "B")], "a string, b string")
    assert row.select(routing.render("x {a} {b}", {"a": F.col("a"), "b": F.col("b")})).first()[0] == "x {b} stays B"
    with pytest.raises(ValueError, match="invalid_prompt"):
        routing.render("{other}", {})


def test_schema_checks():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": ["integer", "null"], "minimum": 1}, "l": {"type": "array", "maxItems": 1, "items": {"enum": ["x", None]}}}}
    good = ['{"a": 3.0}', '{"a": null, "l": ["x"]}']
    bad = {"[]": "$: json", '{"a": true}': "$.a: type", '{"a": 0}': "$.a: minimum", "{}": "$.a: required", '{"a": 1, "z": 1}': "$.z: additionalProperties", '{"a": 1, "l": ["y"]}': "$.l[0]: enum"}
    assert all(not validate.answer_problems(g, schema) for g in good)
    assert all(validate.answer_problems(raw, schema) == [p] for raw, p in bad.items())
    assert validate.audit(schema)["nullable"] == 1


def test_calls_repair_and_fall_back(spark):
    schema = {"type": "object", "properties": {"a": {}}}
    rows = [(1, 0, "x" * 3000, "short"), (2, 0, "tiny", None)]
    calls = spark.createDataFrame(rows, "doc_id long, call_no int, text string, reduced string")
    got = model.run_calls(calls, model.EchoClient(fail_over_chars=100), model.Profile("p", "m", 90), schema).orderBy("doc_id", "fallback").collect()
    assert [(r["doc_id"], r["fallback"], r["error_code"]) for r in got] == [(1, False, "ai_timeout"), (1, True, None), (2, False, None)]
    again = model.run_calls(calls.filter("doc_id = 2"), model.EchoClient(invalid_first=True), model.Profile("p", "m"), schema).orderBy("phase").collect()
    assert [(r["phase"], r["error_code"]) for r in again] == [("primary", "ai_invalid_response"), ("repair", None)]
    assert json.loads(again[1]["answer"]) == {"a": None}


def test_a_whole_run(spark):
    import re

    class Reader:
        """Answers with what the text says: the vendor, the amount and a note."""

        def generate(self, prompt, schema, profile, seconds):
            if len(prompt) > 6000:
                return model.Reply(error_code="ai_timeout")
            vendor, amount = re.search(r"Anbieter: (\w+)", prompt), re.search(r"Betrag: (\d+) EUR", prompt)
            answer = {"vendor_name": vendor and vendor[1], "amount": amount and int(amount[1]), "currency": "EUR" if amount else None, "notes": "gelesen"}
            return model.Reply(json.dumps(answer), metrics={"prompt_eval_count": 10, "eval_count": 3, "eval_duration": 2_000_000})

    short = "Anbieter: Muster\nBetrag: 450 EUR monatlich."
    filler = "\n\n".join(f"Absatz {k} ohne Belang, " + "der nur Platz braucht und sonst nichts sagt " * 8 for k in range(30))
    long = f"Anbieter: Muster\n\n{filler}\n\n§ 9 Vergütung\nBetrag: 900 EUR monatlich."
    broken = "x" * 7000
    docs = spark.createDataFrame([(1, short), (2, long), (3, broken)], "doc_id long, normalized string")
    schema = {"type": "object", "properties": {f: {} for f in ("vendor_name", "amount", "currency", "notes")}}
    fields, run = runs.extract(docs, Reader(), model.Profile("p", "m", 90), schema, 7000)
    got = {(r["doc_id"], r["field"]): r["value"] for r in fields.collect()}
    assert got[1, "vendor_name"] == "Muster" and got[1, "amount"] == "450" and got[1, "notes"] == "gelesen"
    assert got[2, "amount"] == "900" and got[2, "vendor_name"] == "Muster"
    told = {r["doc_id"]: r for r in run.collect()}
    assert told[1]["prompt_tokens_total"] == 10 and told[1]["total_ms"] == 2.0 and told[1]["conflicts"] == 0 and told[1]["error_code"] is None
    assert told[3]["error_code"] is None and told[3]["fell_back"] == 1 and told[3]["prompt_tokens_total"] is None  # the reduced text did
    assert got[3, "vendor_name"] is None and got[3, "notes"] == "gelesen"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Grüße und ein langer Text, der für sich genügt".encode())
    (tmp_path / "b.txt").write_bytes("Gr\xfc\xdfe \x80".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes(b"a" * 100)
    rows = files.read_files(spark, f"file://{tmp_path}", most=60)
    assert rows.filter("error_code = 'file_too_large' and content is null").count() == 1
    texts = {r[0] for r in rows.filter("error_code is null").select(files.decode_text(F.col("content"))).collect()}
    assert texts == {"Grüße und ein langer Text, der für sich genügt", "Grüße €"}
    got = files.extract_text(rows, lambda c: c.decode("cp1252"), lambda c: c + b" and thirty more letters from OCR, at last").collect()
    assert sorted(r["method"] or "" for r in got) == ["", "ocr", "text"]


def test_streams(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    docs.write.parquet(f"file://{tmp_path}/in")
    run = landing.clean_arrivals(spark, f"file://{tmp_path}/in", docs.schema, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", lambda b: b.select("doc_id", t.meaningful_chars(F.col("text")).alias("n")))
    run.awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 20


def test_money(spark):
    row = spark.createDataFrame([(1234.565, 0.5)], "a double, b double").select(t.german_money(F.col("a")), t.german_money(F.col("b"))).first()
    assert row[0].startswith("1.234,5") and row[1] == "0,50"


def test_nothing_else_imports_the_training_data_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "corpusloom"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "corpusloom.llm" in p.read_text()]


def test_guards_let_nothing_through(spark):
    """Texts and lines of every character that is cleaned, and of gaps and rules, come out as by the expressions without guards."""
    marks = [chr(c) for c in range(0x3100)] + [chr(c) for c in range(0xFB00, 0xFB10)] + ["\ufeff", "\U0001f600"]
    texts = spark.createDataFrame([(f"a{c}b",) for c in marks], "x string")
    plain = t.clean_characters(t.unify_line_ends(F.col("x")))
    assert texts.filter(~plain.eqNullSafe(t.clean_text(F.col("x")))).isEmpty()
    parts = ["", "a", "..", "._", ". ", "· ", "--", "-=", "\t", "  ", " ", "•", "**", "__", "."]
    lines_ = spark.createDataFrame([("".join(x),) for x in itertools.product(parts, repeat=4)], "x string")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("x", t.LEADER, "..."), t.RULE_RUN, "$1$1$1"), t.COLUMN_GAP, "  ")
    assert lines_.filter(F.trim(bare) != t.collapse_line(F.col("x"))).isEmpty()
    spaces = spark.createDataFrame([(f"a{c}b {c}{c} {c}",) for c in marks], "x string")
    assert spaces.filter(F.regexp_replace("x", t.exact(r"\s+"), " ") != t.squeeze(F.col("x"))).isEmpty()
    share = t.meaningful_chars(F.col("x"))
    noise = (F.length("x") > 0) & (F.translate("x", t.MEANINGFUL, "") == F.col("x")) & ((share == 0) | ((F.length("x") >= 6) & (share < F.lit(0.25) * F.length("x"))))
    for rows in (texts, lines_, spaces):
        assert rows.filter(~noise.eqNullSafe(t.is_symbol_noise(F.col("x")))).isEmpty()


def test_a_filter_does_not_collapse_lines_again(spark):
    docs = spark.createDataFrame([(1, "a  b")], "doc_id long, text string")
    rows = lines.clean_lines(lines.explode_lines(docs))
    assert rows.filter("length(line) > 2 and line <> 'x'")._jdf.queryExecution().optimizedPlan().toString().count(t.RULE_RUN[:6]) == 1


def test_folded_text_matches_where_the_text_matches_regardless_of_case(spark):
    """Patterns in lower case on the folded text find what they find regardless of case; the text is folded once, not for every literal."""
    words = ["PREIS", "Straße STRAẞE", "ſite", "Kunde", "KİNDE kınde", "GERÄTE-NR 5", "xkunde", "Kunde:", "ΣΑΣ ΣΑΣ", "ﬁnanz", "µ Μ", "5 EUR", "1.2.2024", "Mai 3, 2024", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(words)], "block_no int, chunk string")
    patterns = ("preis", r"\bkunde\b", "straße", "kinde", "kunde", r"ser|site", r"\bsite\b", r"geräte[- ]?nr\b", "σασ", "fi", "μ", scoring.AMOUNT, scoring.DATE, r"Σ\S\b")
    folded = rows.withColumn("f", t.fold_case(F.col("chunk")))
    got = folded.select("block_no", scoring._hits(patterns, "chunk", "f").alias("x")).collect()
    want = rows.select("block_no", F.array(*(F.col("chunk").rlike(t.folded(p)).cast("int") for p in patterns)).alias("x")).collect()
    assert dict(got) == dict(want)
    assert all(t.fold(w) == f for w, f in zip(words, (r.f for r in folded.orderBy("block_no").collect())) if w)
    plan = scoring.score(rows.withColumn("doc_id", F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 2


def test_one_pass_over_a_document_gives_what_the_chain_of_windows_gives(spark):
    """whole.normalize against the operators of lines.py, on odd lines put together at random and on contracts; stage by stage counts come from the same pass."""
    import random

    from corpusloom.operators import whole
    from corpusloom.sources import synthetic

    rnd = random.Random(5)
    some = [
        "Seite 1 von 3", "PAGE 4", "Blatt 2/3", "- 3 -", "12", "4 / 9", "12²", "ſeite 3", "§ 1 Laufzeit ....... 3", "1.2 Haftung . . . . . 7", "IV. Ende ... ٣", "§ 1 Laufzeit", "1.2 Haftung", "IV. Ende",
        "", "", "   ", "======", "_ _ x _ _ ~", "☐", "ab\tcd", "a | b | c", "1.234,56 €", "01.02.2024²", "monatlich.", "30 Tage", "ÄÖÜ GMBH", "Muster  Facility GmbH", "www.muster.de", "Die Kündigungs-",
        "frist beträgt drei Monate zum Ende", "und Nebenleistungen", "Der Auftragnehmer übernimmt die regelmäßige Wartung der", "Aufzugsanlagen des Auftraggebers im Gebäude und in allen Nebengebäuden.", "a) erstens", "Standort: Haus 3",
        "étude", "日本語の文", "Die Frist für die Zahlung der vereinbarten Vergütung beträgt 30", "Tage nach dem Zugang der Rechnung beim Auftraggeber im Haus.", "WICHTIGE HINWEISE FÜR ALLE, DIE IM GEBÄUDE ARBEITEN WOLLEN UND DER",
        "Das ist ein Satz, der lang genug ist, um geprüft zu werden.", "eur² 7", "İstanbul Seıte 2", "x́ seité 3", "ﬁnal   gap", "A-", "AB-", "CDE fg", "Zeile " + "lang " * 45,
    ]
    line = lambda: rnd.choice(some) if rnd.random() < 0.85 else "".join(rnd.choice("ab AB12.,-|:;!§€²́·_*#ßı \x85") for _ in range(rnd.randint(1, 40)))
    rows = [(9000, None), (9001, ""), (9002, "\f\f\n")]
    for k in range(600):
        pool, head, pages = [line() for _ in range(rnd.randint(2, 8))], line(), []
        for p in range(rnd.choice((1, 2, 3, 4, 6))):
            body = [rnd.choice(pool) if rnd.random() < 0.4 else line() for _ in range(rnd.randint(0, rnd.choice((6, 14, 40))))]
            pages.append("\n".join([*[head.replace("1", str(p + 1))] * (rnd.random() < 0.7), *body, *[rnd.choice((str(p + 3), f"{p + 1}/6", f"Seite {p + 1}"))] * (rnd.random() < 0.5)]))
        rows.append((k, "\f".join(pages)))
    odd = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for docs in (odd, synthetic.view(spark, "/root/testdata/sf0.001", synthetic.CONTRACTS)):
        want = {r["doc_id"]: r["normalized"] for r in lines.normalize_by_windows(docs).collect()}
        assert len(want) > 100 and {r["doc_id"]: r["normalized"] for r in whole.normalize(docs).collect()} == want


def test_scores_of_one_call_are_those_of_the_expressions(spark):
    """scoring.score against score_by_expressions: odd letters, headings, empty and null blocks, upper case."""
    import random

    rnd = random.Random(6)
    some = [
        "§ 1 Vertragsgegenstand", "VERTRAGSNUMMER: WV-12", "Kunden-Nr. 7", "kundennr²", "Die Laufzeit beträgt 12 Monate", "KÜNDIGUNGSFRIST", "Kündigungſfrist", "verlängert sich stillschweigend", "1.200,00 € netto", "€5", "chf 7", "monatlich fällig",
        "Standort : Haus", "Serien-Nr. SN-4", "Ser.-Nr. 8", "Aufzug", "GEBÄUDE", "Gebäudé", "01.02.2024", "1. März 2024", "March 3, 2024", "Ansprechpartner", "contract no 5", "S/N 4", "İnvoice", "Straße", "STRASSE", "end date", "notice period", "Rechnung²", "日本", "x",
    ]
    rows = [(0, 0, None), (1, 0, ""), (2, 0, "\n"), (3, 0, "Vertragspartner\n")]
    for k in range(400):
        rows.append((k, 1, rnd.choice(("\n", " ", ", ")).join(rnd.choice(some) for _ in range(rnd.randint(1, 9)))))
    blocks = spark.createDataFrame(rows, "doc_id long, block_no int, chunk string").repartition(4)
    for groups in scoring.VARIANTS.values():
        found, want = (f(blocks, groups) for f in (scoring.score, scoring.score_by_expressions))
        assert found.columns == want.columns
        key = lambda r: (r["doc_id"], r["block_no"], r["grp_no"])
        assert sorted(found.collect(), key=key) == sorted(want.collect(), key=key)
