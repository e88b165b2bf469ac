"""Synthetic corpora built from the star schema, in SQL that Spark and DuckDB both read.

One contract, one question and one model answer for each customer, so their number grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NL = "chr(10)"


def _lines(*parts: str) -> str:
    """A SQL expression: the parts joined by line feeds."""
    return "concat(" + ", chr(10), ".join(parts) + ")"


_HEAD = "concat('Muster Facility GmbH - ', n_name)"
_K = "c_custkey"
_PAGES = [
    _lines(
        _HEAD, "'Wartungsvertrag'", "''", "'§ 1 Vertragsgegenstand .......... 1'", "'§ 2 Laufzeit und Kündigung .......... 2'", "'§ 3 Vergütung .......... 2'",
        "''", "'§ 1 Vertragsgegenstand'", f"concat('Vertragsnummer: WV-', cast({_K} as string))", "concat('Auftraggeber: ', c_name)",
        "'Der Auftragnehmer übernimmt die regelmäßige Wartung der'", "'Aufzugsanlagen des Auftraggebers im Gebäude und in allen Nebengebäuden.'",
        "'=========='", "'_ _ x _ _ ~'", f"concat('Standort: ', n_name, chr(9), 'Serien-Nr. SN-', cast({_K} * 7 as string))", "'Seite 1 von 3'",
    ),
    _lines(
        _HEAD, "'§ 2 Laufzeit und Kündigung'", f"concat('Vertragsbeginn ist der 01.0', cast(1 + {_K} % 9 as string), '.2024, die Laufzeit beträgt ', cast(12 * (1 + {_K} % 3) as string), ' Monate.')",
        f"concat('Die Kündigungs-', chr(10), 'frist beträgt ', cast(1 + {_K} % 6 as string), ' Monate zum Ende der Laufzeit.')",
        f"case when {_K} % 4 = 0 then 'Der Vertrag verlängert sich stillschweigend um 12 Monate.' else 'Eine Verlängerung bedarf der Schriftform.' end",
        "''", "'§ 3 Vergütung'", f"concat('Die Vergütung beträgt ', cast(100 + {_K} % 900 as string), ',00 € netto pro Monat und ist monatlich fällig.')",
        f"case when {_K} % 5 = 0 then 'Die Vergütung beträgt 99,00 € netto pro Monat und ist monatlich fällig.' else 'Die Rechnung ist innerhalb von 14 Tagen zahlbar.' end",
        "'Seite 2 von 3'",
    ),
    _lines(
        _HEAD, "'Position | Menge | Preis'", "'Aufzug A | 1 | 450,00 €'", "'Aufzug A | 1 | 450,00 €'",
        "'Diese Zeile kommt wegen einer doppelten Textebene zweimal vor.'", "'Diese Zeile kommt wegen einer doppelten Textebene zweimal vor.'",
        "''", f"repeat('Der Auftragnehmer haftet für Vorsatz und grobe Fahrlässigkeit nach den Vorschriften. ', cast(1 + {_K} % 4 as int))",
        "''", f"repeat('Der Auftragnehmer haftet für Vorsatz und grobe Fahrlässigkeit nach den Vorschriften. ', cast(1 + {_K} % 4 as int))",
        "''", f"concat('Ansprechpartner: ', c_name, ' — Tel. 0', cast(c_custkey as string))", "'Seite 3 von 3'",
    ),
]

#: doc_id, text: contracts of three pages.
CONTRACTS = f"select c_custkey as doc_id, concat({', chr(12), '.join(_PAGES)}) as text from customer join nation on c_nationkey = n_nationkey"

_QUESTIONS = (
    "Welche Verträge laufen dieses Jahr aus?", "Is there an invoice for the lift?", "Wann ist die nächste TÜV-Prüfung fällig?", "When was the last maintenance?",
    "Wie ist der technische Zustand?", "Ist das Hotel gesund?", "What are the critical issues?", "How many rooms are there?",
    "Zeig mir das Protokoll der Wartung.", "Does the certificate expire soon?", "Was kostet die Instandhaltung?", "Wer ist zuständig?",
)
_DOMAINS = ("", "hotel_health", "contracts", "maintenance", "contracts,maintenance", "documents", "projects", "inspections", "defects,projects")


def _case(key: str, values: tuple[str, ...]) -> str:
    whens = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case {key} % {len(values)} {whens} end"


#: question_id, question, domains (comma-separated).
QUESTIONS = f"select c_custkey as question_id, {_case(_K, _QUESTIONS)} as question, {_case(f'(c_custkey + n_nationkey)', _DOMAINS)} as domains from customer join nation on c_nationkey = n_nationkey"

#: doc_id, call_no, fields (owned; empty: all), field, value: what three calls of a chunked run answered.
ANSWERS = """
select o_custkey as doc_id, cast(o_orderkey % 3 as int) as call_no, cast(o_orderkey as bigint) as seq,
  case o_orderkey % 4 when 0 then 'amount' when 1 then 'currency' when 2 then 'notice_period_value' else 'vendor_name' end as field,
  case o_orderkey % 4 when 0 then cast(o_orderkey % 2 + 450 as string) when 1 then case when o_orderkey % 8 = 1 then 'EUR' else ' eur' end
    when 2 then case when o_orderkey % 3 = 0 then null else cast(o_orderkey % 2 as string) end
    else case when o_orderkey % 5 = 0 then 'Muster  GmbH' else 'muster gmbh' end end as value,
  (o_orderkey % 4 = 3 and o_orderkey % 3 = 0) as owner
from orders
"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of these statements over the tables of sf_dir.

    Customers are dealt out by key before texts are made of them: their rows are short, so hundreds of thousands are one
    split, and all that follows would be one task. A given number of partitions isn't coalesced.
    """
    for name in ("customer", "nation", "orders"):
        if f" {name}" in sql.replace("\n", " "):
            rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            if name == "customer":
                rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
            rows.createOrReplaceTempView(name)
    return spark.sql(sql)


#: doc_id, text: four pages that end in a bare page number, the second one's place shifted in every third document.
NUMBERED = "select c_custkey as doc_id, concat(%s) as text from customer" % ", chr(12), ".join(
    f"concat('Page text {p} of ', c_name, chr(10), 'value', chr(10), '12', chr(10), 'more', chr(10), 'lines', chr(10), 'here', chr(10), cast({p} + case when {p} = 2 and c_custkey % 3 = 0 then 5 else 0 end as string), case when c_custkey % 2 = 0 then '/4' else '' end)"
    for p in (1, 2, 3, 4)
)
