"""Finding, report and text-extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalogue.base import query
from tagloom.functions.text import parse_cards
from tagloom.operators import findings
from tagloom.plans import report

# A finding text per event, one wording per event type.
WORDING = {
    "error": "多数の外れ値",
    "view": "稼働パターン",
    "click": "ラグ3で最大相関",
    "purchase": "主要周期候補とプロセス変動",
    "signup": "記録",
}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in WORDING.items()) + " END"
MESSAGES = f"m AS (SELECT event_id, 'unit ' || user_id || ': ' || {_CASE} AS message FROM events)"


def _messages(t):
    text = F.create_map(*[F.lit(x) for kv in WORDING.items() for x in kv])[F.col("event_type")]
    return t.events.select("event_id", F.concat(F.lit("unit "), F.col("user_id").cast("string"), F.lit(": "), text).alias("message"))


def _any(words):
    return "(" + " OR ".join(f"contains(message, '{w}')" for w in words) + ")"


_PRIORITY = "CASE " + " ".join(f"WHEN {_any(w)} THEN '{p}'" for p, w in findings.PRIORITY_KEYWORDS.items()) + " ELSE 'other' END"


@query("findings_priority", f"WITH {MESSAGES} SELECT event_id, message, {_PRIORITY} AS priority FROM m")
def findings_priority(t):
    return findings.with_priority(_messages(t))


@query("findings_by_priority", f"WITH {MESSAGES} SELECT {_PRIORITY} AS priority, count(*) AS n FROM m GROUP BY 1")
def findings_by_priority(t):
    return findings.by_priority(_messages(t))


@query(
    "insight_categories",
    f"WITH {MESSAGES} " + " UNION ALL ".join(
        f"SELECT event_id, '{name}' AS category FROM m WHERE {_any(words)}" for name, words in findings.INSIGHT_CATEGORIES.items()
    ),
)
def insight_categories(t):
    return findings.insight_categories(_messages(t)).select("event_id", "category")


def _questions_sql():
    rows, seq = [], 0
    for words, questions in findings.INTERVIEW_RULES:
        for q in questions:
            seq += 1
            rows.append(f"SELECT {seq} AS seq, '{q}' AS question WHERE EXISTS (SELECT 1 FROM m WHERE {_any(words)})")
    for q in findings.GENERAL_QUESTIONS:
        seq += 1
        rows.append(f"SELECT {seq}, '{q}' WHERE EXISTS (SELECT 1 FROM m)")
    return f"WITH {MESSAGES} " + " UNION ALL ".join(rows)


@query("interview_questions", _questions_sql())
def interview_questions(t):
    return findings.interview_questions(_messages(t))


def _steps_sql():
    rows, seq = [], 0
    for step, words, actions in findings.NEXT_STEPS:
        where = f"WHERE EXISTS (SELECT 1 FROM m WHERE {_any(words)})" if words else ""
        for a in actions:
            seq += 1
            rows.append(f"SELECT {seq} AS seq, '{step}' AS step, '{a}' AS action {where}")
    return f"WITH {MESSAGES} " + " UNION ALL ".join(rows)


@query("next_steps", _steps_sql())
def next_steps(t):
    return findings.next_steps(_messages(t))


COLUMNS = ["temp_PV", "temp_SV", "flow_rate", "pressure"]


def _report_input(t):
    return t.tags.select("event_id", "ts", "product", *COLUMNS)


@query("basic_findings")
def basic_findings(t):
    return report.basic_findings(_report_input(t), "ts", ["ts", "event_id"], COLUMNS)


@query("advanced_findings")
def advanced_findings(t):
    return report.advanced_findings(_report_input(t), "ts", ["ts", "event_id"], COLUMNS)


@query("integrated_report")
def integrated_report(t):
    df = _report_input(t)
    basic = report.basic_findings(df, "ts", ["ts", "event_id"], COLUMNS)
    advanced = report.advanced_findings(df, "ts", ["ts", "event_id"], COLUMNS)
    return report.integrated_report(df, basic, advanced)


def _cards(t, blanks: bool):
    """A contact block per customer; every second has a fax, every third a link."""
    key = F.col("c_custkey")
    gap = F.when(key % 4 == 0, F.lit("\n \n")).otherwise("\n") if blanks else F.lit("\n")
    k = key.cast("string")
    lines = [
        F.col("c_name"), F.concat(F.lit("部長　"), F.col("c_mktsegment")), F.concat(F.lit("担当 "), k),
        F.concat(F.lit("\n03-"), k), F.when(key % 2 == 0, F.concat(F.lit("04-"), k)), F.concat(k, F.lit("@example.com")),
        F.lit("[住所]"), F.concat(F.lit("〒"), k), F.concat(F.lit("市 "), k), F.when(key % 3 == 0, F.concat(F.lit("https://example.com/"), k)),
    ]
    return t.customer.select("c_custkey", F.array_join(F.array_compact(F.array(*lines)), "\u0001").alias("b"), gap.alias("gap")).select(
        "c_custkey", F.replace("b", F.lit("\u0001"), F.col("gap")).alias("block")
    )


CARDS = """SELECT c_custkey, c_name AS company, c_mktsegment AS department, '部長' AS position, '〒' || c_custkey AS zip, '市 ' || c_custkey AS address,
  '03-' || c_custkey AS tel, '担当 ' || c_custkey AS name, c_custkey || '@example.com' AS mail,
  CASE WHEN c_custkey % 2 = 0 THEN '04-' || c_custkey ELSE '' END AS fax, CASE WHEN c_custkey % 3 = 0 THEN 'https://example.com/' || c_custkey ELSE '' END AS link FROM customer"""


@query("contact_cards", CARDS)
def contact_cards(t):
    return parse_cards(_cards(t, True), "block")


@query("contact_cards_strict", CARDS)
def contact_cards_strict(t):
    return parse_cards(_cards(t, False), "block", strict=True)


@query(
    "contact_cards_documents",
    """WITH l AS (SELECT doc_id, [x for x in regexp_split_to_array(text, '\\r?\\n') if trim(x) <> ''] AS l FROM documents)
      SELECT doc_id, coalesce(trim(l[1]), '') AS company, coalesce(trim(l[3]), '') AS name, coalesce(trim(l[4]), '') AS tel FROM l""",
)
def contact_cards_documents(t):
    return parse_cards(t.documents.select("doc_id", "text"), "text").select("doc_id", "company", "name", "tel")
