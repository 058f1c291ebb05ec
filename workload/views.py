"""The given tables seen as survey and visit tables.

Each view is a list of column expressions valid in both Spark SQL and DuckDB, so
the queries and their SQL twins read the same shaped input. Views only shape
columns; no operator result is computed here. Every view covers all rows of its
table: respondents that should not match carry another key instead of being
left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = ["DPQ010", "DPQ020", "DPQ030", "DPQ040", "DPQ050", "DPQ060", "DPQ070", "DPQ080", "DPQ090"]


# Bits from which the answers are cut, and the person's general level. Keys are reduced
# first, so the products stay far from the limits of a 64-bit number at any table size.
MIX = (
    "(o_orderkey % 1000003) * 2654435761 + (o_custkey % 1000003) * 104729 AS mix",
    "CAST(floor(o_totalprice) AS BIGINT) % 9 - 5 AS base",
)


def _item(i: int) -> str:
    bits = f"((mix >> {5 * (i - 1)}) & 63)"
    return (
        f"CASE {bits} WHEN 63 THEN 9 WHEN 62 THEN 7 WHEN 61 THEN NULL "
        f"ELSE greatest(0, least(3, base + ({bits} & 3))) END AS DPQ0{i}0"
    )


DEMOGRAPHIC = [
    "CASE c_custkey % 50 WHEN 7 THEN -1 - c_custkey WHEN 8 THEN NULL ELSE c_custkey END AS SEQN",
    "CAST(floor(abs(c_acctbal)) AS BIGINT) % 131 AS RIDAGEYR",
    "CASE c_custkey % 40 WHEN 0 THEN 9 WHEN 1 THEN 7 ELSE 1 + (c_custkey * 7919 % 11) % 2 END"
    " AS RIAGENDR",
    "CAST(CASE WHEN c_nationkey = 24 THEN 9 ELSE 1 + c_nationkey % 5 END AS BIGINT) AS RIDRETH1",
    "CASE c_custkey % 17 WHEN 0 THEN 99 WHEN 11 THEN 77 WHEN 16 THEN 14 ELSE c_custkey % 17 END"
    " AS INDHHIN2",
    "CASE c_custkey % 23 WHEN 0 THEN 9 WHEN 1 THEN 7 ELSE 1 + c_custkey % 5 END AS DMDEDUC2",
    "CASE c_custkey % 29 WHEN 0 THEN 99 WHEN 1 THEN 77 ELSE 1 + c_custkey % 6 END AS DMDMARTL",
]

# Respondents of the survey files: one for each order, again with shifted and absent keys.
RESPONDENT = [
    "CASE o_orderkey % 50 WHEN 7 THEN -1 - o_orderkey WHEN 8 THEN NULL ELSE o_orderkey END AS SEQN",
    *DEMOGRAPHIC[1:],
]

VISIT_HEAD = ["o_orderkey AS visit_id", "o_custkey AS SEQN", "o_orderdate AS created_at"]
ANSWERS = [_item(i) for i in range(1, 10)]
VISIT = [*VISIT_HEAD, *ANSWERS]

# Requests to score: every order with the answers above and demographics of its customer key.
REQUEST_HEAD = [
    *VISIT_HEAD,
    "CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL"
    " ELSE concat(' P-', CAST(o_custkey AS VARCHAR(20)), ' ') END AS patient_id",
    "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  '"
    " WHEN 2 THEN concat('--', o_orderpriority, '!')"
    " ELSE concat(' Dr. ', o_orderstatus, ' Quinn-', CAST(o_custkey AS VARCHAR(20)), ' ') END"
    " AS patient_name",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL"
    " ELSE substring(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS visit_date",
    "CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE '09:30' END AS visit_time",
    "(o_custkey * 37 + 11) % 127 AS RIDAGEYR",
    "1 + o_custkey % 2 AS RIAGENDR",
    "1 + o_custkey % 5 AS RIDRETH1",
    "CASE o_custkey % 17 WHEN 0 THEN 99 WHEN 11 THEN 77 WHEN 16 THEN -1 ELSE o_custkey % 17 END"
    " AS INDHHIN2",
    "1 + o_custkey % 5 AS DMDEDUC2",
    "1 + o_custkey % 6 AS DMDMARTL",
]
REQUEST = [*REQUEST_HEAD, *ANSWERS]

# A raw total that also leaves 0..27, and whole and half-year ages.
RAW_TOTAL = [
    "o_orderkey AS visit_id",
    "CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 41 - 7 END"
    " AS total",
    "CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE CAST(o_custkey % 261 AS DOUBLE) / 2 END AS age",
    "CASE o_orderkey % 7 WHEN 0 THEN 'Minimal' WHEN 1 THEN 'Mild' WHEN 2 THEN 'Moderate'"
    " WHEN 3 THEN 'Moderately Severe' WHEN 4 THEN 'Severe' WHEN 5 THEN 'Other' END AS level",
    "CASE o_custkey % 6 WHEN 0 THEN 'Minimal' WHEN 1 THEN 'Mild' WHEN 2 THEN 'Moderate'"
    " WHEN 3 THEN 'Moderately Severe' WHEN 4 THEN 'Severe' END AS model_level",
]

RAW_TEXT = [
    "c_custkey AS SEQN",
    "CASE c_custkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN ' 2 ' WHEN 3 THEN '3d'"
    " WHEN 4 THEN '2.0' WHEN 5 THEN '77' ELSE CAST(c_custkey % 4 AS VARCHAR(5)) END AS raw_value",
]

# Records with the identity spread over several fields, some of them blank.
RECORD = [
    "o_orderkey AS visit_id",
    "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('P-', CAST(o_custkey AS VARCHAR(20))) END"
    " AS patient_id",
    "CASE o_orderkey % 8 WHEN 2 THEN concat(' Q-', CAST(o_custkey AS VARCHAR(20))) END AS id",
    "CASE o_orderkey % 3 WHEN 0 THEN concat('R-', CAST(o_custkey AS VARCHAR(20))) END"
    " AS input_patient_id",
    "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE concat(o_orderstatus, ' name ') END"
    " AS patient_name",
    "CASE o_orderkey % 2 WHEN 0 THEN concat('Input ', o_orderstatus) END AS input_name",
    "CASE WHEN o_orderkey % 6 = 0 THEN ''"
    " ELSE substring(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS visit_date",
    "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE substring(CAST(o_orderdate AS VARCHAR(30)), 1, 19)"
    " END AS saved_at",
]

TOTAL = " + ".join(ITEMS)
TOTAL_8 = " + ".join(ITEMS[:8])
TOTAL_7 = " + ".join(ITEMS[:7])
VALID = " AND ".join(f"{c} IN (0, 1, 2, 3)" for c in ITEMS)


def level(total: str) -> str:
    return (
        f"CASE WHEN {total} <= 4 THEN 'Minimal' WHEN {total} <= 9 THEN 'Mild'"
        f" WHEN {total} <= 14 THEN 'Moderate' WHEN {total} <= 19 THEN 'Moderately Severe'"
        " ELSE 'Severe' END"
    )


# Totals, of all items and of the first eight, seven and one scaled up to nine: the
# severity of a scaled total is a stand-in for a model's prediction.
TOTALS = [
    f"{TOTAL} AS phq9_total",
    f"CAST(floor(({TOTAL_8}) * 9 / 8.0) AS INT) AS guess_8",
    f"CAST(floor(({TOTAL_7}) * 9 / 7.0) AS INT) AS guess_7",
    "DPQ010 * 9 AS guess_1",
]
COMPLETE = ["visit_id", "SEQN", "created_at", *ITEMS, *TOTALS]
SCORED_TOTALS = ["SEQN", "RIDAGEYR", "RIAGENDR", "RIDRETH1", "INDHHIN2", *TOTALS]
SCORED = [
    "SEQN", "RIDAGEYR", "RIAGENDR", "RIDRETH1", "INDHHIN2", "phq9_total",
    f"{level('phq9_total')} AS y_true",
    f"{level('guess_8')} AS y_pred",
    f"{level('guess_7')} AS y_pred_7",
    f"{level('guess_1')} AS y_pred_1",
]
HISTORY = [
    "visit_id",
    "SEQN",
    "concat('P-', CAST(SEQN AS VARCHAR(20))) AS patient_id",
    "CASE WHEN visit_id % 5 = 0 THEN ''"
    " ELSE concat('Patient ', CAST(SEQN AS VARCHAR(20)), CASE WHEN visit_id % 3 = 0 THEN ' B' ELSE '' END)"
    " END AS patient_name",
    "created_at",
    "CASE WHEN visit_id % 7 = 0 THEN NULL ELSE substring(CAST(created_at AS VARCHAR(30)), 1, 10) END"
    " AS visit_date",
    "phq9_total",
    f"{level('phq9_total')} AS predicted_severity",
    f"{level('guess_8')} AS model_severity",
    "CASE WHEN visit_id % 11 = 0 THEN '' WHEN phq9_total <= 9 THEN 'Low'"
    " WHEN phq9_total <= 14 THEN 'Medium' ELSE 'High' END AS risk_band",
    "CASE WHEN visit_id % 13 = 0 THEN NULL ELSE CAST((visit_id * 37) % 1000 AS DOUBLE) / 1000 END"
    " AS risk_score",
    *ITEMS,
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def demographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*DEMOGRAPHIC)


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One respondent for each order, with the order's customer's demographics."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).selectExpr(*RESPONDENT)


def with_answers(orders: DataFrame, head: list[str]) -> DataFrame:
    """The head columns and the nine answers.

    The answers leave a generator as plain columns, the way a stored table would
    give them; otherwise every later use would repeat their long expressions.
    """
    columns = [text.rsplit(" AS ", 1)[1] for text in head]
    answers = F.struct(*[F.expr(text) for text in ANSWERS])
    return orders.selectExpr(*head, *MIX).select(*columns, F.inline(F.array(answers)))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_answers(table(spark, sf_dir, "orders"), VISIT_HEAD)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_answers(table(spark, sf_dir, "orders"), REQUEST_HEAD)


def raw_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*RAW_TOTAL)


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*RAW_TEXT)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a nested ``input_data`` struct."""
    return (
        table(spark, sf_dir, "orders")
        .selectExpr(*RECORD)
        .withColumn(
            "input_data",
            F.struct(
                F.col("input_patient_id").alias("patient_id"),
                F.col("input_name").alias("patient_name"),
            ),
        )
        .drop("input_patient_id", "input_name")
    )


def questionnaire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every visit as the answer sheet of a respondent of its own."""
    return visits(spark, sf_dir).selectExpr("visit_id AS SEQN", *ITEMS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete respondents with true level and a stand-in prediction; codes uncleaned."""
    return (
        questionnaire(spark, sf_dir)
        .where(VALID)
        .join(respondents(spark, sf_dir), "SEQN")
        .selectExpr(*SCORED_TOTALS)
        .selectExpr(*SCORED)
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete visits as saved, scored documents."""
    return as_history(visits(spark, sf_dir))


def as_history(visits_table: DataFrame) -> DataFrame:
    return visits_table.where(VALID).selectExpr(*COMPLETE).selectExpr(*HISTORY)


def _select(name: str, columns: list[str], source: str, where: str = "") -> str:
    body = ", ".join(columns)
    return f"{name} AS (SELECT {body} FROM {source}{' WHERE ' + where if where else ''})"


CTES = {
    "fx_demographic": _select("fx_demographic", DEMOGRAPHIC, "customer"),
    "fx_visit": _select("fx_visit", VISIT, f"(SELECT *, {', '.join(MIX)} FROM orders) o"),
    "fx_request": _select("fx_request", REQUEST, f"(SELECT *, {', '.join(MIX)} FROM orders) o"),
    "fx_total": _select("fx_total", RAW_TOTAL, "orders"),
    "fx_text": _select("fx_text", RAW_TEXT, "customer"),
    "fx_record": _select("fx_record", RECORD, "orders"),
    "fx_respondent": _select("fx_respondent", RESPONDENT, "orders JOIN customer ON o_custkey = c_custkey"),
    "fx_questionnaire": _select("fx_questionnaire", ["visit_id AS SEQN", *ITEMS], "fx_visit"),
    "fx_scored_totals": _select(
        "fx_scored_totals",
        SCORED_TOTALS,
        "fx_questionnaire JOIN fx_respondent USING (SEQN)",
        VALID,
    ),
    "fx_scored": _select("fx_scored", SCORED, "fx_scored_totals"),
    "fx_complete": _select("fx_complete", COMPLETE, "fx_visit", VALID),
    "fx_history": _select("fx_history", HISTORY, "fx_complete"),
}
NEEDS = {
    "fx_questionnaire": ["fx_visit"],
    "fx_scored_totals": ["fx_questionnaire", "fx_respondent"],
    "fx_scored": ["fx_scored_totals"],
    "fx_complete": ["fx_visit"],
    "fx_history": ["fx_complete"],
}


def with_views(sql: str, *names: str) -> str:
    """SQL text preceded by the named views and those they build on."""

    def closure(seen: list[str], name: str) -> list[str]:
        for needed in NEEDS.get(name, []):
            seen = closure(seen, needed)
        return seen if name in seen else [*seen, name]

    ordered = reduce(closure, names, [])
    rest = sql.strip()
    head = "WITH " + ",\n".join(CTES[name] for name in ordered)
    return f"{head},\n{rest[5:]}" if rest.upper().startswith("WITH ") else f"{head}\n{rest}"
