"""DuckDB SQL with the same result as each query, written over the same shaped views."""

from __future__ import annotations

from visitgauge import schema
from workload.views import ITEMS, TOTAL, VALID, with_views

ORACLES: dict[str, str] = {}
LABELS = schema.CLASS_LABELS
GROUPS = schema.FAIRNESS_GROUPS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _level(total: str) -> str:
    return (
        f"CASE WHEN {total} <= 4 THEN 'Minimal' WHEN {total} <= 9 THEN 'Mild'"
        f" WHEN {total} <= 14 THEN 'Moderate' WHEN {total} <= 19 THEN 'Moderately Severe'"
        f" WHEN {total} IS NOT NULL THEN 'Severe' END"
    )


def _band(level: str, unknown: str) -> str:
    return (
        f"CASE WHEN {level} IN ('Minimal', 'Mild') THEN 'Low' WHEN {level} = 'Moderate' THEN 'Medium'"
        f" WHEN {level} IN ('Moderately Severe', 'Severe') THEN 'High' ELSE '{unknown}' END"
    )


def _warning(level: str) -> str:
    texts = schema.WARNINGS
    return (
        f"CASE WHEN {level} IN ('Minimal', 'Mild') THEN {_quoted(texts['low'])}"
        f" WHEN {level} = 'Moderate' THEN {_quoted(texts['moderate'])} ELSE {_quoted(texts['other'])} END"
    )


def _recommendation(level: str) -> str:
    texts = schema.RECOMMENDATIONS
    parts = " ".join(
        f"WHEN {level} = '{name}' THEN {_quoted(texts[name])}"
        for name in ("Minimal", "Mild", "Moderate")
    )
    return f"CASE {parts} ELSE {_quoted(texts['other'])} END"


def _closed_group(age: str) -> str:
    return (
        f"CASE WHEN {age} < 18 THEN 'Under 18' WHEN {age} BETWEEN 18 AND 29 THEN '18-29'"
        f" WHEN {age} BETWEEN 30 AND 44 THEN '30-44' WHEN {age} BETWEEN 45 AND 59 THEN '45-59'"
        f" WHEN {age} >= 60 THEN '60+' END"
    )


def _open_group(age: str) -> str:
    return (
        f"CASE WHEN {age} < 18 THEN 'Under 18' WHEN {age} <= 29 THEN '18-29'"
        f" WHEN {age} <= 44 THEN '30-44' WHEN {age} <= 59 THEN '45-59'"
        f" WHEN {age} IS NOT NULL THEN '60+' END"
    )


def _items(template: str) -> str:
    return ", ".join(template.format(c=c) for c in ITEMS)


# Merged and cleaned tables, as text to put in front of a query.

MERGED = (
    "merged AS (SELECT SEQN, RIDAGEYR, RIAGENDR, RIDRETH1, INDHHIN2, DMDEDUC2, DMDMARTL, "
    + ", ".join(ITEMS)
    + " FROM fx_respondent JOIN fx_questionnaire USING (SEQN))"
)


def _cleaned(source: str) -> str:
    codes = ", ".join(
        f"CAST(CASE WHEN {c} NOT IN ({', '.join(map(str, bad))}) THEN {c} END AS DOUBLE) AS {c}"
        for c, bad in schema.MISSING_CODES.items()
    )
    return (
        "SELECT SEQN, CAST(CASE WHEN RIDAGEYR BETWEEN 0 AND 120 THEN RIDAGEYR END AS DOUBLE)"
        f" AS RIDAGEYR, {codes} FROM {source}"
    )


CLEAN = (
    MERGED
    + ", demo AS ("
    + _cleaned("merged")
    + "), clean AS (SELECT d.*, "
    + _closed_group("d.RIDAGEYR")
    + " AS AGE_GROUP, "
    + _items("CAST(m.{c} AS DOUBLE) AS {c}")
    + f", CAST({TOTAL} AS DOUBLE) AS PHQ9_TOTAL, {_level('(' + TOTAL + ')')} AS SEVERITY"
    + f" FROM demo d JOIN merged m USING (SEQN) WHERE {VALID})"
)
CLEAN_VIEWS = ("fx_respondent", "fx_questionnaire")


def clean_sql(sql: str) -> str:
    rest = sql.strip()
    if rest.upper().startswith("WITH "):
        return with_views(f"WITH {CLEAN}, {rest[5:]}", *CLEAN_VIEWS)
    return with_views(f"WITH {CLEAN} {rest}", *CLEAN_VIEWS)


ORACLES["merge_raw"] = with_views(f"WITH {MERGED} SELECT * FROM merged", *CLEAN_VIEWS)

ORACLES["merge_unmatched"] = with_views(
    """
    SELECT
      (SELECT count(*) FROM fx_demographic d JOIN fx_visit v ON d.SEQN = v.SEQN) AS merged_rows,
      (SELECT count(*) FROM fx_demographic d WHERE SEQN IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM fx_visit v WHERE v.SEQN = d.SEQN)) AS demographic_only_rows,
      (SELECT count(*) FROM fx_visit v WHERE SEQN IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM fx_demographic d WHERE v.SEQN = d.SEQN))
        AS questionnaire_only_rows,
      (SELECT count(*) FROM fx_demographic WHERE SEQN IS NULL) AS demographic_null_keys,
      (SELECT count(*) FROM fx_visit WHERE SEQN IS NULL) AS questionnaire_null_keys
    """,
    "fx_demographic",
    "fx_visit",
)

ORACLES["duplicate_keys"] = with_views(
    "SELECT SEQN, count(*) AS n_rows FROM fx_visit WHERE SEQN IS NOT NULL"
    " GROUP BY SEQN HAVING count(*) > 1",
    "fx_visit",
)

ORACLES["split_feasibility"] = clean_sql(
    """
    WITH c AS (SELECT SEVERITY, count(*) AS n FROM clean GROUP BY SEVERITY),
    t AS (SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_classes, min(n) AS smallest_class,
      CAST(ceil(sum(n)::DOUBLE * 0.3::DOUBLE) AS BIGINT) AS test_rows FROM c),
    r AS (SELECT *, n_rows - test_rows AS train_rows,
      CASE WHEN n_classes = 0 THEN 'No target labels available for splitting'
        WHEN smallest_class < 2
          THEN 'Each severity class needs at least two rows for stratified splitting'
        WHEN test_rows < n_classes THEN 'test_size is too small for stratification'
        WHEN n_rows - test_rows < n_classes THEN 'test_size is too large for stratification'
        ELSE '' END AS reason FROM t)
    SELECT *, reason = '' AS feasible FROM r
    """
)

_CODES = schema.DEMOGRAPHIC_CODES
_INPUT_RULES = (
    [("RIDAGEYR BETWEEN 0 AND 120", "RIDAGEYR must be between 0 and 120")]
    + [(f"{c} >= 0", f"{c} must be 0 or more") for c in _CODES]
    + [(f"{c} BETWEEN 0 AND 3", f"{c} must be between 0 and 3") for c in ITEMS]
    + [(f"coalesce({c} % 1 = 0, true)", f"{c} must be a whole number") for c in ("RIDAGEYR", *_CODES, *ITEMS)]
)


def _messages(rules: list[tuple[str, str]], separator: str) -> str:
    parts = ", ".join(
        f"CASE WHEN coalesce({ok}, false) THEN NULL ELSE {_quoted(text)} END" for ok, text in rules
    )
    return f"concat_ws('{separator}', {parts})"


ORACLES["input_violations"] = with_views(
    f"WITH m AS (SELECT visit_id, {_messages(_INPUT_RULES, '; ')} AS messages FROM fx_request)"
    " SELECT visit_id, messages = '' AS accepted, messages FROM m",
    "fx_request",
)
_FORM_RULES = [
    ("trim(patient_name) <> ''", "Patient name is required."),
    ("RIDAGEYR BETWEEN 0 AND 120", "Age must be between 0 and 120."),
    ("trim(visit_date) <> ''", "Visit date is required."),
    ("trim(visit_time) <> ''", "Visit time is required."),
    *[(f"{c} IN (0, 1, 2, 3)", f"{c} must be answered from 0 to 3.") for c in ITEMS],
]
ORACLES["form_violations"] = with_views(
    f"SELECT visit_id, {_messages(_FORM_RULES, ' ')} AS messages FROM fx_request", "fx_request"
)

ORACLES["item_quality"] = with_views(
    f"""
    WITH cells AS (SELECT unnest([{', '.join(ITEMS)}]) AS v FROM fx_visit)
    SELECT (SELECT count(*) FROM cells WHERE v IS NULL OR v NOT IN (0, 1, 2, 3))
        AS invalid_or_missing_cell_count,
      (SELECT count(*) FROM fx_visit WHERE {VALID}) AS complete_valid_rows,
      (SELECT coalesce(string_agg(t, ',' ORDER BY t), '') FROM
        (SELECT DISTINCT CAST(CAST(v AS DOUBLE) AS VARCHAR) AS t FROM cells
         WHERE v NOT IN (0, 1, 2, 3)) d) AS observed_invalid_values
    """,
    "fx_visit",
)
ORACLES["item_invalid_values"] = with_views(
    f"SELECT CAST(v AS DOUBLE) AS value, count(*) AS n_cells FROM (SELECT unnest([{', '.join(ITEMS)}]) AS v"
    " FROM fx_visit) c WHERE v NOT IN (0, 1, 2, 3) GROUP BY v",
    "fx_visit",
)
ORACLES["total_consistency"] = with_views(
    f"SELECT count(*) AS n_rows, bool_and(phq9_total = {TOTAL}) AS totals_match FROM fx_history",
    "fx_history",
)
ORACLES["split_leakage"] = with_views(
    """
    WITH both_sides AS (
      SELECT patient_id FROM fx_history WHERE created_at < TIMESTAMP '1999-01-01'
      INTERSECT
      SELECT patient_id FROM fx_history WHERE created_at >= TIMESTAMP '1999-01-01')
    SELECT (SELECT count(*) FROM both_sides) AS duplicate_key_count,
      (SELECT string_agg(patient_id, ',' ORDER BY patient_id) FROM
        (SELECT patient_id FROM both_sides ORDER BY patient_id LIMIT 20) f) AS first_keys
    """,
    "fx_history",
)
_FIELDS = ["patient_name", "RIDAGEYR", *_CODES, "visit_date", "visit_time", *ITEMS]
ORACLES["row_completeness"] = with_views(
    "SELECT visit_id, CAST(floor(("
    + " + ".join(f"CASE WHEN coalesce(CAST({c} AS VARCHAR), '') <> '' THEN 1 ELSE 0 END" for c in _FIELDS)
    + f") * 100.0::DOUBLE / {len(_FIELDS)} + 0.5) AS INT) AS completeness FROM fx_request",
    "fx_request",
)

# Classification metrics: per-class integer counts, then sums in class order.


def _class_counts(pred: str = "y_pred") -> str:
    parts = []
    for i, label in enumerate(LABELS):
        parts.append(
            f"count(*) FILTER (WHERE y_true = '{label}' AND {pred} = '{label}') AS tp{i}, "
            f"count(*) FILTER (WHERE y_true = '{label}') AS s{i}, "
            f"count(*) FILTER (WHERE {pred} = '{label}') AS p{i}"
        )
    return ", ".join(parts)


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END"


def _precision(i: int) -> str:
    return f"({_div(f'tp{i}', f'p{i}')})"


def _recall(i: int) -> str:
    return f"({_div(f'tp{i}', f's{i}')})"


def _f1(i: int) -> str:
    return f"({_div(f'2 * tp{i}', f'(s{i} + p{i})')})"


def _weighted(metric) -> str:
    total = " + ".join(f"s{i} * {metric(i)}" for i in range(len(LABELS)))
    return f"({_div(total, 'n_rows')})"


def _macro(metric) -> str:
    return f"(({' + '.join(metric(i) for i in range(len(LABELS)))}) / {len(LABELS)})"


HITS = "(" + " + ".join(f"tp{i}" for i in range(len(LABELS))) + ")"
ACCURACY = f"({_div(HITS, 'n_rows')})"
METRICS = (
    f"n_rows AS test_size, {ACCURACY} AS accuracy, {_weighted(_precision)} AS precision,"
    f" {_weighted(_recall)} AS recall, {_weighted(_f1)} AS f1"
)
ORACLES["model_metrics"] = with_views(
    f"WITH c AS (SELECT count(*) AS n_rows, {_class_counts()} FROM fx_scored) SELECT {METRICS} FROM c",
    "fx_scored",
)
_THREE = " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{name}' AS candidate, count(*) AS n_rows, {_class_counts(column)}"
    " FROM fx_scored"
    for i, (name, column) in enumerate(
        [("Eight items", "y_pred"), ("Seven items", "y_pred_7"), ("First item", "y_pred_1")]
    )
)
ORACLES["accuracy_flag"] = with_views(
    f"WITH c AS ({_THREE}) SELECT candidate, {ACCURACY} AS accuracy,"
    f" {ACCURACY} >= 0.95::DOUBLE AS accuracy_suspiciously_high FROM c",
    "fx_scored",
)
ORACLES["select_best"] = with_views(
    f"WITH c AS ({_THREE}), m AS (SELECT ordinal, candidate, {METRICS} FROM c)"
    " SELECT * FROM m ORDER BY f1 DESC, ordinal LIMIT 1",
    "fx_scored",
)
_LABEL_VALUES = ", ".join(f"('{x}')" for x in LABELS)
ORACLES["confusion_matrix"] = with_views(
    f"""
    WITH l(label) AS (VALUES {_LABEL_VALUES})
    SELECT a.label AS y_true, b.label AS y_pred,
      (SELECT count(*) FROM fx_scored s WHERE s.y_true = a.label AND s.y_pred = b.label) AS n
    FROM l a, l b
    """,
    "fx_scored",
)
_REPORT_LINES = [
    f"SELECT '{x}' AS label, {_precision(i)} AS precision, {_recall(i)} AS recall,"
    f" {_f1(i)} AS f1, s{i} AS support FROM c"
    for i, x in enumerate(LABELS)
]
_REPORT_LINES += [
    f"SELECT 'accuracy', {ACCURACY}, {ACCURACY}, {ACCURACY}, n_rows FROM c",
    f"SELECT 'macro avg', {_macro(_precision)}, {_macro(_recall)}, {_macro(_f1)}, n_rows FROM c",
    f"SELECT 'weighted avg', {_weighted(_precision)}, {_weighted(_recall)}, {_weighted(_f1)},"
    " n_rows FROM c",
]
ORACLES["classification_report"] = with_views(
    f"WITH c AS (SELECT count(*) AS n_rows, {_class_counts()} FROM fx_scored) "
    + " UNION ALL ".join(_REPORT_LINES),
    "fx_scored",
)

# Cleaning

ORACLES["coerce_numeric"] = with_views(
    r"SELECT SEQN, raw_value, CASE WHEN regexp_full_match(raw_value,"
    r" '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*')"
    r" THEN TRY_CAST(trim(raw_value) AS DOUBLE) END AS value FROM fx_text",
    "fx_text",
)
ORACLES["clean_demographics"] = with_views(_cleaned("fx_demographic"), "fx_demographic")
_VALID_ITEMS = _items("CASE WHEN {c} IN (0, 1, 2, 3) THEN CAST({c} AS DOUBLE) END AS {c}")
ORACLES["phq9_total"] = with_views(
    f"WITH v AS (SELECT visit_id, {_VALID_ITEMS}, "
    + " + ".join(f"coalesce({c}, 0)" for c in ITEMS)
    + f" AS answered_total FROM fx_visit) SELECT *, {TOTAL} AS PHQ9_TOTAL FROM v",
    "fx_visit",
)
ORACLES["severity_bins"] = with_views(
    f"SELECT visit_id, total, CASE WHEN total BETWEEN 0 AND 27 THEN {_level('total')} END"
    f" AS severity_in_range, {_level('total')} AS severity_clamped FROM fx_total",
    "fx_total",
)
ORACLES["age_groups"] = with_views(
    f"SELECT visit_id, age, {_closed_group('age')} AS closed_group, {_open_group('age')}"
    " AS open_group FROM fx_total",
    "fx_total",
)
ORACLES["complete_cases"] = clean_sql("SELECT SEQN, PHQ9_TOTAL, SEVERITY FROM clean")
ORACLES["select_features"] = clean_sql(
    f"SELECT {', '.join(schema.FEATURES)}, SEVERITY FROM clean"
)
ORACLES["clean_dataset"] = clean_sql(f"SELECT {', '.join(schema.RAW_OUTPUT)} FROM clean")

# Levels, texts, identity

ORACLES["risk_bands"] = with_views(
    f"SELECT visit_id, level, {_band('level', 'High')} AS band_unknown_high,"
    f" {_band('level', 'Low')} AS band_unknown_low FROM fx_total",
    "fx_total",
)
ORACLES["guidance"] = with_views(
    f"SELECT visit_id, level, {_warning('level')} AS warning, {_recommendation('level')}"
    " AS recommendation FROM fx_total",
    "fx_total",
)
ORACLES["explanations"] = with_views(
    f"""
    WITH t AS (SELECT visit_id, total, model_level, {_level('total')} AS lv FROM fx_total),
    b AS (SELECT *, lower({_band('lv', 'High')}) AS band,
      'The PHQ-9 score is ' || total || ', which falls in the ' || lv || ' range. '
      || 'The primary screening result follows PHQ-9 scoring boundaries.' AS head FROM t)
    SELECT visit_id,
      head || coalesce(' The trained model estimate is ' || model_level || '.', '')
        || ' The screening risk band is ' || band || '.' AS with_model,
      head || ' The screening risk band is ' || band || '.' AS without_model,
      'The PHQ-9 score is ' || total || ', which is in the ' || lv || ' range. The model estimates '
        || band || ' risk from PHQ-9 answers and demographic fields.' AS form_text
    FROM b
    """,
    "fx_total",
)
ORACLES["model_agreement"] = with_views(
    f"SELECT visit_id, level IS NOT DISTINCT FROM model_level AS model_agreement,"
    f" CASE WHEN level IS NOT DISTINCT FROM model_level THEN {_quoted(schema.AGREES_NOTE)}"
    f" ELSE {_quoted(schema.DIFFERS_NOTE)} END AS model_note FROM fx_total",
    "fx_total",
)
ORACLES["agreement_summary"] = with_views(
    """
    SELECT count(*) AS sample_count,
      count(*) FILTER (WHERE predicted_severity = model_severity) AS agreement_count,
      count(*) FILTER (WHERE predicted_severity <> model_severity) AS mismatch_count
    FROM fx_history
    """,
    "fx_history",
)
_IDENTITY = """
    slugs AS (SELECT *, substring(coalesce(nullif(upper(trim(regexp_replace(
        coalesce(patient_name, ''), '[^A-Za-z0-9]+', '-', 'g'), '-')), ''), 'PATIENT'), 1, 18) AS slug
      FROM fx_request),
    seeds AS (SELECT *, slug || '|' || RIDAGEYR || '|' || RIAGENDR AS seed FROM slugs),
    hashes AS (SELECT *, list_reduce(
        list_prepend(0::BIGINT, list_transform(string_split(seed, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, c: (a * 31 + c) & 4294967295) AS h FROM seeds),
    named AS (SELECT *, 'MHQ-' || slug || '-' || right(lpad(to_base(h, 36), 7, '0'), 6)
        AS generated_id FROM hashes)
"""
ORACLES["patient_ids"] = with_views(
    f"WITH {_IDENTITY} SELECT visit_id,"
    " coalesce(nullif(trim(patient_id), ''), generated_id) AS patient_id,"
    " coalesce(nullif(trim(patient_name), ''), 'Unnamed patient') AS patient_name FROM named",
    "fx_request",
)


def _group_label(column: str, value: str) -> str:
    if column == "AGE_GROUP":
        return f"coalesce({value}, 'Missing')"
    known = " ".join(
        f"WHEN {value} = {code} THEN {_quoted(text)}"
        for code, text in schema.GROUP_LABELS[column].items()
    )
    return (
        f"CASE WHEN {value} IS NULL THEN 'Missing' {known}"
        f" ELSE 'Unknown / Other (' || {value} || ')' END"
    )


ORACLES["group_labels"] = with_views(
    "SELECT SEQN, "
    + ", ".join(
        f"{_group_label(g, _closed_group('RIDAGEYR') if g == 'AGE_GROUP' else g)} AS {g}_label"
        for g in GROUPS
    )
    + " FROM fx_demographic",
    "fx_demographic",
)
ORACLES["item_breakdown"] = with_views(
    " UNION ALL ".join(
        f"SELECT visit_id, '{c}' AS code, {_quoted(schema.ITEM_QUESTIONS[c])} AS question,"
        f" coalesce({c}, 0) AS score, CASE coalesce({c}, 0) "
        + " ".join(f"WHEN {k} THEN '{v}'" for k, v in schema.ITEM_MEANINGS.items())
        + " ELSE 'Unknown' END AS meaning FROM fx_visit"
        for c in ITEMS
    ),
    "fx_visit",
)
ORACLES["identity_fallbacks"] = with_views(
    """
    SELECT visit_id,
      trim(coalesce(nullif(patient_id, ''), nullif(id, ''), nullif(input_patient_id, ''), ''))
        AS patient_id,
      trim(coalesce(nullif(patient_name, ''), nullif(input_name, ''), '')) AS patient_name,
      coalesce(nullif(visit_date, ''), nullif(saved_at, ''), '') AS visit_value
    FROM fx_record
    """,
    "fx_record",
)
_ANSWERED = "(" + " + ".join(f"coalesce({c}, 0)" for c in ITEMS) + ")"
ORACLES["normalize_results"] = with_views(
    f"""
    WITH r AS (SELECT visit_id, {_ANSWERED} AS answers,
        CASE WHEN visit_id % 3 = 0 THEN 'Severe' ELSE {_level(_ANSWERED)} END AS lv,
        CASE WHEN visit_id % 5 = 0 THEN 12 ELSE {_ANSWERED} END AS phq9_total,
        CASE WHEN visit_id % 6 > 0 THEN CAST(visit_id % 100 AS DOUBLE) / 128 ELSE 0 END AS risk_score
      FROM fx_visit),
    b AS (SELECT *, CASE WHEN visit_id % 4 = 0 THEN 'High' ELSE {_band('lv', 'Low')} END AS risk_band
      FROM r)
    SELECT visit_id, lv AS predicted_severity, lv AS rule_based_severity,
      lv AS model_predicted_severity, true AS model_agreement, '' AS model_note, risk_band,
      phq9_total, risk_score, floor(risk_score * 100 + 0.5) AS risk_percentage,
      CASE WHEN visit_id % 7 = 0 THEN 'See notes.' ELSE {_recommendation('lv')} END AS recommendation,
      {_warning('lv')} AS warning,
      'The PHQ-9 score is ' || phq9_total || ', which is in the ' || lv
        || ' range. The model estimates ' || lower(risk_band)
        || ' risk from PHQ-9 answers and demographic fields.' AS explanation
    FROM b
    """,
    "fx_visit",
)
_PATTERN = ", ".join(
    f"CAST(greatest(0, least(3, t - {3 * i})) AS INT) AS {c}" for i, c in enumerate(ITEMS)
)
_PATTERN = ", ".join(
    f"CASE WHEN t IS NOT NULL THEN CAST(greatest(0, least(3, t - {3 * i})) AS INT) END AS {c}"
    for i, c in enumerate(ITEMS)
)
ORACLES["boundary_cases"] = with_views(
    f"""
    WITH b AS (SELECT visit_id, CASE WHEN total BETWEEN 0 AND 27 THEN total END AS t FROM fx_total)
    SELECT visit_id, t AS total, {_PATTERN}, {_level('t')} AS expected_severity,
      {_level('t')} AS rule_based_severity,
      CASE WHEN t <= 9 THEN 'Low' WHEN t <= 14 THEN 'Medium' ELSE 'High' END AS risk_band
    FROM b
    """,
    "fx_total",
)
_ACCEPTED = " AND ".join(f"({ok})" for ok, _ in _INPUT_RULES)
_RULES = f"""
    {_IDENTITY},
    totals AS (SELECT *, {TOTAL} AS phq9_total FROM named WHERE {_ACCEPTED}),
    rules AS (SELECT visit_id,
      coalesce(nullif(trim(patient_id), ''), generated_id) AS patient_id,
      coalesce(nullif(trim(patient_name), ''), 'Unnamed patient') AS patient_name,
      {_open_group('RIDAGEYR')} AS AGE_GROUP, phq9_total,
      {_level('phq9_total')} AS predicted_severity FROM totals),
    judged AS (SELECT *, {_band('predicted_severity', 'High')} AS risk_band,
      {_recommendation('predicted_severity')} AS recommendation,
      {_warning('predicted_severity')} AS warning FROM rules)
"""
ORACLES["score_rules"] = with_views(f"WITH {_RULES} SELECT * FROM judged", "fx_request")

# Fairness

ORACLES["severity_distribution"] = with_views(
    f"WITH {MERGED} SELECT coalesce(CASE WHEN {VALID} THEN {_level('(' + TOTAL + ')')} END, 'nan')"
    " AS value, count(*) AS n FROM merged GROUP BY 1",
    *CLEAN_VIEWS,
)


def _high(column: str) -> str:
    return f"{column} IN ('Moderate', 'Moderately Severe', 'Severe')"


_FAIR_COUNTS = (
    f"count(*) AS n_rows, {_class_counts()},"
    " count(*) FILTER (WHERE y_pred <> 'Minimal') AS n_selected,"
    f" count(*) FILTER (WHERE {_high('y_true')}) AS n_high,"
    f" count(*) FILTER (WHERE {_high('y_pred')}) AS n_high_predicted,"
    f" count(*) FILTER (WHERE {_high('y_true')} AND NOT {_high('y_pred')}) AS n_high_missed"
)
# Error rates in long form: sums of the K one-against-rest tables.
_FN = "(" + " + ".join(f"(s{i} - tp{i})" for i in range(len(LABELS))) + ")"
_FP = "(" + " + ".join(f"(p{i} - tp{i})" for i in range(len(LABELS))) + ")"
_TN = "(" + " + ".join(f"(n_rows - s{i} - p{i} + tp{i})" for i in range(len(LABELS))) + ")"
_RATES = (
    f"{ACCURACY} AS accuracy, {_weighted(_precision)} AS precision, {_weighted(_recall)} AS recall,"
    f" {_weighted(_f1)} AS f1, {_div(_FP, f'({_FP} + {_TN})')} AS false_positive_rate,"
    f" {_div(_FN, f'({_FN} + {HITS})')} AS false_negative_rate,"
    f" {_div('n_selected', 'n_rows')} AS selection_rate,"
    f" {_div('n_high_missed', 'n_high')} AS high_risk_false_negative_rate,"
    f" {_div('n_high_predicted', 'n_rows')} AS high_risk_selection_rate"
)


def _r4(expression: str) -> str:
    return f"round_even(({expression}) * 10000, 0) / 10000.0::DOUBLE"


_GROUP_ROWS = " UNION ALL ".join(
    f"SELECT {i} AS place, '{g}' AS group_column, "
    + (_closed_group("RIDAGEYR") if g == "AGE_GROUP" else f"CAST({g} AS VARCHAR)")
    + " AS group_value, y_true, y_pred FROM fx_scored"
    for i, g in enumerate(GROUPS)
)
_LABEL_CASES = " ".join(
    f"WHEN group_column = '{column}' AND group_value = '{code}' THEN {_quoted(text)}"
    for column, codes in schema.GROUP_LABELS.items()
    for code, text in codes.items()
)
_ROUNDED = [
    "accuracy", "precision", "recall", "f1", "false_positive_rate", "false_negative_rate",
    "selection_rate", "risk_percentage", "high_risk_false_negative_rate",
    "high_risk_selection_rate", "overall_accuracy", "overall_f1", "accuracy_gap", "f1_gap",
    "false_negative_rate_gap", "selection_rate_gap", "high_risk_false_negative_rate_gap",
    "high_risk_selection_rate_gap",
]
FAIR = f"""
    gr AS ({_GROUP_ROWS}),
    gc AS (SELECT group_column, group_value, {_FAIR_COUNTS} FROM gr WHERE group_value IS NOT NULL
      GROUP BY group_column, group_value),
    gm AS (SELECT group_column, group_value, n_rows AS sample_size, {_RATES} FROM gc),
    oc AS (SELECT {_FAIR_COUNTS} FROM fx_scored),
    om AS (SELECT {_RATES} FROM oc),
    gaps AS (SELECT g.*, g.selection_rate * 100 AS risk_percentage,
      o.accuracy AS overall_accuracy, o.f1 AS overall_f1,
      g.accuracy - o.accuracy AS accuracy_gap, g.f1 - o.f1 AS f1_gap,
      g.false_negative_rate - o.false_negative_rate AS false_negative_rate_gap,
      g.selection_rate - o.selection_rate AS selection_rate_gap,
      g.high_risk_false_negative_rate - o.high_risk_false_negative_rate
        AS high_risk_false_negative_rate_gap,
      g.high_risk_selection_rate - o.high_risk_selection_rate AS high_risk_selection_rate_gap
      FROM gm g CROSS JOIN om o),
    named AS (SELECT *,
      CASE WHEN group_column = 'AGE_GROUP' THEN group_value {_LABEL_CASES}
        ELSE 'Unknown / Other (' || group_value || ')' END AS group_label,
      CASE WHEN sample_size < 20 THEN 'Low Sample Size'
        WHEN false_negative_rate_gap > 0.10::DOUBLE THEN 'Warning'
        WHEN f1_gap < -0.10::DOUBLE OR accuracy_gap < -0.10::DOUBLE THEN 'Review' ELSE 'OK' END
        AS fairness_flag FROM gaps),
    report AS (SELECT group_column, group_value, group_label, sample_size, 20 AS min_group_size,
      {', '.join(f'{_r4(c)} AS {c}' for c in _ROUNDED)}, fairness_flag,
      group_label || CASE fairness_flag
        WHEN 'Low Sample Size' THEN ' has fewer than 20 test rows; interpret with caution.'
        WHEN 'Warning' THEN ' has a higher false-negative gap than the overall test set.'
        WHEN 'Review' THEN ' has lower model performance than the overall test set.'
        ELSE ' is within the configured review thresholds.' END AS notes FROM named)
"""


def fair_sql(sql: str, *more: str) -> str:
    return with_views(f"WITH {FAIR} {sql}", "fx_scored", *more)


ORACLES["fairness_overall"] = fair_sql(
    "SELECT accuracy, f1, false_negative_rate, selection_rate, high_risk_false_negative_rate,"
    " high_risk_selection_rate FROM om"
)
ORACLES["fairness_report"] = fair_sql("SELECT * FROM report")
ORACLES["fairness_disparities"] = fair_sql(
    """
    SELECT group_column, count(*) AS n_groups, max(accuracy) - min(accuracy) AS accuracy_disparity,
      max(false_positive_rate) - min(false_positive_rate) AS fpr_disparity,
      max(false_negative_rate) - min(false_negative_rate) AS fnr_disparity,
      max(selection_rate) - min(selection_rate) AS selection_rate_disparity
    FROM report GROUP BY group_column HAVING count(*) >= 2
    """
)
_REPORT_BAND = (
    "CASE WHEN floor(risk_percentage + 0.5) >= 30 THEN 'High'"
    " WHEN floor(risk_percentage + 0.5) >= 20 THEN 'Medium' ELSE 'Low' END"
)
ORACLES["fairness_ranking"] = fair_sql(
    f"""
    SELECT group_column, group_value, group_label, risk_percentage,
      CAST(row_number() OVER (PARTITION BY group_column ORDER BY risk_percentage DESC, group_value)
        AS INT) AS risk_rank, {_REPORT_BAND} AS band FROM report
    """
)
ORACLES["fairness_bands"] = fair_sql(
    f"SELECT group_column, group_value, {_REPORT_BAND} AS band FROM report"
)
ORACLES["risk_percentage"] = fair_sql(
    "SELECT group_column, group_value, CASE WHEN sample_size % 2 = 0 THEN risk_percentage"
    " ELSE selection_rate * 100 END AS risk_percentage FROM report"
)
_RANKED = """
    ranked AS (SELECT *, row_number() OVER (PARTITION BY group_column
        ORDER BY risk_percentage DESC, group_value) AS up,
      row_number() OVER (PARTITION BY group_column
        ORDER BY risk_percentage, group_value DESC) AS down FROM report),
    spread AS (SELECT max(s) AS widest FROM (SELECT max(risk_percentage) - min(risk_percentage) AS s
      FROM report GROUP BY group_column HAVING count(*) >= 2) x)
"""


def _extreme(column: str, place: str) -> str:
    return f"(SELECT group_value FROM ranked WHERE group_column = '{column}' AND {place} = 1)"


_SUMMARY = f"""
    SELECT {_extreme('AGE_GROUP', 'up')} AS highest_risk_age_group,
      {_extreme('AGE_GROUP', 'down')} AS lowest_risk_age_group,
      {_extreme('RIAGENDR', 'up')} AS highest_risk_gender,
      {_extreme('RIAGENDR', 'down')} AS lowest_risk_gender,
      {_extreme('RIDRETH1', 'up')} AS highest_risk_race,
      coalesce(widest, 0) AS max_disparity, coalesce(widest, 0) >= 15 AS bias_detected,
      CASE WHEN coalesce(widest, 0) >= 15 THEN {_quoted(schema.BIAS_FOUND)}
        ELSE {_quoted(schema.BIAS_NOT_FOUND)} END AS fairness_warning,
      (SELECT string_agg(line, '; ' ORDER BY line) FROM (SELECT group_column || '=' ||
        string_agg(group_value, '>' ORDER BY up) AS line FROM ranked GROUP BY group_column) g) AS groups
    FROM spread
"""
ORACLES["fairness_summary"] = fair_sql(f", {_RANKED} {_SUMMARY}")
ORACLES["fairness_records"] = fair_sql(
    f", {_RANKED} SELECT * EXCLUDE (up, down), CAST(up AS INT) AS place FROM ranked"
)
ORACLES["fairness_inventory"] = fair_sql(
    """
    SELECT count(*) AS row_count,
      (SELECT string_agg(g, ',' ORDER BY g) FROM (SELECT DISTINCT group_column AS g FROM report) x)
        AS group_columns,
      count(*) FILTER (WHERE fairness_flag = 'Low Sample Size') AS low_sample_size_rows
    FROM report
    """
)
ORACLES["patient_fairness_flags"] = with_views(
    f"WITH {FAIR.replace('named AS', 'labelled AS').replace('FROM named', 'FROM labelled')},"
    f" {_RANKED}, summary AS ({_SUMMARY}), {_RULES}"
    """
    SELECT visit_id, AGE_GROUP, risk_band,
      bias_detected AND (risk_band = 'High' OR AGE_GROUP = highest_risk_age_group) AS with_report,
      risk_band = 'High' AS without_report
    FROM judged CROSS JOIN summary
    """,
    "fx_scored",
    "fx_request",
)

# Saved visits

_HISTORY_COLUMNS = (
    "visit_id, patient_id, patient_name, created_at, visit_date, phq9_total, predicted_severity,"
    " model_severity, risk_band, risk_score"
)
ORACLES["recent_predictions"] = with_views(
    f"SELECT {_HISTORY_COLUMNS} FROM fx_history ORDER BY created_at DESC, visit_id DESC LIMIT 100",
    "fx_history",
)
ORACLES["patient_history"] = with_views(
    f"SELECT {_HISTORY_COLUMNS} FROM fx_history WHERE patient_id = 'P-11'"
    " ORDER BY created_at DESC, visit_id DESC LIMIT 100",
    "fx_history",
)
ORACLES["recent_activity"] = with_views(
    f"""
    SELECT visit_id, coalesce(nullif(patient_name, ''), 'Unnamed') AS patient_name, patient_id,
      coalesce(visit_date, strftime(created_at, '%Y-%m-%d')) AS visit_day,
      CAST(phq9_total AS VARCHAR) AS phq9_total, predicted_severity AS severity,
      coalesce(nullif(risk_band, ''), {_band('predicted_severity', 'Low')}) AS risk_band,
      CAST(floor(coalesce(risk_score, 0) * 100 + 0.5) AS INT) AS risk_percent
    FROM fx_history ORDER BY created_at DESC, visit_id DESC LIMIT 8
    """,
    "fx_history",
)
_PAIRS = """
    r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY created_at DESC, visit_id DESC)
      AS rn FROM fx_history),
    p AS (SELECT a.patient_id, b.visit_id IS NOT NULL AS has_comparison,
      a.visit_id AS latest_visit_id, b.visit_id AS previous_visit_id,
      a.created_at AS latest_created_at, b.created_at AS previous_created_at,
      a.phq9_total AS latest_total, b.phq9_total AS previous_total,
      coalesce(a.phq9_total - b.phq9_total, 0) AS phq9_change,
      coalesce(a.risk_score, 0) AS s1, coalesce(b.risk_score, 0) AS s2
      FROM r a LEFT JOIN r b ON a.patient_id = b.patient_id AND b.rn = 2 WHERE a.rn = 1)
"""
ORACLES["patient_comparison"] = with_views(
    f"""
    WITH {_PAIRS}
    SELECT patient_id, has_comparison, latest_visit_id, previous_visit_id, latest_created_at,
      previous_created_at, latest_total, previous_total, phq9_change,
      CASE WHEN has_comparison THEN CAST(printf('%.4f', s1 - s2) AS DOUBLE) + 0.0 ELSE 0 END AS risk_score_change,
      CASE WHEN NOT has_comparison THEN 'insufficient_history' WHEN phq9_change < 0 THEN 'improved'
        WHEN phq9_change > 0 THEN 'worsened' ELSE 'no_change' END AS status,
      CASE WHEN NOT has_comparison THEN {_quoted(schema.NOT_ENOUGH_VISITS)}
        WHEN phq9_change < 0
          THEN 'Patient improved by ' || abs(phq9_change) || ' PHQ-9 points since last visit.'
        WHEN phq9_change > 0
          THEN 'Patient worsened by ' || phq9_change || ' PHQ-9 points since last visit.'
        ELSE 'No major PHQ-9 score change since last visit.' END AS summary
    FROM p
    """,
    "fx_history",
)
ORACLES["patient_comparison_service"] = with_views(
    f"""
    WITH {_PAIRS}
    SELECT patient_id, has_comparison, phq9_change,
      CASE WHEN NOT has_comparison THEN NULL WHEN phq9_change < 0 THEN 'Improved'
        WHEN phq9_change > 0 THEN 'Worsened' ELSE 'No major change' END AS status,
      CASE WHEN NOT has_comparison THEN {_quoted(schema.NOT_ENOUGH_VISITS)}
        WHEN phq9_change < 0
          THEN 'Patient condition improved by ' || abs(phq9_change) || ' PHQ-9 points.'
        WHEN phq9_change > 0
          THEN 'Patient condition worsened by ' || phq9_change || ' PHQ-9 points.'
        ELSE 'Patient PHQ-9 score did not change.' END AS summary
    FROM p
    """,
    "fx_history",
)
_TREND = """
    t AS (SELECT patient_id, created_at, visit_id,
      coalesce(visit_date, strftime(created_at, '%Y-%m-%d')) AS visit_day,
      phq9_total AS total, CAST(floor(coalesce(risk_score, 0) * 100 + 0.5) AS INT) AS risk_percent,
      lag(phq9_total) OVER w AS previous_total, row_number() OVER w AS position
      FROM fx_history WINDOW w AS (PARTITION BY patient_id ORDER BY created_at, visit_id))
"""
ORACLES["patient_trend"] = with_views(
    f"WITH {_TREND} SELECT *, total - previous_total AS change FROM t", "fx_history"
)
ORACLES["trend_points"] = with_views(
    f"WITH {_TREND} SELECT patient_id, CAST(strftime(created_at, '%Y%m') AS INT) AS part, position, visit_id,"
    " total, risk_percent FROM t",
    "fx_history",
)
ORACLES["latest_report"] = with_views(
    """
    WITH v AS (SELECT *, coalesce(visit_date, strftime(created_at, '%Y-%m-%dT%H:%M:%S')) AS visit_value
      FROM fx_history),
    r AS (SELECT *, row_number() OVER (PARTITION BY patient_id
      ORDER BY visit_value DESC, created_at DESC, visit_id DESC) AS rn FROM v)
    SELECT patient_id, visit_id, visit_value, phq9_total, predicted_severity FROM r WHERE rn = 1
    """,
    "fx_history",
)
ORACLES["patient_prefill"] = with_views(
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY SEQN ORDER BY created_at DESC, visit_id DESC)
      AS rn FROM fx_request)
    SELECT 'P-' || SEQN AS patient_id, visit_id, patient_name, RIDAGEYR, RIAGENDR, RIDRETH1, INDHHIN2,
      DMDEDUC2, DMDMARTL FROM r WHERE rn = 1
    """,
    "fx_request",
)
ORACLES["patient_directory"] = with_views(
    """
    WITH n AS (SELECT patient_id, patient_name, row_number() OVER (PARTITION BY patient_id
        ORDER BY created_at, visit_id) AS rn FROM fx_history WHERE patient_name <> ''),
    d AS (SELECT patient_id, count(*) AS visit_count,
        max(coalesce(visit_date, strftime(created_at, '%Y-%m-%dT%H:%M:%S'))) AS latest_visit
      FROM fx_history GROUP BY patient_id)
    SELECT d.patient_id, coalesce(n.patient_name, '') AS patient_name, latest_visit, visit_count,
      CASE WHEN n.patient_name IS NULL THEN d.patient_id
        ELSE n.patient_name || ' - ' || d.patient_id END
      || ' (' || visit_count || CASE WHEN visit_count = 1 THEN ' visit)' ELSE ' visits)' END AS label
    FROM d LEFT JOIN n ON n.patient_id = d.patient_id AND n.rn = 1
    """,
    "fx_history",
)
def _map_text(name: str, value: str, source: str, always: str = "") -> str:
    """SQL: counts by value as ``name:n`` texts, in order; ``always`` lists values that come even at 0."""
    zero = f" UNION ALL SELECT unnest([{always}]), 0" if always else ""
    return (
        f"(SELECT string_agg(v || ':' || n, ',' ORDER BY v) FROM (SELECT v, CAST(sum(n) AS BIGINT) AS n FROM"
        f" (SELECT {value} AS v, count(*) AS n FROM {source} GROUP BY 1{zero}) u GROUP BY v) c) AS {name}"
    )


def _stats_maps(source: str, band: str) -> str:
    level = "coalesce(nullif(predicted_severity, ''), 'Unknown')"
    return (
        _map_text("severity_counts", level, source)
        + ", " + _map_text("risk_band_counts", band, source, "'High', 'Medium', 'Low'")
    )


_DASHBOARD = """
    SELECT count(*) AS total_predictions,
      count(*) FILTER (WHERE risk_band = 'High') AS high_risk_count,
      count(*) FILTER (WHERE risk_band = 'Medium') AS medium_risk_count,
      count(*) FILTER (WHERE risk_band IN ('Low', '')) AS low_risk_count,
      CAST(printf('%.4f', sum(CAST(coalesce(risk_score, 0) AS DECIMAL(18, 6)))::DOUBLE / count(*)) AS DOUBLE)
        AS average_risk_score,
      CAST(printf('%.2f', sum(phq9_total)::DOUBLE / count(*)) AS DOUBLE) AS average_phq9_total,
      max(created_at) AS latest_prediction_time,
      count(*) FILTER (WHERE predicted_severity = 'Minimal') AS n_minimal,
      count(*) FILTER (WHERE predicted_severity = 'Mild') AS n_mild,
      count(*) FILTER (WHERE predicted_severity = 'Moderate') AS n_moderate,
      count(*) FILTER (WHERE predicted_severity = 'Moderately Severe') AS n_moderately_severe,
      count(*) FILTER (WHERE predicted_severity = 'Severe') AS n_severe,
      count(*) FILTER (WHERE coalesce(predicted_severity, '') = '') AS n_unknown,
"""
_NEWEST = "(SELECT * FROM fx_history ORDER BY created_at DESC, visit_id DESC LIMIT 500) h"
_SAVED_BAND = "coalesce(nullif(risk_band, ''), 'Low')"
ORACLES["dashboard_stats"] = with_views(
    f"{_DASHBOARD} {_stats_maps(_NEWEST, _SAVED_BAND)} FROM {_NEWEST}", "fx_history"
)
ORACLES["dashboard_stats_all"] = with_views(
    f"{_DASHBOARD} {_stats_maps('fx_history', _SAVED_BAND)} FROM fx_history", "fx_history"
)
ORACLES["stats_variant"] = with_views(
    f"""
    WITH b AS (SELECT *, coalesce(nullif(risk_band, ''), {_band('predicted_severity', 'High')}) AS band
      FROM fx_history),
    l AS (SELECT predicted_severity, count(*) AS n, max((created_at, visit_id)) AS newest
      FROM fx_history GROUP BY predicted_severity)
    SELECT count(*) AS total_predictions,
      count(*) FILTER (WHERE band = 'High') AS high_risk_patients,
      count(*) FILTER (WHERE band = 'Medium') AS medium_risk_patients,
      count(*) FILTER (WHERE band = 'Low') AS low_risk_patients,
      CAST(printf('%.4f', sum(CAST(coalesce(risk_score, 0) AS DECIMAL(18, 6)))::DOUBLE / count(*)) AS DOUBLE)
        AS average_risk_score,
      (SELECT predicted_severity FROM l ORDER BY n DESC, newest DESC LIMIT 1) AS most_common_severity,
      max(created_at) AS latest_prediction_time,
      {_stats_maps('b', 'band')}
    FROM b
    """,
    "fx_history",
)
# The text form of a double rounds its exact value; only eighths can be ties, which go up.
_DAY_MEAN = (
    "CASE WHEN sum(phq9_total) * 8 % count(*) = 0"
    " THEN floor(sum(phq9_total)::DOUBLE / count(*) * 100 + 0.5) / 100.0::DOUBLE"
    " ELSE CAST(printf('%.2f', sum(phq9_total)::DOUBLE / count(*)) AS DOUBLE) END AS mean_total"
)
ORACLES["daily_activity"] = with_views(
    f"""
    SELECT coalesce(visit_date, strftime(created_at, '%Y-%m-%d')) AS visit_day, count(*) AS n_visits,
      {_DAY_MEAN}
    FROM fx_history GROUP BY 1
    """,
    "fx_history",
)
ORACLES["mean_nonzero_total"] = with_views(
    "SELECT count(*) AS n_nonzero, sum(phq9_total)::DOUBLE / count(*) AS mean_total"
    " FROM fx_history WHERE phq9_total <> 0",
    "fx_history",
)
ORACLES["history_search"] = with_views(
    f"""
    SELECT visit_id, patient_id, patient_name, visit_date, risk_band FROM fx_history
    WHERE contains(lower(patient_name), 'patient 1') AND predicted_severity = 'Severe'
      AND coalesce(nullif(risk_band, ''), {_band('predicted_severity', 'Low')}) = 'High'
      AND coalesce(visit_date, strftime(created_at, '%Y-%m-%d')) BETWEEN '1996-01-01' AND '2000-12-31'
    """,
    "fx_history",
)
ORACLES["visit_json"] = with_views(
    """
    SELECT '{"visit_id":"' || visit_id || '","patient_id":"' || patient_id || '","created_at":"'
      || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || '","phq9_total":' || phq9_total
      || ',"input_data":{"DPQ010":' || DPQ010 || ',"DPQ020":' || DPQ020 || '}}' AS document
    FROM fx_history
    """,
    "fx_history",
)

# Splits and features

_SPLIT = """
    cls AS (SELECT SEVERITY, count(*) AS n FROM clean GROUP BY SEVERITY),
    shr AS (SELECT *, sum(n) OVER () AS n_all, ceil(sum(n) OVER ()::DOUBLE * 0.3::DOUBLE) AS want,
      n::DOUBLE / (sum(n) OVER ())::DOUBLE * ceil(sum(n) OVER ()::DOUBLE * 0.3::DOUBLE) AS exact FROM cls),
    quo AS (SELECT SEVERITY, floor(exact) + CASE WHEN row_number() OVER (
        ORDER BY exact - floor(exact) DESC, SEVERITY) <= want - sum(floor(exact)) OVER ()
        THEN 1 ELSE 0 END AS n_test FROM shr),
    ord AS (SELECT SEQN, SEVERITY, row_number() OVER (PARTITION BY SEVERITY
        ORDER BY md5('42|' || SEQN), SEQN) AS rn FROM clean),
    spl AS (SELECT o.SEQN, o.SEVERITY, o.rn <= q.n_test AS is_test FROM ord o
      JOIN quo q ON o.SEVERITY = q.SEVERITY)
"""
ORACLES["stratified_split"] = clean_sql(f"WITH {_SPLIT} SELECT * FROM spl")
ORACLES["split_distribution"] = clean_sql(
    f"WITH {_SPLIT} SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS split,"
    " SEVERITY AS label, count(*) AS n FROM spl GROUP BY 1, 2"
)
_NUMERIC = " UNION ALL ".join(
    f"SELECT '{c}' AS col, {c} AS x FROM clean" for c in schema.NUMERIC_FEATURES
)
_CATEGORY = " UNION ALL ".join(
    f"SELECT '{c}' AS col, "
    + (
        "NULL::DOUBLE AS num, AGE_GROUP AS cat"
        if c == "AGE_GROUP"
        else f"{c} AS num, CAST(CAST({c} AS BIGINT) AS VARCHAR) AS cat"
    )
    + " FROM clean"
    for c in schema.CATEGORICAL_FEATURES
)
_FIT = f"""
    num AS ({_NUMERIC}),
    med AS (SELECT col, median(x) AS median FROM num GROUP BY col),
    dev AS (SELECT num.col, median, coalesce(x - median, 0) AS d FROM num JOIN med USING (col)),
    sums AS (SELECT col, median, count(*)::DOUBLE AS n, sum(d) AS s1, sum(d * d) AS s2 FROM dev
      GROUP BY col, median),
    stat AS (SELECT col, median, median + s1 / n AS mean,
      sqrt(greatest(0, s2 / n - (s1 / n) * (s1 / n))) AS std FROM sums),
    cat AS ({_CATEGORY}),
    catn AS (SELECT col, num, cat, count(*) AS n FROM cat WHERE cat IS NOT NULL GROUP BY col, num, cat),
    fill AS (SELECT col, cat AS most_frequent FROM (SELECT *, row_number() OVER (PARTITION BY col
      ORDER BY n DESC, num, cat) AS rn FROM catn) z WHERE rn = 1)
"""
ORACLES["fit_statistics"] = clean_sql(
    f"""WITH {_FIT}
    SELECT col AS "column", 'numeric' AS kind, median, mean, std, NULL AS most_frequent FROM stat
    UNION ALL SELECT col, 'categorical', NULL, NULL, NULL, most_frequent FROM fill"""
)
ORACLES["category_domains"] = clean_sql(
    f"""WITH {_FIT} SELECT col AS "column", CAST(row_number() OVER (PARTITION BY col ORDER BY num, cat)
      AS INT) AS place, cat AS category, n FROM catn"""
)
ORACLES["scaled_features"] = clean_sql(
    f"WITH {_FIT} SELECT SEQN, "
    + ", ".join(
        f"(coalesce({c}, (SELECT median FROM stat WHERE col = '{c}'))"
        f" - (SELECT mean FROM stat WHERE col = '{c}'))"
        f" / (SELECT CASE WHEN std = 0 THEN 1 ELSE std END FROM stat WHERE col = '{c}') AS num__{c}"
        for c in schema.NUMERIC_FEATURES
    )
    + " FROM clean"
)
_SEEN = {
    "RIAGENDR": ["1", "2"],
    "RIDRETH1": ["1", "2", "3", "4", "5"],
    "INDHHIN2": [str(i) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 15)],
    "DMDEDUC2": ["1", "2", "3", "4", "5"],
    "DMDMARTL": ["1", "2", "3", "4", "5", "6"],
    "AGE_GROUP": ["Under 18", "18-29", "30-44", "45-59", "60+"],
}
ORACLES["onehot_features"] = clean_sql(
    f"WITH {_FIT} SELECT SEQN, "
    + ", ".join(
        "CASE WHEN coalesce("
        + (c if c == "AGE_GROUP" else f"CAST(CAST({c} AS BIGINT) AS VARCHAR)")
        + f", (SELECT most_frequent FROM fill WHERE col = '{c}')) = '{v}' THEN 1.0::DOUBLE"
        f' ELSE 0.0::DOUBLE END AS "cat__{c}_{v}"'
        for c, values in _SEEN.items()
        for v in values
    )
    + " FROM clean"
)
ORACLES["label_index"] = clean_sql(
    "WITH l AS (SELECT SEVERITY, CAST(row_number() OVER (ORDER BY SEVERITY) - 1 AS INT) AS label"
    " FROM (SELECT DISTINCT SEVERITY FROM clean) d)"
    " SELECT SEQN, SEVERITY, label FROM clean JOIN l USING (SEVERITY)"
)

_NUMBERS = [*ITEMS, "RIDAGEYR"]
_CODES = ["RIAGENDR", "RIDRETH1", "DMDMARTL"]
ORACLES["smote_neighbours"] = clean_sql(
    "WITH points AS (SELECT SEVERITY, min(SEQN) AS vid, "
    + ", ".join(f"{c}" for c in [*_NUMBERS, *_CODES])
    + " FROM (SELECT SEVERITY, SEQN, "
    + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in _NUMBERS)
    + ", " + ", ".join(_CODES) + " FROM clean) c GROUP BY ALL),"
    " pairs AS (SELECT a.SEVERITY, a.vid, b.vid AS neighbour, sqrt("
    + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _NUMBERS)
    + " + " + " + ".join(
        f"CASE WHEN a.{c} IS NOT DISTINCT FROM b.{c} THEN 0 WHEN a.{c} IS NULL OR b.{c} IS NULL THEN 1 ELSE 2 END" for c in _CODES
    )
    + ") AS distance FROM points a JOIN points b ON a.SEVERITY = b.SEVERITY AND a.vid <> b.vid)"
    " SELECT SEVERITY, vid AS SEQN, neighbour, CAST(place AS INT) AS rank, distance FROM (SELECT *,"
    " row_number() OVER (PARTITION BY vid ORDER BY distance, neighbour) AS place FROM pairs) r WHERE place <= 5"
)
ORACLES["train_checks"] = clean_sql(
    f"WITH {_SPLIT}, c AS (SELECT SEVERITY, count(*) AS n FROM spl WHERE NOT is_test GROUP BY SEVERITY),"
    " s AS (SELECT CAST(CASE WHEN min(n) < 2 THEN sum(n) ELSE count(*) * max(n) END AS BIGINT) AS train_size FROM c)"
    " SELECT CAST(ordinal AS INT) AS ordinal, candidate, train_size, true AS measures_are_shares FROM s,"
    " (VALUES (0, 'Logistic Regression'), (1, 'Random Forest')) AS m(ordinal, candidate)"
)
ORACLES["train_fairness_groups"] = clean_sql(
    f"WITH {_SPLIT}, g AS ("
    + " UNION ALL ".join(
        f"SELECT '{g}' AS group_column, " + (g if g == "AGE_GROUP" else f"CAST(CAST({g} AS BIGINT) AS VARCHAR)")
        + " AS group_value FROM clean JOIN spl USING (SEQN) WHERE is_test"
        for g in GROUPS
    )
    + ") SELECT group_column, group_value, CASE WHEN group_column = 'AGE_GROUP' THEN group_value"
    f" {_LABEL_CASES} ELSE 'Unknown / Other (' || group_value || ')' END AS group_label,"
    " count(*) AS sample_size, true AS rates_are_shares FROM g WHERE group_value IS NOT NULL GROUP BY 1, 2"
)
ORACLES["score_batch_checks"] = with_views(
    f"WITH {_RULES} SELECT visit_id, patient_id, phq9_total, predicted_severity, risk_band,"
    " true AS probabilities_sum_to_one, true AS score_is_largest, true AS label_is_likeliest, true AS agreement_fits"
    " FROM judged",
    "fx_request",
)
ORACLES["smote_class_counts"] = clean_sql(
    f"WITH {_SPLIT}, c AS (SELECT SEVERITY, count(*) AS n FROM spl WHERE NOT is_test GROUP BY SEVERITY)"
    " SELECT SEVERITY, (SELECT max(n) FROM c) AS n_rows, (SELECT max(n) FROM c) - n AS n_synthetic FROM c"
)
ORACLES["audit_summary"] = with_views(
    f"""WITH {CLEAN}, {_SPLIT}, {FAIR},
    cells AS (SELECT unnest([{', '.join(ITEMS)}]) AS v FROM fx_questionnaire)
    SELECT (SELECT count(*) FROM fx_respondent) AS demographic_rows,
      (SELECT count(*) FROM fx_questionnaire) AS questionnaire_rows,
      (SELECT count(*) FROM clean) AS merged_valid_rows,
      (SELECT count(*) FROM cells WHERE v IS NULL OR v NOT IN (0, 1, 2, 3))
        AS invalid_or_missing_cell_count,
      (SELECT count(*) FROM fx_questionnaire WHERE {VALID}) AS complete_valid_rows,
      (SELECT coalesce(string_agg(t, ',' ORDER BY t), '') FROM
        (SELECT DISTINCT CAST(CAST(v AS DOUBLE) AS VARCHAR) AS t FROM cells
         WHERE v NOT IN (0, 1, 2, 3)) d) AS observed_invalid_values,
      (SELECT bool_and(PHQ9_TOTAL = {TOTAL}) FROM clean) AS totals_match,
      (SELECT count(*) FROM spl WHERE NOT is_test) AS train_rows,
      (SELECT count(*) FROM spl WHERE is_test) AS test_rows,
      (SELECT count(*) FROM spl a JOIN spl b ON a.SEQN = b.SEQN WHERE a.is_test AND NOT b.is_test)
        AS duplicate_key_count,
      (SELECT count(*) FROM report) AS fairness_rows,
      (SELECT count(*) FROM report WHERE fairness_flag = 'Low Sample Size') AS low_sample_size_rows,
      (SELECT count(*) FROM fx_scored WHERE y_true = y_pred) AS agreement_count,
      (SELECT count(*) FROM fx_scored WHERE y_true <> y_pred) AS mismatch_count
    """,
    "fx_scored",
)

# Streams: the same results as the tables give at once.

ORACLES["stream_daily_activity"] = with_views(
    f"""
    SELECT strftime(created_at, '%Y-%m-%d') AS visit_day, count(*) AS n_visits, {_DAY_MEAN}
    FROM fx_history
    GROUP BY 1
    """,
    "fx_history",
)
ORACLES["stream_visit_changes"] = with_views(
    f"""
    WITH {_TREND}
    SELECT patient_id, visit_id, created_at, total, previous_total, total - previous_total AS change,
      CASE WHEN previous_total IS NULL THEN 'insufficient_history'
        WHEN total < previous_total THEN 'improved' WHEN total > previous_total THEN 'worsened'
        ELSE 'no_change' END AS status
    FROM t
    """,
    "fx_history",
)
ORACLES["stream_running_counts"] = with_views(
    f"SELECT coalesce(nullif(risk_band, ''), {_band('predicted_severity', 'Low')}) AS risk_band,"
    " predicted_severity AS severity, count(*) AS n_visits FROM fx_history GROUP BY 1, 2",
    "fx_history",
)
ORACLES["stream_score_and_append"] = with_views(
    f"WITH {_RULES} SELECT j.visit_id, j.patient_id, j.phq9_total, j.predicted_severity, j.risk_band,"
    " r.created_at, strftime(r.created_at, '%Y-%m') AS visit_month"
    " FROM judged j JOIN fx_request r ON r.visit_id = j.visit_id",
    "fx_request",
)
