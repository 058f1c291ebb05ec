"""Column names, code lists and texts shared by all operators."""

from __future__ import annotations

# --- Fixed values: names, codes, limits and sentences of the questionnaire, the
# --- survey files and the reports. They must stay exactly as they are.

KEY = "SEQN"
AGE = "RIDAGEYR"
AGE_GROUP = "AGE_GROUP"
TOTAL = "PHQ9_TOTAL"
TARGET = "SEVERITY"

ITEMS = [
    "DPQ010", "DPQ020", "DPQ030", "DPQ040", "DPQ050",
    "DPQ060", "DPQ070", "DPQ080", "DPQ090",
]
DEMOGRAPHIC_CODES = ["RIAGENDR", "RIDRETH1", "INDHHIN2", "DMDEDUC2", "DMDMARTL"]

MISSING_CODES = {
    "RIAGENDR": (7, 9),
    "RIDRETH1": (7, 9),
    "INDHHIN2": (77, 99),
    "DMDEDUC2": (7, 9),
    "DMDMARTL": (77, 99),
}

ITEM_VALUES = (0, 1, 2, 3)
MAX_TOTAL = 27
MAX_AGE = 120

ITEM_QUESTIONS = {
    "DPQ010": "Little interest or pleasure in doing things",
    "DPQ020": "Feeling down, depressed, or hopeless",
    "DPQ030": "Trouble falling or staying asleep, or sleeping too much",
    "DPQ040": "Feeling tired or having little energy",
    "DPQ050": "Poor appetite or overeating",
    "DPQ060": "Feeling bad about yourself",
    "DPQ070": "Trouble concentrating",
    "DPQ080": "Moving or speaking slowly, or being fidgety/restless",
    "DPQ090": "Thoughts that you would be better off dead or hurting yourself",
}
ITEM_MEANINGS = {
    0: "Not at all",
    1: "Several days",
    2: "More than half the days",
    3: "Nearly every day",
}

# Severity levels with the highest total of each, mildest first.
SEVERITY_TOPS = [
    ("Minimal", 4),
    ("Mild", 9),
    ("Moderate", 14),
    ("Moderately Severe", 19),
    ("Severe", 27),
]
HIGH_RISK = ("Moderate", "Moderately Severe", "Severe")

# Label of each age group with its highest whole age; the last one is open.
AGE_GROUP_TOPS = [("Under 18", 17), ("18-29", 29), ("30-44", 44), ("45-59", 59), ("60+", None)]

WARNINGS = {
    "low": "Low warning: monitor symptoms and seek support if symptoms persist.",
    "moderate": "Follow-up suggested: consider contacting a qualified mental health professional.",
    "other": "Urgent follow-up advised: contact a qualified mental health professional promptly.",
}
RECOMMENDATIONS = {
    "Minimal": "Continue routine wellness monitoring.",
    "Mild": "Schedule follow-up if symptoms continue or increase.",
    "Moderate": "Mental health follow-up is suggested.",
    "other": "Immediate mental health follow-up is advised.",
}
AGREES_NOTE = "Model estimate agrees with PHQ-9 scoring."
DIFFERS_NOTE = (
    "Model estimate differs from PHQ-9 scoring; clinical screening should follow the PHQ-9 score."
)
NOT_ENOUGH_VISITS = "At least two saved visits are needed for comparison."

PATIENT_ID_PREFIX = "MHQ"
SLUG_LENGTH = 18

FAIRNESS_GROUPS = ["RIAGENDR", "AGE_GROUP", "RIDRETH1", "INDHHIN2"]
MIN_GROUP_SIZE = 20
GAP_LIMIT = 0.10
BIAS_POINTS = 15.0
SUSPICIOUS_ACCURACY = 0.95
GROUP_LABELS = {
    "RIAGENDR": {1: "Male", 2: "Female"},
    "RIDRETH1": {
        1: "Mexican American",
        2: "Other Hispanic",
        3: "Non-Hispanic White",
        4: "Non-Hispanic Black",
        5: "Other Race / Multi-Racial",
    },
    "INDHHIN2": {
        1: "$0 to $4,999",
        2: "$5,000 to $9,999",
        3: "$10,000 to $14,999",
        4: "$15,000 to $19,999",
        5: "$20,000 to $24,999",
        6: "$25,000 to $34,999",
        7: "$35,000 to $44,999",
        8: "$45,000 to $54,999",
        9: "$55,000 to $64,999",
        10: "$65,000 to $74,999",
        12: "$20,000 and over",
        13: "Under $20,000",
        14: "$75,000 to $99,999",
        15: "$100,000 and over",
        77: "Refused",
        99: "Unknown",
    },
}
BIAS_FOUND = (
    "Some groups show meaningfully different risk rates. "
    "Review fairness details before using this result."
)
BIAS_NOT_FOUND = "No large risk-rate gap detected in the current fairness report."
BIAS_UNKNOWN = "Fairness report is not available yet."
LEAKAGE_CAVEAT = (
    "Current model uses PHQ-9 answers as features while SEVERITY is derived from PHQ9_TOTAL. "
    "High accuracy is expected because the model can learn the PHQ-9 scoring rule. This is "
    "appropriate for demo screening/classification, not independent clinical prediction."
)
PRIMARY_SEVERITY_NOTE = (
    "API predicted_severity now follows PHQ-9 scoring boundaries as the primary screening "
    "result. model_predicted_severity is retained as the supporting trained model estimate."
)
BOUNDARY_TOTALS = (0, 5, 10, 15, 20, 27)
BOUNDARY_PERSON = {
    "RIDAGEYR": 35, "RIAGENDR": 2, "RIDRETH1": 3, "INDHHIN2": 5, "DMDEDUC2": 4, "DMDMARTL": 1,
}
STATS_WINDOW = 500

# --- End of fixed values.

DEMOGRAPHIC_COLUMNS = [KEY, AGE, *DEMOGRAPHIC_CODES]
QUESTIONNAIRE_COLUMNS = [KEY, *ITEMS]
NUMERIC_FEATURES = [AGE, *ITEMS]
CATEGORICAL_FEATURES = [*DEMOGRAPHIC_CODES, AGE_GROUP]
FEATURES = [AGE, *DEMOGRAPHIC_CODES, AGE_GROUP, *ITEMS]
RAW_OUTPUT = [KEY, *FEATURES, TOTAL, TARGET]

SEVERITIES = [name for name, _ in SEVERITY_TOPS]
# Class order of the label encoder is alphabetical, not by rank.
CLASS_LABELS = sorted(SEVERITIES)
