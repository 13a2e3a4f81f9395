"""Label vocabularies and score decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
LEGITIMATE_WORDS = ["Good", "good", "Legitimate", "legitimate"]
PHISHING_WORDS = ["Bad", "bad", "Phishing", "phishing"]
# Spellings a CSV reader takes as a missing value.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# ----------------------------------------------------------------------------

# A numeric column may arrive as "0", "0.0", "1" or "1.0".
NUMERIC_LABEL = r"^[01](\.0*)?\z"


def yes_no_label(col: str) -> Column:
    return F.when(F.col(col) == "yes", 1).when(F.col(col) == "no", 0).cast("int")


def vocabulary_label(col: str) -> Column:
    """0 for the legitimate spellings, 1 for the phishing ones, else null (case matters)."""
    text = F.col(col).cast("string")
    return (
        F.when(text.isin(LEGITIMATE_WORDS), 0)
        .when(text.isin(PHISHING_WORDS), 1)
        .when(text.rlike(NUMERIC_LABEL), F.substring(text, 1, 1).try_cast("int"))
        .cast("int")
    )


def missing_to_null(col: str) -> Column:
    return F.when(~F.col(col).isin(MISSING_TOKENS), F.col(col))


def result_name(prediction: str | Column) -> Column:
    prediction = F.col(prediction) if isinstance(prediction, str) else prediction
    return F.when(prediction == 1, "Phishing").otherwise("Legitimate")


def percent(confidence: str | Column) -> Column:
    confidence = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.round(confidence * 100, 2)
