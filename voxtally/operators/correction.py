"""Model correction: predictions come as a table, one row per ``row_key``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.operators.cascade import correction_gate, signed_correction_gate
from voxtally.operators.lookups import BROADCAST_BYTES, gated_join
from voxtally.rules import Cascade

RESULT = ("consumer_score", "consumer_sentiment", "confidence", "_rule_fired")


def _corrected(df: DataFrame, applies, score) -> DataFrame:
    positive = F.col("_pred_label") == "positive"
    new = {
        "consumer_score": score(positive),
        "consumer_sentiment": F.when(positive, F.lit("Positive")).otherwise(F.lit("Negative")),
        "confidence": F.round("_pred_score", 3),
        "_rule_fired": F.concat(F.lit("bert:"), F.col("_pred_label")),
    }
    return df.select(
        *[
            F.when(applies, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
            for c in df.columns
            if c not in ("_pred_label", "_pred_score")
        ]
    )


def _with_predictions(
    df: DataFrame, predictions: DataFrame, row_key: str, least: float, gate: Column, max_bytes: int, hit_bytes: int
) -> DataFrame:
    """Predictions of the rows that pass ``gate``; of a large table only those travel, and no row that does not ask."""
    usable = predictions.where(F.col("score") > least).select(
        F.col("row_key").alias(row_key),
        F.lower("label").alias("_pred_label"),
        F.col("score").cast("double").alias("_pred_score"),
    )
    return gated_join(df, usable, row_key, gate, max_bytes, hit_bytes)


def correct_with_model(
    df: DataFrame, predictions: DataFrame, row_key: str, max_bytes: int = BROADCAST_BYTES, hit_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Rows of low confidence take a confident prediction as +0.35 or -0.35.

    Predictions that are not confident enough never reach the join.
    """
    gate = correction_gate(F.col("confidence"), F.col("validation_source"), F.col("Text_For_Analysis"))
    joined = _with_predictions(df, predictions, row_key, 0.75, gate, max_bytes, hit_bytes)
    applies = gate & F.col("_pred_label").isNotNull()
    return _corrected(joined, applies, lambda pos: F.when(pos, F.lit(0.35)).otherwise(F.lit(-0.35)))


def correct_with_signed_model(
    df: DataFrame, predictions: DataFrame, row_key: str, max_bytes: int = BROADCAST_BYTES, hit_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Rows near zero take the prediction's own confidence, with its sign, as their score."""
    gate = signed_correction_gate(F.col("consumer_score"), F.col("validation_source"), F.col("Language"))
    joined = _with_predictions(df, predictions, row_key, float("-inf"), gate, max_bytes, hit_bytes)
    applies = gate & F.col("_pred_label").isNotNull()
    return _corrected(
        joined,
        applies,
        lambda pos: F.round(F.when(pos, F.col("_pred_score")).otherwise(-F.col("_pred_score")), 3),
    )


def reenforce_triggers(df: DataFrame, cascade: Cascade, text: str = "Text_For_Analysis") -> DataFrame:
    """Triggers have the last word on English rows without an override; confidence stays."""
    open_row = (F.col("validation_source") == "Model") & (F.col("Language") == "en")
    tiers = [(t, t.phrases.found_in(F.col(text))) for t in cascade.tiers]
    labels = {"negative": "Negative", "neutral": "Neutral"}

    def chain(value, old: str):
        out = F.when(~open_row, F.col(old))
        for tier, found in tiers:
            out = out.when(found, value(tier))
        return out.otherwise(F.col(old))

    new = {
        "consumer_score": chain(lambda t: F.lit(t.score), "consumer_score"),
        "consumer_sentiment": chain(lambda t: F.lit(labels[t.name]), "consumer_sentiment"),
        "_rule_fired": chain(lambda t: F.lit(t.rule), "_rule_fired"),
    }
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])
