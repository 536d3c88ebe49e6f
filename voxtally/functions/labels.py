"""Labels, scores and bands, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally import fixed_values as fixed


def _label(score: Column, bounds: Sequence[float]) -> Column:
    chain = F.when(score.isNull() | F.isnan(score), F.lit("Neutral"))
    for bound, label in zip(bounds, fixed.LABELS):
        chain = chain.when(score >= bound, F.lit(label))
    return chain.otherwise(F.lit(fixed.LABELS[-1]))


def label_of(score: Column) -> Column:
    return _label(score, fixed.LABEL_BOUNDS)


def wide_label_of(score: Column) -> Column:
    """Labels on the scale from -10 to 10; give it the score before rounding."""
    return _label(score, fixed.WIDE_LABEL_BOUNDS)


def score_of(label: Column, scale: float = 1.0) -> Column:
    chain = F.lit(None).cast("double")
    for name, score in fixed.LABEL_SCORES.items():
        chain = F.when(label == name, F.lit(score * scale)).otherwise(chain)
    return F.coalesce(chain, F.lit(0.0))


def decorated(label: Column, names: Mapping[str, str] = fixed.DISPLAY_LABELS) -> Column:
    shown = F.lit(None).cast("string")
    for name, display in names.items():
        shown = F.when(label == name, F.lit(display)).otherwise(shown)
    return F.coalesce(shown, label)


def normalised_score(score: Column, wide: bool = False) -> Column:
    """Score on the scale from -1 to 1."""
    scaled = score / 10.0 if wide else score
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), scaled))


def percent_position(score: Column, wide: bool = False) -> Column:
    return F.floor((normalised_score(score, wide) + 1.0) / 2.0 * 100.0).cast("int")


def colour_band(score: Column, wide: bool = False) -> Column:
    norm = normalised_score(score, wide)
    return (
        F.when(norm >= 0.2, F.lit("positive"))
        .when(norm <= -0.2, F.lit("negative"))
        .otherwise(F.lit("middle"))
    )


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence > 0.7, F.lit("High"))
        .when(confidence < 0.3, F.lit("Low"))
        .when(confidence.isNotNull(), F.lit("Medium"))
    )


def in_band(confidence: Column, band: str) -> Column:
    """Whether a confidence lies in a band, as comparisons that a scan understands."""
    tests = {"High": confidence > 0.7, "Low": confidence < 0.3, "Medium": (confidence >= 0.3) & (confidence <= 0.7)}
    return tests.get(band, F.lit(False))


def dead_zone(score: Column, width: float = 0.05) -> Column:
    return F.when(F.abs(score) < width, F.lit(0.0)).otherwise(score)
