"""Expressions over one score row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.errors import ConfigError

STATUSES = ("ok", "missing", "error")
# The score that stands in for an unscored row under each policy.
FILL = {"as-real": 0.0, "as-fake": 1.0, "as-chance": 0.5}
LOGIT_CLIP = 1e-6


def apply_missing_policy(rows: DataFrame, policy: str = "exclude") -> DataFrame:
    """Rows ready for a metric: unscored ones dropped, or kept with the policy's score."""
    if policy == "exclude":
        return rows.where(F.col("status") == "ok")
    if policy not in FILL:
        raise ConfigError(f"unknown policy {policy!r}; known: exclude, {', '.join(FILL)}")
    filled = F.when(F.col("status") == "ok", F.col("score")).otherwise(F.lit(FILL[policy]))
    return rows.withColumn("score", filled)


def logit(p: Column, clip: float = LOGIT_CLIP) -> Column:
    """Log-odds of a score kept off 0 and 1; null for null (greatest and least skip nulls)."""
    inside = F.least(F.greatest(p, F.lit(clip)), F.lit(1.0 - clip))
    return F.when(p.isNotNull(), F.ln(inside / (1.0 - inside)))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def softplus(z: Column) -> Column:
    """ln(1 + e^z) that never overflows."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def bce_loss(z: Column, y: Column, pos_weight: float = 1.0) -> Column:
    """Binary cross-entropy of a logit, fakes weighted by `pos_weight`."""
    return pos_weight * y * softplus(-z) + (1.0 - y) * softplus(z)


def focal_loss(z: Column, y: Column, gamma: float = 2.0, alpha: float | None = None) -> Column:
    """Cross-entropy scaled down where the right class is already likely."""
    ce = bce_loss(z, y)
    p = sigmoid(z)
    right = p * y + (1.0 - p) * (1.0 - y)
    loss = ce * F.pow(1.0 - right, F.lit(float(gamma)))
    if alpha is None:
        return loss
    return loss * (alpha * y + (1.0 - alpha) * (1.0 - y))


def smoothed_bce_loss(z: Column, y: Column, smoothing: float = 0.1) -> Column:
    """Cross-entropy against labels pulled towards a half."""
    return bce_loss(z, y * (1.0 - smoothing) + 0.5 * smoothing)


def import_status(raw: Column) -> Column:
    """A foreign status, trimmed and lower-cased; empty counts as ok."""
    tidy = F.lower(F.trim(raw))
    return F.when(raw.isNull() | (raw == ""), F.lit("ok")).otherwise(tidy)


def import_score(raw: Column, polarity: str = "fake-high") -> Column:
    """A foreign score as P(fake); null when it is no number."""
    if polarity not in ("fake-high", "real-high"):
        raise ConfigError(f"unknown polarity {polarity!r}; known: fake-high, real-high")
    value = raw.try_cast("double")
    return value if polarity == "fake-high" else 1.0 - value


def compose_key(template: str, columns: list[str]) -> Column:
    """A key column by name, or a text with `{column}` placeholders."""
    if "{" not in template:
        if template not in columns:
            raise ConfigError(f"column {template!r} is not in the table: {', '.join(columns)}")
        return F.col(template)
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, closed, rest = rest.partition("}")
        if not closed or name not in columns:
            raise ConfigError(f"template {template!r} needs column {name!r}: {', '.join(columns)}")
        if before:
            parts.append(F.lit(before))
        parts.append(F.col(name).cast("string"))
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def row_problems() -> list[Column]:
    """What makes a score row invalid, one nullable text per rule."""
    s, status = F.col("score"), F.col("status")
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf")))
    return [
        F.when(F.col("label").isNull(), F.lit("label is not an integer")),
        F.when(~F.coalesce(status.isin(*STATUSES), F.lit(False)), F.lit("unknown status")),
        F.when((status == "ok") & ~(finite & s.between(0.0, 1.0)), F.lit("ok needs a score in [0, 1]")),
        F.when((status != "ok") & s.isNotNull(), F.lit("only ok rows carry a score")),
    ]
