"""Evaluation of predictions and scores against labels, by column name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import order
from tracemill.session import materialise


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """True counts, also when only one class occurs."""
    y, p = F.col(label), F.col(pred)
    return df.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def evaluate(df: DataFrame, label: str = "label", pred: str = "pred", score: str | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 where undefined), counts, and AUC if a score column is given."""

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out = confusion(df, label, pred).select(
        ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "tn",
        "fp",
        "fn",
        "tp",
    )
    if score is not None:
        out = out.withColumn("auc", roc_auc(df, label, score).scalar())
    return out


def by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives at each distinct score, with the totals at lower scores."""
    counts = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return order.running_totals(materialise(counts), "score", ["pos", "neg"])


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve with tied scores counted half; 0 when a class is missing."""
    pairs = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / F.lit(2.0)))
    area = F.try_divide(pairs, F.sum("pos").cast("double") * F.sum("neg"))
    return by_score(df, label, score).agg(F.coalesce(area, F.lit(0.0)).alias("auc"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One point per distinct score: rates of rows at or above the threshold."""
    ranked = by_score(df, label, score)
    totals = df.agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")
    )
    p, n = totals.select("p").scalar(), totals.select("n").scalar()
    return ranked.select(
        F.try_divide((n - F.col("before_neg")).cast("double"), n).alias("fpr"),
        F.try_divide((p - F.col("before_pos")).cast("double"), p).alias("tpr"),
        F.col("score").alias("threshold"),
    )


def min_max_flipped(df: DataFrame, score: str = "score", name: str = "proba") -> DataFrame:
    """Scale scores of the batch to [0, 1] and flip them; constant scores all give 1."""
    low, high = df.agg(F.min(score)).scalar(), df.agg(F.max(score)).scalar()
    scaled = F.coalesce(F.try_divide(F.col(score) - low, high - low), F.lit(0.0))
    return df.withColumn(name, F.lit(1.0) - scaled)
