"""Evaluation: ground truth against raw and corrected predictions.

Pages are those with ground truth and a raw prediction. Rates are per page; their means are unweighted. Coverage counts
evaluated pages and all raw predictions. No ground truth, or evaluation switched off, gives a skipped report that still
counts the predictions. A page without a corrected prediction has null there; a page whose reference is empty has null
rates and still counts as evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T


def rates(pages: DataFrame, strip: bool = True, collapse: bool = True, metrics: tuple[str, ...] = ("cer", "wer")) -> DataFrame:
    """(page_id, <metric>_raw, <metric>_corrected) of pages (page_id, truth, raw, corrected)."""
    rate = {"cer": T.cer, "wer": T.wer}
    clean = pages.select("page_id", *(T.normalized(F.col(c), strip, collapse).alias(c) for c in ("truth", "raw", "corrected")))
    columns: list[Column] = [rate[m](F.col("truth"), F.col(side)).alias(f"{m}_{side}") for side in ("raw", "corrected") for m in metrics]
    return clean.select("page_id", *columns)


def per_page(truth: DataFrame, raw: DataFrame, corrected: DataFrame | None = None, strip: bool = True, collapse: bool = True, metrics: tuple[str, ...] = ("cer", "wer")) -> DataFrame:
    """The rates of (page_id, text) tables."""
    pages = truth.select("page_id", F.col("text").alias("truth")).join(raw.select("page_id", F.col("text").alias("raw")), "page_id")
    if corrected is not None:
        pages = pages.join(corrected.select("page_id", F.col("text").alias("corrected")), "page_id", "left")
    else:
        pages = pages.withColumn("corrected", F.lit(None).cast("string"))
    return rates(pages, strip, collapse, metrics)


def report(pages: DataFrame, raw: DataFrame, digits: int | None = None) -> DataFrame:
    """One row: evaluated, total_processed and the mean of each rate."""
    rates = [c for c in pages.columns if c != "page_id"]
    mean = lambda c: F.round(F.avg(c), digits) if digits is not None else F.avg(c)
    total = raw.agg(F.count("*").alias("total_processed"))
    found = pages.agg(F.count("*").alias("evaluated"), *(mean(c).alias(f"{c}_mean") for c in rates))
    return found.join(F.broadcast(total)).select("evaluated", "total_processed", *(f"{c}_mean" for c in rates))  # one row each


def skipped(raw: DataFrame, reason: str) -> DataFrame:
    return raw.agg(F.count("*").alias("total_processed")).select(F.lit(True).alias("skipped"), F.lit(reason).alias("reason"), F.lit(0).cast("long").alias("evaluated"), "total_processed")


def evaluate(truth: DataFrame | None, raw: DataFrame, corrected: DataFrame | None = None, enabled: bool = True, **options) -> tuple[DataFrame | None, DataFrame]:
    """(per-page rates or None, report)."""
    if not enabled:
        return None, skipped(raw, "evaluation is disabled")
    if truth is None or truth.isEmpty():
        return None, skipped(raw, "no ground truth")
    pages = per_page(truth, raw, corrected, **options)
    return pages, report(pages, raw)


def markdown(row: dict, rates: list[dict] = ()) -> str:
    """A report for people: coverage and means, and a line per page if given."""
    if row.get("skipped"):
        return f"# Evaluation\n\nSkipped: {row['reason']}. Pages processed: {row['total_processed']}.\n"
    lines = ["# Evaluation", "", f"Pages evaluated: {row['evaluated']} of {row['total_processed']}.", ""]
    lines += [f"- {k.removesuffix('_mean').replace('_', ' ')}: {v:.4f}" for k, v in row.items() if k.endswith("_mean") and v is not None]
    if rates:
        names = list(rates[0])
        lines += ["", "| " + " | ".join(names) + " |", "|" + " - |" * len(names)]
        lines += ["| " + " | ".join("" if r[n] is None else f"{r[n]:.4f}" if isinstance(r[n], float) else str(r[n]) for n in names) + " |" for r in rates]
    return "\n".join(lines) + "\n"
