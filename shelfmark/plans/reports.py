"""Reports as Markdown, made of small result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.sources.files import markdown

#: The label of the model in a summary, the first that is there.
MODEL_LABELS = ("hybrid", "model", "content_only")


def model_label(summary: DataFrame) -> str:
    have = {r[0] for r in summary.select("system").distinct().collect()}
    return next((m for m in MODEL_LABELS if m in have), sorted(have)[0])


def status(summary: DataFrame, verdicts: DataFrame, counts: dict[str, int]) -> str:
    """Volumes, metrics by system and k, and the verdict at each k."""
    won = all(r["wins"] for r in verdicts.collect())
    volume = "\n".join(f"- {k}: {v:,}" for k, v in counts.items())
    return f"# Status\n\n{volume}\n\n## Metrics\n\n{markdown(summary.orderBy('k', 'system'))}\n\n## Verdict: {'validated' if won else 'not validated'}\n\n{markdown(verdicts.orderBy('k'))}\n"


def graph_report(summary: DataFrame, sensitivity: DataFrame, nodes: DataFrame, titles: DataFrame, n: int = 10) -> str:
    """Structure, thresholds, and the titles of highest rank."""
    best = nodes.orderBy(F.desc(F.round("rank", 9)), "id").limit(n).join(titles.select(F.col("book_id").alias("id"), "title"), "id", "left").orderBy(F.desc("rank"), "id")
    return f"# Graph\n\n{markdown(summary)}\n\n## Thresholds\n\n{markdown(sensitivity.orderBy('threshold'))}\n\n## Highest ranks\n\n{markdown(best.select('title', 'rank'))}\n"
