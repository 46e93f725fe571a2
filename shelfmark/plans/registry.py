"""All queries of the engine, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.plans import q_composed, q_curation, q_experiments, q_profile, q_ranking

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**q_curation.Q, **q_ranking.Q, **q_profile.Q, **q_experiments.Q, **q_composed.Q}
ORACLES: dict[str, str] = {**q_curation.SQL, **q_ranking.SQL, **q_profile.SQL, **q_experiments.SQL, **q_composed.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genre popularity: the ten best unread items of each reader."""
    return QUERIES["bas_genre_popularity"](spark, sf_dir)
