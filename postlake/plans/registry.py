"""Query registry: every operator module contributes ``QUERIES`` and ``ORACLE``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postlake.operators import classifier, cleaning, dictionary, lru, media, model, relational, scoring, stages, templates
from postlake.functions import sql
from postlake.sources import variants
from postlake.streaming import threads

MODULES: list = [cleaning, dictionary, relational, scoring, model, lru, classifier, stages, media, templates, threads, variants, sql]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in (m.ORACLE if hasattr(m, "ORACLE") else m.oracles()).items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.entry(spark, sf_dir)
