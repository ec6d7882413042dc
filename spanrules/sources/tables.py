"""Parquet tables of a data folder, and the span table derived from them."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from spanrules.sources.spans import tpch_spans


def load_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(data_dir, f"{name}.parquet"))


def spans_table(spark: SparkSession, data_dir: str, service: Sequence[str] = ("l_returnflag",)) -> DataFrame:
    """Raw spans (index schema) built from ``orders`` and ``lineitem`` of ``data_dir``; nothing is
    written, so filters and column pruning reach the two tables."""
    return tpch_spans(load_table(spark, data_dir, "orders"), load_table(spark, data_dir, "lineitem"), service)
