"""Span sources: the raw span table, its time-interval scan and the root spans of each trace.

The raw span table has the columns of a tracing index: ``traceId, name, duration, id, kind,
timestamp, parentId, experiment``; durations and timestamps are integer microseconds. Any
``spark.read`` format works (parquet, a search-index connector, ...): the format name and its
options are arguments, so the connector package is the caller's choice.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN_COLUMNS = ["traceId", "endpoint", "duration", "id", "kind", "timestamp", "parentId"]


def to_micros(bound) -> int:
    """Interval bound as integer microseconds since the epoch.

    ``datetime`` values without a zone are read as UTC (the reference used the machine's zone);
    ints are taken as microseconds already.
    """
    if isinstance(bound, _dt.datetime):
        if bound.tzinfo is None:
            bound = bound.replace(tzinfo=_dt.timezone.utc)
        delta = bound - _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)
        return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
    return int(bound)


def read_spans(spark: SparkSession, path: str | None = None, fmt: str = "parquet",
               options: Mapping[str, str] | None = None) -> DataFrame:
    """Raw span table from any batch source (``fmt`` = ``parquet``, ``es``, ``delta``, ...)."""
    reader = spark.read.format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    return reader.load(path) if path is not None else reader.load()


def _in_interval(from_, to) -> Column:
    """Both ends inclusive; an end that is None is open."""
    t = F.col("timestamp")
    keep = t.isNotNull() if from_ is None else t >= F.lit(to_micros(from_))
    return keep if to is None else keep & (t <= F.lit(to_micros(to)))


def spans_by_interval(raw: DataFrame, from_, to) -> DataFrame:
    """Spans whose start lies in ``[from_, to]`` (both ends inclusive, None: open), ``name`` as ``endpoint``."""
    return (raw.filter(_in_interval(from_, to))
               .select("traceId", F.col("name").alias("endpoint"), "duration", "id", "kind",
                       "timestamp", "parentId"))


def root_experiments(raw: DataFrame, from_, to) -> DataFrame:
    """``(traceId, experiment)`` of the root SERVER spans (no parent) in the interval.

    Filters run before the projection, so the same scan serves both this and
    :func:`spans_by_interval` and the predicates reach the source.
    """
    return (raw.filter(_in_interval(from_, to)
                       & F.col("parentId").isNull()
                       & (F.col("kind") == F.lit("SERVER")))
               .select("traceId", "experiment"))


def timestamp_micros(ts: Column) -> Column:
    """``timestamp_ntz`` as epoch microseconds, independent of the session time zone."""
    # an NTZ literal: no session-zone conversion on either side of the difference
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin spread of a scan that has fewer splits than cores (one unsplittable file).

    Large inputs already have many splits and are returned as they are, so at scale no extra
    shuffle is added; round robin is indifferent to key skew. The join that follows is left to
    AQE (broadcast when one side is measured small, else sort-merge with skew splitting).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def tpch_spans(orders: DataFrame, lineitem: DataFrame, service: Sequence[str] = ("l_returnflag",)) -> DataFrame:
    """Spans derived from ``orders`` and ``lineitem``: one trace per order that has lines.

    * root SERVER ``checkout`` span: duration = sum of the rounded line prices + rounded order
      price, carries ``o_orderpriority`` as ``experiment``;
    * per line a CLIENT span ``svc_<returnflag>`` (rounded price + 500, parent = root) and a SERVER
      span of the same name (rounded price, parent = the client span); ``service`` names other columns
      of the line that its service is told by.

    Lines and orders meet in one join on the order key; the root durations come from a partial
    aggregate of the joined lines, so an order with very many lines is combined map-side.
    """
    o = orders.select(F.col("o_orderkey").alias("k"),
                      F.round("o_totalprice").cast("bigint").alias("tp"),
                      timestamp_micros(F.col("o_orderdate")).alias("ts"),
                      F.col("o_orderpriority").alias("experiment"))
    lines = (spread(lineitem).select(F.col("l_orderkey").alias("k"),
                                     F.col("l_linenumber").cast("bigint").alias("ln"),
                                     F.round("l_extendedprice").cast("bigint").alias("ep"),
                                     F.concat(F.lit("svc"), *[F.concat(F.lit("_"), F.col(c).cast("string")) for c in service])
                                     .alias("name"))
                                     .join(o, "k"))
    key = F.col("k").cast("string")
    roots = (lines.groupBy("k", "tp", "ts", "experiment")
                  .agg(F.sum("ep").alias("lines_ep"))
                  .select(key.alias("traceId"), F.lit("checkout").alias("name"),
                          (F.col("lines_ep") + F.col("tp")).alias("duration"),
                          F.concat(F.lit("r"), key).alias("id"), F.lit("SERVER").alias("kind"),
                          F.col("ts").alias("timestamp"), F.lit(None).cast("string").alias("parentId"),
                          "experiment"))
    children = lines.select(
        key.alias("traceId"), "name", "ep", "ts", "ln", "k",
        F.explode(F.array(F.lit("CLIENT"), F.lit("SERVER"))).alias("kind"))
    is_client = F.col("kind") == F.lit("CLIENT")
    children = children.select(
        "traceId", "name",
        (F.col("ep") + F.when(is_client, F.lit(500)).otherwise(F.lit(0))).cast("bigint").alias("duration"),
        F.concat(F.when(is_client, F.lit("c")).otherwise(F.lit("s")), F.col("traceId")).alias("id"),
        "kind",
        (F.col("ts") + F.col("ln")).alias("timestamp"),
        F.concat(F.when(is_client, F.lit("r")).otherwise(F.lit("c")), F.col("traceId")).alias("parentId"),
        F.lit(None).cast("string").alias("experiment"))
    return roots.unionByName(children)
