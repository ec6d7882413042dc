"""Running values over a global order: positions, running sums, last values, without one task per group.

Rows are dealt by ranges of (group, order), so a group of any size spreads over many tasks. Within a range
a window gives the running value; what the ranges before it add is one row per (range, group), summed up in
turn and joined back. ``rows`` may be large, the table of ranges has at most ranges + groups rows. Rows that
are counted to fit one range are not dealt at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanrules.session import cut_lineage

ROWS_PER_RANGE = 1 << 20
BROADCAST_ROWS = 1 << 16  # rows of the table of ranges (about 100 bytes each) that are broadcast


def _ranges(rows: DataFrame, n: int, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` (with a row number ``_r``), written, with the range ``_part`` of each."""
    # equal keys may hold any share of the rows: the row number deals them out
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_r")]
    return cut_lineage(rows.repartitionByRange(1 + n // ROWS_PER_RANGE, *keys).withColumn("_part", F.spark_partition_id()))


def running(rows: DataFrame, group: str, order: Sequence[str], sums: Mapping[str, str] | None = None,
            lasts: Mapping[str, str] | None = None, mins: Mapping[str, str] | None = None) -> DataFrame:
    """``rows`` with running values by ``order`` in each ``group``, the row itself included: ``sums`` maps
    new names to columns that are summed, ``mins`` to columns whose least value, ``lasts`` to columns whose
    last value that is not null is taken. Rows of equal order keys come in some order."""
    wanted = [("sum", new, c) for new, c in (sums or {}).items()]
    wanted += [("min", new, c) for new, c in (mins or {}).items()]
    wanted += [("last", new, c) for new, c in (lasts or {}).items()]
    columns = [F.col(f"`{c}`") for c in rows.columns]
    rows = cut_lineage(rows).withColumn("_r", F.monotonically_increasing_id())
    n = rows.count()

    def over(window):
        window = window.orderBy(*[F.col(c).asc_nulls_first() for c in (*order, "_r")]).rowsBetween(Window.unboundedPreceding, 0)
        how = {"sum": F.sum, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
        return {new: how[kind](c).over(window) for kind, new, c in wanted}

    if n <= ROWS_PER_RANGE:
        found = over(Window.partitionBy(group))
        return rows.select(*columns, *[(F.coalesce(found[new], F.lit(0)) if kind == "sum" else found[new]).alias(new)
                                       for kind, new, _ in wanted])
    dealt = _ranges(rows, n, group, order)
    out = dealt.select("*", *[x.alias(f"_here_{new}") for new, x in over(Window.partitionBy("_part", group)).items()])
    at = F.struct(*order, "_r")
    whole = {"sum": F.sum, "min": F.min, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))}
    parts = dealt.groupBy("_part", F.col(group).alias("_g")).agg(
        F.count(F.lit(1)).alias("_n"), *[whole[kind](c).alias(f"_all_{new}") for kind, new, c in wanted])
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = {"sum": F.sum, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    parts = cut_lineage(parts.select(F.col("_part").alias("_p"), "_g",
                                     *[carry[kind](f"_all_{new}").over(before).alias(f"_before_{new}") for kind, new, _ in wanted]))
    if parts.count() <= BROADCAST_ROWS:
        parts = F.broadcast(parts)
    out = out.join(parts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))

    def joined(kind: str, new: str) -> Column:
        here, earlier = F.col(f"_here_{new}"), F.col(f"_before_{new}")
        if kind == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0))
        return F.least(here, earlier) if kind == "min" else F.coalesce(here, earlier)

    return out.select(*columns, *[joined(kind, new).alias(new) for kind, new, _ in wanted])


def positions(rows: DataFrame, group: str, order: Sequence[str], name: str = "pos") -> DataFrame:
    """``rows`` with their position, from 1, by ``order`` in each ``group``."""
    one = running(rows.withColumn("_one", F.lit(1).cast("long")), group, order, sums={name: "_one"})
    return one.drop("_one")


def neighbours(rows: DataFrame, group: str, order: Sequence[str], value: Column, before: str, after: str) -> DataFrame:
    """``rows`` with ``value`` of the row before and after each by ``order`` in its ``group``, null at the ends."""
    rows = cut_lineage(rows)
    if rows.count() <= ROWS_PER_RANGE:
        place = Window.partitionBy(group).orderBy(*[F.col(c).asc_nulls_first() for c in order])
        return rows.withColumn(before, F.lag(value).over(place)).withColumn(after, F.lead(value).over(place))
    placed = cut_lineage(positions(rows, group, order, "_pos"))
    near = placed.select(F.col(group).alias("_g2"), F.col("_pos").alias("_at"), value.alias("_near"))
    here = F.col(group).eqNullSafe(F.col("_g2")) & (F.col("_pos") == F.col("_at"))
    for name, step in ((before, 1), (after, -1)):
        moved = near.select("_g2", (F.col("_at") + step).alias("_at"), F.col("_near").alias(name))
        placed = placed.join(moved, here, "left").drop("_g2", "_at")
    return placed.drop("_pos")
