"""Exact deduplication by two-pass Bloom filtering.

Pass 1 writes one light row per document (id, SHA-256 of the whole text), hashes the digest
into ``HASHES`` cells of a Bloom filter and keeps the cells that two or more rows fall into.
The counts combine map-side, so a text that a third of all rows share is one row per task.
The repeated cells become bitmaps (``bitmap_construct_agg``).

Pass 2 probes the filter: a row whose cells are not all repeated has a text of its own and
passes straight through; only the others shuffle, to be grouped by their digest.

The filter is sized by the row count, ``BITS_PER_ROW`` bits a row, up to ``MAX_BITS`` (64 MiB):
this bounds what is broadcast. A larger corpus fills the filter more densely; then more light
rows shuffle, and the result stays the same.

Defined cases: a null text is the empty text; rows are equal when their texts are identical
(no normalisation); the row with the largest id stays, a null id losing to any other; rows
that repeat both id and text count one by one and share their fate, but for ``drop_copies`` with
``one_row``, where one of them stays; an empty table gives an empty result; other columns of the table pass through ``drop_copies`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrules.llm.common import broadcast_if_small, fresh, whole_text
from spanrules.session import cut_lineage

HASHES = 2
BITS_PER_ROW = 32
MIN_BITS = 1 << 17
MAX_BITS = 1 << 29


@dataclass
class Copies:
    """``rows``: (id, sha) of every row, written; ``filter``: (bucket, bits); ``groups``:
    (sha, keep_id, group_size) of texts that occur twice or more, written."""

    rows: DataFrame
    filter: DataFrame
    cells: int
    groups: DataFrame


def text_digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(whole_text(text), 256))


def _cell(sha: Column, i: int, cells: int) -> Column:
    """Cell of hash function ``i``; each function has a range of its own. Counted from 1."""
    return F.pmod(F.xxhash64(sha, F.lit(i)), F.lit(cells)) + F.lit(i * cells + 1)


def _bit_set(bits: Column, cell: Column) -> Column:
    pos = F.bitmap_bit_position(cell)
    byte = F.substring(bits, (pos / 8).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), (pos % 8).cast("int")) == 1


def _size(n: int) -> int:
    bits = MIN_BITS
    while bits < n * BITS_PER_ROW and bits < MAX_BITS:
        bits *= 2
    return bits // HASHES


def _split(rows: DataFrame, filt: DataFrame, sha: str, cells: int, maybe: str = "maybe") -> DataFrame:
    """``rows`` with a boolean ``maybe``: every cell of the row is a repeated cell."""
    bucket, bits = fresh([*rows.columns, maybe], "bucket", "bits")
    out = rows.withColumn(maybe, F.lit(True))
    probe = F.broadcast(filt.toDF(bucket, bits))  # at most MAX_BITS / 8 bytes
    for i in range(HASHES):
        cell = _cell(F.col(sha), i, cells)
        out = (out.join(probe, F.bitmap_bucket_number(cell) == F.col(bucket), "left")
               .withColumn(maybe, F.col(maybe) & F.coalesce(_bit_set(F.col(bits), cell), F.lit(False)))
               .drop(bucket, bits))
    return out


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Copies:
    """Both passes over ``docs``."""
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"), text_digest(text_col).alias("sha")))
    cells = _size(rows.count())
    repeated = (rows.select(F.explode(F.array(*[_cell(F.col("sha"), i, cells) for i in range(HASHES)]))
                            .alias("cell"))
                .groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    filt = cut_lineage(repeated.groupBy(F.bitmap_bucket_number("cell").alias("bucket"))
                       .agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")))
    groups = (_split(rows, filt, "sha", cells).where("maybe")
              .groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .where("group_size > 1"))
    return Copies(rows, filt, cells, cut_lineage(groups))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept, text_sha256``."""
    found = find_copies(docs, id_col, text_col)
    rows = _split(found.rows, found.filter, "sha", found.cells)
    alone = rows.where(~F.col("maybe")).select(
        "id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    # both sides are plain scans under their exchange, so AQE splits the partition of a hot digest
    shared = (rows.where("maybe").join(found.groups, "sha", "left")
              .select("id", "sha",
                      F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                      F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")))
    return alone.unionByName(shared).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_row: bool = False) -> DataFrame:
    """``docs`` without the rows whose text a row with a larger id repeats, columns unchanged. With
    ``one_row``, of rows that repeat both id and text the one that is least by all its columns stays."""
    found = find_copies(docs, id_col, text_col)
    copies = (_split(found.rows, found.filter, "sha", found.cells).where("maybe").join(found.groups, "sha"))
    lost = copies.where(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "sha").distinct()
    sha, maybe, lid, lsha = fresh(docs.columns, "sha", "maybe", "lost_id", "lost_sha")
    lost = cut_lineage(lost.toDF(lid, lsha))
    rows = _split(docs.withColumn(sha, text_digest(text_col)), found.filter, sha, found.cells, maybe)
    whole = [f"`{c}`" for c in docs.columns]
    alone = rows.where(~F.col(maybe)).select(*whole)
    kept = (rows.where(F.col(maybe))
            .join(lost, F.col(id_col).eqNullSafe(F.col(lid)) & (F.col(sha) == F.col(lsha)), "left_anti"))
    if not one_row:
        return alone.unionByName(kept.select(*whole))
    # only texts whose kept id has several rows are grouped, and that combines map-side
    again = cut_lineage(copies.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("sha").count()
                        .where("count > 1").select(F.col("sha").alias(lsha)))
    small = broadcast_if_small(again, 64)
    single = kept.join(small, F.col(sha) == F.col(lsha), "left_anti").select(*whole)
    (row,) = fresh([*docs.columns, sha], "row")
    one = (kept.join(small, F.col(sha) == F.col(lsha), "left_semi").groupBy(sha)
           .agg(F.min(F.struct(*whole)).alias(row)).select(f"{row}.*"))
    return alone.unionByName(single).unionByName(one)
