"""Sharding by extendible hashing.

A row's hash is 60 bits of the MD5 of its id and text. Shards are the buckets of an extendible hash
table: prefixes of the hash. A bucket over the byte limit splits on the next bit, and only such a
bucket, until every shard fits; the directory maps the first bits of a hash to its shard.

The directory comes from a histogram of bytes by hash prefix, a few bits deeper than an even split
would need, which combines map-side; summing it up for all shorter prefixes tells which buckets
split. Buckets over the limit at the histogram's last bit get a deeper one of their own rows, round
by round. Nothing but row counts reaches the driver: the directory is a table, joined on the prefix
(a broadcast if it is small), and grows with the number of shards, not with their depth.

Hashing id and text spreads rows evenly whatever the ids, sources or texts that many rows share. A
single row over the limit, or rows that repeat id and text, cannot be split; they are a shard of their
own with ``oversize`` set.

Defined cases: a null id hashes like an empty one, a null text counts as empty, with no bytes; an
empty table has no shards; other columns pass through ``assign`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrules.llm.common import broadcast_if_small, fresh, whole_text
from spanrules.session import cut_lineage

SHARD_BYTES = 32 << 20
HASH_BITS = 60
SPARE_BITS = 3  # that a histogram goes deeper than an even split


def row_hash(id_col: str, text_col: str) -> Column:
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), whole_text(text_col))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _prefix(h: str, depth: int | Column) -> Column:
    d = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", F.col(h), (F.lit(HASH_BITS) - d).cast("int"))


def _directory(rows: DataFrame, top: int, depth: int, limit: int) -> DataFrame:
    """Entry ``at`` (``depth`` bits) -> ``bits, size, rows, whole`` of its shard, ``bits`` null where the
    bucket must split on a later bit. Buckets of fewer than ``top`` bits are known to be too large."""
    hist = cut_lineage(rows.groupBy(_prefix("h", depth).alias("at"))
                       .agg(F.sum("bytes").alias("size"), F.count(F.lit(1)).alias("rows"),
                            F.min("h").alias("least"), F.max("h").alias("most")))
    levels = hist.select("*", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("bits"))
    levels = levels.withColumn("bucket", F.call_function("shiftright", F.col("at"), F.lit(depth) - F.col("bits")))
    done = (levels.groupBy("bits", "bucket")
            .agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.min("least").alias("least"),
                 F.max("most").alias("most"))
            .where((F.col("size") <= limit) | (F.col("least") == F.col("most")))
            .select("bits", "bucket", "size", "rows"))
    first = (levels.select("at", "bits", "bucket").join(done, ["bits", "bucket"])
             .groupBy("at").agg(F.min(F.struct("bits", "size", "rows")).alias("s"))
             .select(F.col("at").alias("k"), "s.*"))
    return cut_lineage(hist.select("at").join(first, F.col("at") == F.col("k"), "left")
                       .select("at", "bits", "size", "rows"))


def directories(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id",
                text_col: str = "text") -> list[tuple[int, DataFrame]]:
    """The directory in rounds: ``(depth, entries)``."""
    rows = cut_lineage(docs.select(row_hash(id_col, text_col).alias("h"),
                                   F.octet_length(whole_text(text_col)).cast("long").alias("bytes")))
    out, top = [], 0
    while True:
        total, n = rows.agg(F.sum("bytes"), F.count(F.lit(1))).first()
        if not n:
            return out
        need = max(1, -(-total // limit)).bit_length() if not out else SPARE_BITS
        depth = min(HASH_BITS, top + need + SPARE_BITS)
        found = _directory(rows, top, depth, limit)
        out.append((depth, found))
        deeper = found.where("bits IS NULL").select("at")
        if deeper.isEmpty():
            return out
        rows = cut_lineage(rows.join(broadcast_if_small(deeper, 16), _prefix("h", depth) == F.col("at"), "left_semi"))
        top = depth + 1


def assign(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text",
           shard: str = "shard") -> DataFrame:
    """``docs`` with a struct ``shard``: ``id`` (its prefix in binary digits), ``depth``, ``bytes``, ``rows``
    and ``oversize``."""
    (h, at, bits, size, rows) = fresh([*docs.columns, shard], "h", "at", "bits", "size", "rows")
    kind = "struct<id: string, depth: int, bytes: bigint, rows: bigint, oversize: boolean>"
    out = docs.withColumn(h, row_hash(id_col, text_col)).withColumn(shard, F.lit(None).cast(kind))
    for depth, found in directories(docs, limit, id_col, text_col):
        entries = broadcast_if_small(found.where("bits IS NOT NULL"), 40).toDF(at, bits, size, rows)
        name = F.when(F.col(bits) == 0, F.lit("")).otherwise(
            F.expr(f"lpad(bin(shiftright(`{h}`, cast({HASH_BITS} - `{bits}` AS int))), cast(`{bits}` AS int), '0')"))
        one = F.struct(name.alias("id"), F.col(bits).cast("int").alias("depth"), F.col(size).alias("bytes"),
                       F.col(rows).alias("rows"), (F.col(size) > limit).alias("oversize"))
        out = (out.join(entries, _prefix(h, depth) == F.col(at), "left")
               .withColumn(shard, F.coalesce(F.col(shard), F.when(F.col(bits).isNotNull(), one)))
               .drop(at, bits, size, rows))
    return out.drop(h)


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Writes ``docs`` as Parquet, a folder ``shard_id=b<prefix>`` for each shard."""
    (shard,) = fresh(docs.columns, "shard")
    (folder,) = fresh(docs.columns, "shard_id")
    rows = assign(docs, limit, id_col, text_col, shard)
    rows = rows.withColumn(folder, F.concat(F.lit("b"), F.col(shard)["id"])).drop(shard)
    rows.repartition(folder).write.partitionBy(folder).parquet(path)


def shard_of(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_bytes, shard_id, depth, shard_bytes, shard_rows, oversize``."""
    rows = assign(docs.select(id_col, text_col), limit, id_col, text_col)
    return rows.select(id_col, F.octet_length(whole_text(text_col)).cast("long").alias("n_bytes"),
                       F.col("shard.id").alias("shard_id"), F.col("shard.depth").alias("depth"),
                       F.col("shard.bytes").alias("shard_bytes"), F.col("shard.rows").alias("shard_rows"),
                       F.col("shard.oversize").alias("oversize"))


def oracle_sql(limit: int = SHARD_BYTES) -> str:
    """DuckDB SQL of ``shard_of`` over ``documents``: every prefix of every hash, the shortest that fits."""
    return f"""
        WITH hashed AS (
            SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15)
                        AS BIGINT) AS h
            FROM documents),
        prefixes AS (
            SELECT doc_id, n_bytes, h, depth, h >> ({HASH_BITS} - depth) AS bucket
            FROM hashed, (SELECT CAST(range AS INTEGER) AS depth FROM range({HASH_BITS + 1}))),
        buckets AS (
            SELECT *, CAST(sum(n_bytes) OVER w AS BIGINT) AS shard_bytes, count(*) OVER w AS shard_rows,
                   min(h) OVER w = max(h) OVER w AS alone
            FROM prefixes WINDOW w AS (PARTITION BY depth, bucket))
        SELECT doc_id, n_bytes,
               CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bucket), depth, '0') END AS shard_id,
               depth, shard_bytes, shard_rows, shard_bytes > {limit} AS oversize
        FROM buckets WHERE shard_bytes <= {limit} OR alone
        QUALIFY depth = min(depth) OVER (PARTITION BY doc_id, h)
    """
