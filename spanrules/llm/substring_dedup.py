"""Substring deduplication by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends where the top ``MASK_BITS`` bits of
the hash are zero, ``MIN_CHUNK`` bytes after the last end at the earliest and never within a
character. Since the hash sees the last 32 bytes only, an insertion moves no chunk that lies
beyond it: the same passage has the same chunks wherever it stands, but for a chunk or so at
either end. Chunks are compared by 128-bit digests; a run of neighbouring chunks that also stand
elsewhere is a seed. The texts around both are compared to grow it left and right, character by
character, as far as they are the same; what is then ``MIN_CHARS`` long is a repeated passage. A
passage is missed only if it holds no whole chunk.

Of a passage in several documents the one with the smallest id keeps it, and of several places in
a document the first. Chunks of a run that have different owners grow apart; where they meet, the
passage goes to the smallest owner that has it whole, or else to the smallest that has a part.

Chunks leave the one pass over the texts as an array per document, are counted by digest with a
map-side combine (a passage that a third of all documents share is one row per task), and the
digests that two or more documents have select the repeated ones. Runs are found within a
document, whose chunks are bounded by its text. A seed grows by the ``CONTEXT`` characters beside it
and beside its first and last chunk in the owner's text, both cut out in a pass over the texts;
those that are the same throughout take another pass with four times as many, until none is. What lies
between two runs of one owner at one distance is compared once, by digest, not by each run before it.
A pass shuffles the texts that a filter of the ids with open ends lets through.

Defined cases: a null or empty text has no chunks; rows that repeat an id count as one document; a
text that never meets the mask is one chunk; an empty table gives an empty result; other columns
pass through ``without_repeats`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanrules.llm.common import broadcast_if_small, fresh, likely, slices, small_batches, text_bytes
from spanrules.session import cut_lineage

MASK_BITS = 5
MIN_CHUNK = 16
WINDOW = 32
MIN_CHARS = 100
CONTEXT = 96
TEXT_BYTES = 1 << 20  # of text, or of contexts, that a task works on at once
POINT = "at int, size int, d1 long, left boolean, off int, gap int, upto int, owner long, src int, room int"


def _gear() -> np.ndarray:
    """A random 32-bit value for each byte, by the finaliser of murmur3."""
    x = np.arange(1, 257, dtype=np.uint32) * np.uint32(0x9E3779B1)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """At each byte the hash ``h = 2 h + gear[byte]`` (mod 2^32) of the last 32 bytes, by doubling:
    the hash of 2 k bytes is that of the last k plus 2^k times that of the k before."""
    h = _gear()[raw]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def chunk_ends(raw: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """For each text its chunk ends, as offsets in ``raw``."""
    ok = gear_hash(raw) >> np.uint32(32 - MASK_BITS) == 0
    ok[:-1] &= (raw[1:] & 0xC0) != 0x80
    ends = np.flatnonzero(ok) + 1
    parts = np.searchsorted(ends, at)
    ends = ends.tolist()
    out = []
    for a, b, i, j in zip(at[:-1].tolist(), at[1:].tolist(), parts[:-1].tolist(), parts[1:].tolist()):
        own, last, first = [], a, a + WINDOW - 1  # the hash must not see the text before
        for e in ends[i:j]:
            if e - last >= MIN_CHUNK and e > first:
                own.append(e)
                last = e
        if last < b:
            own.append(b)
        out.append(own)
    return out


def _chunks(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets of each text's chunks, and by chunk: start and size in characters, the digest in two
    halves, and whether the same text has it already."""
    raw, at = text_bytes(texts)
    ends = chunk_ends(raw, at) if len(raw) else [[] for _ in at[1:]]
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    body = memoryview(raw.tobytes())
    digests, again, starts = [], [], []
    for a, own in zip(at[:-1].tolist(), ends):
        seen = set()
        for e in own:
            d = hashlib.blake2b(body[a:e], digest_size=16).digest()
            again.append(d in seen)
            seen.add(d)
            digests.append(d)
            starts.append(a)
            a = e
    offsets = np.cumsum([0, *map(len, ends)])
    starts = np.array(starts, np.int64)
    stops = np.array([e for own in ends for e in own], np.int64)
    base = chars[np.repeat(at[:-1], np.diff(offsets))]
    halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return offsets, [chars[starts] - base, chars[stops] - chars[starts], halves[:, 0], halves[:, 1],
                     np.array(again, bool)]


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, chunks array<struct<start, size, d1, d2, again, first>>`` per document; ``first`` is where a chunk
    that the text has again stands first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, TEXT_BYTES):
                offsets, (start, size, d1, d2, again) = _chunks(batch.column("text"))
                first: list[int | None] = [None] * len(again)
                for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    if again[i:j].any():
                        seen: dict[tuple[int, int], int] = {}
                        for x, at, a, b in zip(range(i, j), start[i:j].tolist(), d1[i:j].tolist(), d2[i:j].tolist()):
                            place = seen.setdefault((a, b), at)
                            if again[x]:
                                first[x] = place
                items = pa.StructArray.from_arrays(
                    [pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(d1, pa.int64()),
                     pa.array(d2, pa.int64()), pa.array(again, pa.bool_()), pa.array(first, pa.int32())],
                    names=["start", "size", "d1", "d2", "again", "first"])
                yield pa.record_batch([batch.column("id"),
                                       pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)],
                                      names=["id", "chunks"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, chunks array<struct<start: int, size: int, d1: long, d2: long, "
                                "again: boolean, first: int>>")


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``doc`` is not in ``wanted``."""
    return likely(rows, wanted, "doc")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def _contexts(docs: DataFrame, points: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """For ``points`` (``doc`` and the columns of ``POINT``: a chunk, a side, how far from the chunk and what
    goes along) the ``upto`` characters there, those on the left in reverse, and the digest of the ``gap``
    characters there if ``gap`` is not 0."""
    names = [f.split()[0] for f in POINT.split(", ")]
    here = ("at", "size", "d1", "left", "off", "gap", "upto")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, TEXT_BYTES):
                wanted = batch.column("wanted")
                items = wanted.flatten()
                cols = dict(zip(names, items.flatten()))
                kept, near, sums, row = [], [], [], -1
                of = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy()).tolist()
                for k, (i, at, size, d1, left, off, gap, upto) in enumerate(
                        zip(of, *(cols[c].to_pylist() for c in here))):
                    if i != row:
                        row, text = i, batch.column("text")[i].as_py()
                    a, b = at, at + size
                    # another row of the same id may hold something else there
                    if int.from_bytes(_digest(text[a:b])[:8], "little", signed=True) != d1:
                        continue
                    a, b = max(0, a - off), b + off
                    kept.append(k)
                    near.append(text[max(0, a - upto):a][::-1] if left else text[b:b + upto])
                    sums.append(_digest(text[max(0, a - gap):a] if left else text[b:b + gap]) if gap else None)
                doc = batch.column("doc").take(pa.array(of, pa.int64()))
                kept = pa.array(kept, pa.int64())
                yield pa.record_batch([doc.take(kept), *(cols[c].take(kept) for c in names),
                                       pa.array(near, pa.string()), pa.array(sums, pa.binary())],
                                      names=["doc", *names, "near", "gap_sum"])

    wanted = cut_lineage(points.groupBy("doc").agg(F.collect_set(F.struct(*names)).alias("wanted")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    small = broadcast_if_small(wanted, 2048)
    if small is wanted:  # the texts are shuffled
        rows = _likely(rows, wanted)
    with small_batches(docs.sparkSession):
        return cut_lineage(rows.where("text IS NOT NULL").join(small, "doc").select("doc", "text", "wanted")
                           .mapInArrow(cut, f"doc long, {POINT}, near string, gap_sum binary"))


def _same(x: str, y: str) -> int:
    """How many characters ``x`` and ``y`` have in common from the start."""
    low, high = 0, min(len(x), len(y))
    if x[:high] == y[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if x[low:mid] == y[low:mid] else (low, mid)
    return low


def _grown(docs: DataFrame, runs: DataFrame, mixed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, at, left, owner, src, grown``: for either side of the removed ``runs`` the chunk at that end,
    the same chunk in the owner's text, and by how many characters the run grows there.

    A run is compared as far as the next run of the same owner and distance: if all between them is the same,
    it grows by that, by the other run and by what the other run grows. The ids in ``mixed`` stand for
    several texts, so theirs are compared to the end."""
    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, TEXT_BYTES, "near"):
                n = []
                for x, y, a, b, gap in zip(*(batch.column(c).to_pylist()
                                             for c in ("near", "far", "gap_sum", "far_sum", "gap"))):
                    n.append(gap if gap and a == b else _same(x, y))
                yield pa.record_batch([*(batch.column(c) for c in end), pa.array(n, pa.int32())], names=[*end, "more"])

    end = ["id", "at", "left", "size", "d1", "owner", "src", "off", "room"]
    sides = [runs.where("removed").select("id", F.col(f"{chunk}.start").alias("at"), F.lit(chunk == "head").alias("left"),
                                          *[f"{chunk}.{c}" for c in ("size", "d1", "owner", "src")],
                                          F.lit(0).alias("off"), F.col(room).alias("room"))
             for chunk, room in (("head", "room_left"), ("tail", "room_right"))]
    ends = sides[0].unionByName(sides[1])
    for c in ("id", "owner"):
        ends = (ends.join(broadcast_if_small(mixed, 24).select(F.col("id").alias(c), F.lit(True).alias("several")), c, "left")
                .withColumn("room", F.expr("if(several, NULL, room)")).drop("several"))
    open_ends = cut_lineage(ends.select(*end).distinct())
    done, length = None, CONTEXT
    while True:
        # a longer way to the next run is first tried as a whole, by digest
        gap = F.when((F.col("off") == 0) & (F.col("room") > length), F.col("room")).otherwise(0)
        open_ends = open_ends.withColumn("gap", gap)
        mark = ["size", "d1", "left", "off", "gap"]
        left_over = F.least(F.lit(length), F.col("room") - F.col("off"))
        points = (open_ends.select(F.col("id").alias("doc"), "at", *mark, left_over.alias("upto"), "owner", "src", "room")
                  .unionByName(open_ends.select(F.col("owner").alias("doc"), F.col("src").alias("at"), *mark,
                                                F.lit(length).alias("upto")), allowMissingColumns=True))
        near = _contexts(docs, points, length, id_col, text_col)
        # a written table, so that AQE splits the partition of a passage that many documents have
        own = near.where("owner IS NOT NULL").withColumnRenamed("doc", "id")
        far = (near.where("owner IS NULL").select("doc", "at", "left", "off", "gap", "near", "gap_sum")
               .toDF("owner", "src", "left", "off", "gap", "far", "far_sum"))
        with small_batches(docs.sparkSession):
            found = cut_lineage(
                own.join(broadcast_if_small(far, 128 + 2 * length), ["owner", "src", "left", "off", "gap"])
                .mapInArrow(common, "id long, at int, left boolean, size int, d1 long, owner long, src int, off int, "
                                    "room int, more int")
                .groupBy(*end).agg(F.max("more").alias("more")))
        is_open = F.expr(f"more = {length} AND (room IS NULL OR off + more < room)")
        grown = found.where(~is_open).withColumn("grown", F.col("off") + F.col("more")).drop("off", "d1", "more")
        done = grown if done is None else done.unionByName(grown)
        open_ends = cut_lineage(found.where(is_open).withColumn("off", F.col("off") + length).drop("more"))
        if open_ends.isEmpty():
            break
        length *= 4
    # where the growth ends, counted away from the run on either side; that of the run reached is taken over
    sign, edge = F.expr("if(left, 1, -1)"), F.expr("if(left, at, at + size)")
    order = (Window.partitionBy("id", "owner", F.col("at") - F.col("src"), "left").orderBy(sign * F.col("at"))
             .rowsBetween(Window.unboundedPreceding, 0))
    reach = F.last(F.when(F.expr("room IS NULL OR grown < room"), sign * edge - F.col("grown")), ignorenulls=True).over(order)
    return cut_lineage(done.select("id", "at", "left", "owner", "src", (sign * edge - reach).alias("grown")))


def repeats(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row per repeated passage in a document: ``id_col, start, stop`` (in characters), ``keep_id``
    (the document that keeps it) and ``removed``."""
    with small_batches(docs.sparkSession):
        every = cut_lineage(chunks(docs, id_col, text_col).where("id IS NOT NULL")
                            .withColumn("text_hash", F.xxhash64("chunks")))
    mixed = cut_lineage(every.groupBy("id").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high"))
                        .where("low < high").select("id"))
    rows = every.select("id", F.posexplode("chunks").alias("at", "c")).select("id", "at", "c.*")
    shared = cut_lineage(rows.where("NOT again").groupBy("d1", "d2")
                         .agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min_by("start", "id").alias("src"))
                         .where("low < high").select("d1", "d2", F.col("low").alias("owner"), "src"))
    found = (rows.join(broadcast_if_small(shared, 64), ["d1", "d2"], "left")
             .where("owner IS NOT NULL OR again")
             .withColumn("owner", F.coalesce("owner", "id"))
             .withColumn("removed", F.expr("again OR owner <> id"))
             .repartition("id"))
    # neighbours, in the owner's text too, keep the same distance to their rank; the chunks of a document
    # are all that a window holds
    rank = F.dense_rank().over(Window.partitionBy("id", "removed", "owner", "shift").orderBy("at"))
    end = F.struct("at", "start", "size", "d1", "owner", "src")
    beside = Window.partitionBy("id", "removed", "owner", "shift").orderBy("start")
    runs = cut_lineage(found.withColumn("src", F.when(F.col("owner") == F.col("id"), F.coalesce("first", "start"))
                                      .otherwise(F.col("src")))
                       .withColumn("shift", F.col("start") - F.col("src")).withColumn("run", F.col("at") - rank)
                       .groupBy("id", "removed", "owner", "shift", "run")
                       .agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("stop"),
                            F.min(end).alias("head"), F.max(end).alias("tail"))
                       .withColumn("room_left", F.col("start") - F.lag("stop").over(beside))
                       .withColumn("room_right", F.lead("start").over(beside) - F.col("stop")))
    grown = _grown(docs, runs, mixed, id_col, text_col)
    # what the copies of a passage grow by, its first place grows by too
    ends = cut_lineage(
        grown.select("id", "at", "left", F.lit(True).alias("removed"), "grown")
        .unionByName(grown.select(F.col("owner").alias("id"), F.col("src").alias("at"), "left",
                                  F.lit(False).alias("removed"), "grown"))
        .groupBy("id", "at", "left", "removed").agg(F.max("grown").alias("grown")))
    sides = {True: ends.where("left").toDF("id", "head_at", "left", "removed", "before").drop("left"),
             False: ends.where("NOT left").toDF("id", "tail_at", "left", "removed", "after").drop("left")}
    spans = (runs.withColumn("head_at", F.col("head.start")).withColumn("tail_at", F.col("tail.start"))
             .join(sides[True], ["id", "removed", "head_at"], "left")
             .join(sides[False], ["id", "removed", "tail_at"], "left")
             .select("id", "removed", "owner", (F.col("start") - F.coalesce("before", F.lit(0))).alias("start"),
                     (F.col("stop") + F.coalesce("after", F.lit(0))).alias("stop")))
    # seeds that have grown into each other are one passage, of the first owner that has it whole if one has
    order = Window.partitionBy("id", "removed").orderBy("start", "stop")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True)).cast("int")
    whole = (spans.withColumn("apart", apart)
             .withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("id", "removed", "run")
             .agg(F.max("stop").alias("stop"), F.min("owner").alias("least"),
                  F.min(F.struct("start", (-F.col("stop")).alias("end"), "owner")).alias("widest"))
             .select("id", "removed", "widest.start", "stop",
                     F.when(F.col("widest.end") == -F.col("stop"), F.col("widest.owner")).otherwise(F.col("least"))
                     .alias("keep_id")))
    return (whole.where(F.col("stop") - F.col("start") >= min_chars)
            .select(F.col("id").alias(id_col), F.col("start").cast("long").alias("start"),
                    F.col("stop").cast("long").alias("stop"), "keep_id", "removed"))


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``docs`` with the removed passages cut out of the texts; all rows stay."""
    key, cuts = fresh(docs.columns, "key", "cuts")
    lost = cut_lineage(repeats(docs, min_chars, id_col, text_col).where("removed").groupBy(id_col)
                       .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))).toDF(key, cuts)
    text = F.col(text_col)
    # what stands before each cut, and what stands after the last
    parts = F.transform(F.col(cuts), lambda c, i: F.substring(
        text, F.when(i == 0, F.lit(1)).otherwise(F.element_at(F.col(cuts), i)["stop"] + 1).cast("int"),
        (c["start"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.col(cuts), i)["stop"])).cast("int")))
    rest = F.substring(text, (F.element_at(F.col(cuts), -1)["stop"] + 1).cast("int"), F.length(text))
    whole = docs.join(broadcast_if_small(lost, 256), docs[id_col] == F.col(key), "left")
    return whole.withColumn(text_col, F.when(F.col(cuts).isNull(), text).otherwise(
        F.concat(F.array_join(parts, ""), rest))).select(*[f"`{c}`" for c in docs.columns])
