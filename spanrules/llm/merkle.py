"""Merkle manifest of a table: digests of rows, of sources and of the whole, with inclusion proofs.

Each row is a leaf. Within a group (a source) leaves are numbered in order; a node of the next
level is the digest of up to ``FANOUT`` consecutive nodes. The roots of the groups, in order, are
the leaves of one tree more, whose root stands for the table.

Slot pivot: a level is one ``groupBy(group, position div FANOUT)``. Conditional aggregates spread the
children of a parent into ``FANOUT`` columns by ``position mod FANOUT``; concatenating the columns and
hashing gives the parent, and leaving out a child's own column gives its siblings (those to its left
and to its right). Children are neighbours, so a level shrinks map-side; level ``l`` has
``rows / FANOUT^l`` rows and is written once.

Positions come from a range partitioning by (group, key): the place in the partition plus the
sizes of the group's parts in earlier partitions, so a group with a third of all rows is numbered
by many tasks. Proofs go down the written levels: the proof of a parent is handed to its children with
their siblings put before it, one join a level, the widest on ``rows / FANOUT`` rows.

Defined cases: a null field is ``-``, any other its UTF-8 byte count, ``:`` and its value; a
null group is a group of its own, the first; null ids come first; rows of one id are ordered by
their leaves, rows that are all equal are equal leaves; a group of one row has its leaf as root, and a
table of one group the root of the group; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanrules.llm.common import broadcast_if_small
from spanrules.session import cut_lineage

FANOUT = 3
ROWS_PER_TASK = 1 << 19
STEP = "struct<l:binary,r:binary>"  # siblings to the left and to the right


def sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(x: Column) -> Column:
    """A value as it goes into a leaf's digest."""
    text = x.cast("string")
    return F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: Sequence[Column]) -> Column:
    return sha(F.concat(*[field(x) for x in fields]))


def _joined(digests: Sequence[Column]) -> Column:
    """Digests one after the other; a null is an empty place."""
    return F.concat(*[F.coalesce(d, F.lit(b"")) for d in digests]) if digests else F.lit(b"")


def _hash(digests: Column) -> Column:
    """Digest of a run of digests, taken as hex text."""
    return sha(as_hex(digests))


# ------------------------------------------------------------------ positions


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` (written) with ``pos``, the place from 0 in its group by ``order`` (nulls first), and ``n``,
    the size of the group."""
    n_tasks = 1 + rows.count() // ROWS_PER_TASK
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    # equal keys may hold any share of the rows: the row number deals them out
    dealt = (rows.withColumn("_r", F.monotonically_increasing_id())
             .repartitionByRange(max(n_tasks, rows.sparkSession.sparkContext.defaultParallelism), *keys, "_r")
             .sortWithinPartitions(*keys, "_r").drop("_r").withColumn("_at", F.monotonically_increasing_id()))
    dealt = cut_lineage(dealt).withColumn("_part", F.shiftright("_at", 33))
    # a row for each partition and group in it: at most partitions + groups
    parts = dealt.groupBy("_part", F.col(group).alias("_g")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("_g").orderBy("_part")
    parts = parts.select(
        F.col("_part").alias("_p"), "_g", "_first",
        F.coalesce(F.sum("_size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy("_g")).alias("n"))
    parts = broadcast_if_small(cut_lineage(parts), 96)
    return (dealt.join(parts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
            .withColumn("pos", (F.col("_at") - F.col("_first") + F.col("_before")).cast("long"))
            .drop("_at", "_part", "_p", "_g", "_first", "_before"))


# ------------------------------------------------------------------ levels


def _level(nodes: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """The pivot of one level: ``g, n, pos`` of the parent, its children ``c0..``, each payload column in
    slots ``<name>0..``, and the parent's ``digest`` (that of the only child where the group has one node)."""
    slot, parent = F.col("pos") % FANOUT, F.floor(F.col("pos") / FANOUT)
    spread = [F.max(F.when(slot == k, F.col(c))).alias(f"{to}{k}")
              for c, to in (("digest", "c"), *((p, p) for p in payload)) for k in range(FANOUT)]
    pivot = nodes.groupBy("g", parent.alias("pos")).agg(F.max("n").alias("n"), *spread)
    children = [F.col(f"c{k}") for k in range(FANOUT)]
    return pivot.withColumn("digest", F.when(F.col("n") == 1, F.col("c0")).otherwise(_hash(_joined(children))))


def build(leaves: DataFrame, payload: Sequence[str] = ()) -> list[DataFrame]:
    """Levels of the trees of all groups, lowest first, each written. ``leaves``: ``g, pos, n, digest``.

    In every level ``n`` is the number of its group's children. The lowest level holds all groups, the
    others those with several nodes left.
    """
    levels = [cut_lineage(_level(leaves, payload))]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > FANOUT:
        up = levels[-1].where(F.col("n") > FANOUT).select(
            "g", "pos", F.ceil(F.col("n") / FANOUT).alias("n"), "digest")
        levels.append(cut_lineage(_level(up)))
        most = -(-most // FANOUT)
    return levels


def roots(levels: Sequence[DataFrame]) -> DataFrame:
    """``g, digest`` of each tree: of the level where one node is left."""
    return reduce(DataFrame.unionByName, [x.where(F.col("n") <= FANOUT).select("g", "digest") for x in levels])


def descend(levels: Sequence[DataFrame], tops: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """Proofs of all leaves: ``g, digest, <payload>, top, proof``. ``tops`` has ``g, top, proof`` for
    each tree: what to hand down, and the steps above its root."""
    state = tops.select("g", F.lit(0).cast("long").alias("pos"), "top", "proof").limit(0)
    for at in range(len(levels) - 1, -1, -1):
        level = levels[at]
        # trees whose root is made here enter from above
        here = level.where(F.col("n") <= FANOUT).select(F.col("g").alias("_g"))
        enter = (tops.join(here, F.col("g").eqNullSafe(F.col("_g"))).drop("_g")
                 .withColumn("pos", F.lit(0).cast("long")).select("g", "pos", "top", "proof"))
        state = (state.unionByName(enter) if at < len(levels) - 1 else enter).toDF("_g", "_pos", "top", "proof")
        held = level.join(state, F.col("g").eqNullSafe(F.col("_g")) & (F.col("pos") == F.col("_pos"))).drop("_g", "_pos")
        carried = payload if at == 0 else ()
        child = F.explode(F.filter(F.array(*[F.struct(
            F.lit(k).alias("k"), F.col(f"c{k}").alias("digest"),
            _joined([F.col(f"c{i}") for i in range(k)]).alias("l"),
            _joined([F.col(f"c{i}") for i in range(k + 1, FANOUT)]).alias("r"),
            *[F.col(f"{p}{k}").alias(p) for p in carried]) for k in range(FANOUT)]),
            lambda x: x["digest"].isNotNull()))
        below = held.select("g", "pos", "n", "top", "proof", child.alias("x"))
        step = F.array(F.struct(F.col("x.l").alias("l"), F.col("x.r").alias("r"))).cast(f"array<{STEP}>")
        proof = F.when(F.col("n") == 1, F.col("proof")).otherwise(F.concat(step, F.col("proof")))
        state = below.select("g", (F.col("pos") * FANOUT + F.col("x.k")).cast("long").alias("pos"),
                             *[F.col(f"x.{c}").alias(c) for c in (("digest", *carried) if at == 0 else ())],
                             "top", proof.alias("proof"))
    return state


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right, as hex text."""
    return F.concat_ws("", F.transform(proof, lambda x: as_hex(F.concat(x["l"], x["r"]))))


def fold(start: Column, proof: Column) -> Column:
    """The root that ``start`` and its siblings lead to."""
    return F.aggregate(proof, start, lambda acc, x: _hash(F.concat(x["l"], acc, x["r"])))


# ------------------------------------------------------------------ manifest


def manifest(rows: DataFrame, key: str, group: str, fields: Sequence[str], altered: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of the table: ``<key>, leaf, subroot, root, proof array<struct<l, r>>, folded_root, verified``.

    Digests are binary. ``altered`` replaces fields by other values before the row is checked, as if the data
    had changed since the manifest was made; without it every row verifies.
    """
    altered = altered or {}
    now = F.lit(None).cast("binary")
    if altered:
        now = leaf([altered.get(f, F.col(f"`{f}`")) for f in fields])
    cols = [F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("g"),
            leaf([F.col(f"`{f}`") for f in fields]).alias("digest"), now.alias("now")]
    flat = cut_lineage(rows.select(*cols))
    flat = flat.select("key", "g", "digest", F.when(F.col("now") != F.col("digest"), F.col("now")).alias("now"))
    levels = build(numbered(flat, "g", ["key", "digest"]), ("key", "now"))
    subroots = cut_lineage(roots(levels).select(F.lit(0).alias("g"), F.col("g").alias("name"), "digest"))
    upper = build(numbered(subroots, "g", ["name"]), ("name",))
    root = roots(upper).select("g", F.struct(F.col("digest").alias("root")).alias("top"),
                               F.array().cast(f"array<{STEP}>").alias("proof"))
    tops = cut_lineage(descend(upper, root, ("name",)).select(
        F.col("name").alias("g"), F.struct(F.col("top.root").alias("root"), F.col("digest").alias("subroot")).alias("top"), "proof"))
    found = descend(levels, tops, ("key", "now"))
    folded = fold(F.coalesce("now", "digest"), F.col("proof"))
    out = found.select(F.col("key").alias(key), F.col("digest").alias("leaf"), F.col("top.subroot").alias("subroot"),
                       F.col("top.root").alias("root"), "proof", folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def tampered_documents(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` checked against texts that lost their line breaks where 2 divides
    the CRC of the id: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, digests as hex."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    m = manifest(docs, "doc_id", "source", FIELDS, {"text": text})
    return m.select("doc_id", *[as_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
                    F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
                    as_hex(F.col("folded_root")).alias("folded_root"), "verified")


def oracle_sql() -> str:
    """DuckDB SQL for :func:`tampered_documents`: every level as lists, by recursion."""
    fields = "concat({})"

    def part(c: str, value: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({value} AS VARCHAR)), ':', {value}) END"

    plain = fields.format(", ".join(part(c, c) for c in FIELDS))
    changed = fields.format(", ".join(part(c, "replace(text, chr(10), '')" if c == "text" else c) for c in FIELDS))
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
               lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
    up = f"""[sha256(array_to_string(nodes[{FANOUT} * i + 1:{FANOUT} * i + {FANOUT}], '')) FOR i IN range((len(nodes) + {FANOUT - 1}) // {FANOUT})]"""

    def siblings_of(nodes: str, at: str) -> str:
        first = f"({at}) // {FANOUT} * {FANOUT}"
        return (f"array_to_string({nodes}[{first} + 1:{at}], '') AS l, "
                f"array_to_string({nodes}[{at} + 2:{first} + {FANOUT}], '') AS r")

    return f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, source, sha256({plain}) AS leaf,
                   CASE WHEN {crc} % 2 = 0 THEN sha256({changed}) ELSE sha256({plain}) END AS now,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256({plain})) - 1 AS pos
            FROM documents),
        trees AS (
            SELECT source, 0 AS lvl, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY source
            UNION ALL
            SELECT source, lvl + 1, {up} FROM trees WHERE len(nodes) > 1),
        subroots AS (SELECT source, lvl AS height, nodes[1] AS subroot,
                            row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
                     FROM trees WHERE len(nodes) = 1),
        tops AS (
            SELECT 0 AS lvl, list(subroot ORDER BY pos) AS nodes FROM subroots
            UNION ALL
            SELECT lvl + 1, {up} FROM tops WHERE len(nodes) > 1),
        steps AS (
            SELECT l.doc_id, l.leaf, l.pos, t.lvl, {siblings_of('t.nodes', f'(l.pos // CAST({FANOUT} ** t.lvl AS BIGINT))')}
            FROM leaves l JOIN trees t ON l.source IS NOT DISTINCT FROM t.source AND len(t.nodes) > 1
            UNION ALL
            SELECT l.doc_id, l.leaf, l.pos, s.height + t.lvl, {siblings_of('t.nodes', f'(s.pos // CAST({FANOUT} ** t.lvl AS BIGINT))')}
            FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN tops t ON len(t.nodes) > 1),
        proofs AS (
            SELECT doc_id, leaf, pos, sha256(string_agg(concat(l, r), '' ORDER BY lvl)) AS proof_sha256,
                   list({{'l': l, 'r': r}} ORDER BY lvl) AS path FROM steps GROUP BY doc_id, leaf, pos),
        folded AS (
            SELECT l.doc_id, l.leaf, l.pos, l.source, s.subroot, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, p.path,
                   0 AS lvl, l.now AS digest
            FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
            LEFT JOIN proofs p ON l.doc_id IS NOT DISTINCT FROM p.doc_id AND l.leaf = p.leaf AND l.pos = p.pos
            UNION ALL
            SELECT doc_id, leaf, pos, source, subroot, proof_sha256, path, lvl + 1,
                   sha256(concat(path[lvl + 1].l, digest, path[lvl + 1].r))
            FROM folded WHERE lvl < len(path))
        SELECT f.doc_id, f.leaf, f.subroot, t.nodes[1] AS root, f.proof_sha256, f.digest AS folded_root,
               f.digest = t.nodes[1] AS verified
        FROM folded f JOIN tops t ON len(t.nodes) = 1
        WHERE f.lvl = coalesce(len(f.path), 0)
    """
