"""Phrases of two and three words from a weighted de Bruijn graph.

Only the longest grams are counted. A node is a pair of words, an edge is three words: it leads from
the pair of its first two to the pair of its last two, and its weight is how often they follow each other.
A piece's last words have edges to :data:`END` (piece-end corrections), so each word occurrence
starts exactly one edge and all shorter counts are flows: a pair occurs as often as its node's
edges leave it, a word as often as the nodes that begin with it are left.

1. A vocabulary pass counts the words. Words travel as 64-bit hashes; the pass proves that no two share one,
   or takes another seed. No candidate holds a word that is rarer than a candidate has to be, so what such
   words need not be told apart: a Bloom filter of the frequent words (of bounded size, a rare word that it lets
   through changes nothing) pools them as :data:`OTHER`, and edges that start with one are left out.
2. Each task cuts its texts into pieces and words and adds up the edges of a slice of them. The edges are
   dealt by their first node, so their sums, the flows of the nodes and the edges heavy enough come
   from one shuffle. Nodes with a large share of all words are dealt by their third word too. Rare
   nodes go on only as part of the flow of their first word.
3. A node whose whole flow takes one edge, into a node that has no other, lies on a unary path. Paths are
   found by pointer doubling and compacted into one row of words and one weight: all counts along
   a path equal its weight, and all its pairs are covered by longer phrases.
4. Candidates: pairs off the paths that no heavy edge covers, the windows of the paths, the other heavy edges.

Defined cases: a null text is empty; a null language is ``und``; texts, pieces and words that are
empty count nothing; repeated rows count each time; an empty table gives no phrase; ties of score and
count are ordered by the phrase; other columns are ignored. A slice is 8 MB of text or one
longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanrules.llm.common import broadcast_if_small, slices, text_bytes
from spanrules.session import cut_lineage, ship_by_value

END = 0            # hash of "no word": what follows the last word of a piece
OTHER = 1          # hash of all rare words
MIN_COUNT = 10
COVER = 50         # percent
TOP = 2000
SLICE_BYTES = 8 << 20
HOT = 1000         # nodes with a thousandth of a slice's words are looked at as hot
SALTS = 64
SEEDS = 8
FILTER_BITS = 16          # of the Bloom filter per frequent word
MAX_FILTER = 1 << 27      # bits of the filter at most: 16 MiB

BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

ship_by_value(__name__)


# ------------------------------------------------------------------ in a task


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    kind = np.zeros(256, np.uint8)
    kind[list(BLANKS)] = 1
    kind[list(BREAKS)] = 2
    return lower, kind


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts (lower case), the text of each, and whether it continues the piece of the
    word before it."""
    lower, kind = _tables()
    raw, at = text_bytes(texts)
    raw = lower[raw]
    kinds = kind[raw]
    breaks = np.flatnonzero(kinds == 2)
    inside = kinds == 0
    edge = np.diff(inside, prepend=False) & inside
    here = at[:-1][at[:-1] < at[1:]]
    edge[here] = inside[here]  # a word may start where a text does
    starts = np.flatnonzero(edge)
    text = np.searchsorted(at, starts, "right") - 1
    before = np.searchsorted(breaks, starts)
    joined = np.zeros(len(starts), bool)
    joined[1:] = (before[1:] == before[:-1]) & (text[1:] == text[:-1])
    # the bytes of words alone, one word after the other
    size = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else starts
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return words, text, joined


def _hashes(langs: list[bytes], words: list[bytes], seed: int) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(b"%d:%s%s" % (len(a), a, w), seed) for a, w in zip(langs, words)),
                       np.uint64, len(words)).view(np.int64)


class Slice:
    """The words of some texts: ``ids`` into its distinct (language, word) pairs, 0 for none."""

    def __init__(self, texts: pa.Array, langs: list[str | None], seed: int):
        words, text, self.joined = words_of(texts)
        coded = words.dictionary_encode()
        names = {x: i for i, x in enumerate(dict.fromkeys("und" if x is None else x for x in langs))}
        lang = np.fromiter((names["und" if x is None else x] for x in langs), np.int64, len(langs))
        n = max(1, len(coded.dictionary))
        pair = lang[text] * n + coded.indices.to_numpy()
        if n * len(names) <= 8 * len(pair):
            used = np.zeros(n * len(names), bool)
            used[pair] = True
            self.ids, pair = np.cumsum(used, dtype=np.int64)[pair], np.flatnonzero(used)
        else:
            pair, ids = np.unique(pair, return_inverse=True)
            self.ids = ids + 1
        names, voc = list(names), coded.dictionary.to_pylist()
        self.words = [voc[i] for i in pair % n]
        self.langs = [names[i] for i in pair // n]
        self.hash = np.concatenate([[END], _hashes([x.encode() for x in self.langs], self.words, seed)])

    def counts(self) -> np.ndarray:
        return np.bincount(self.ids, minlength=len(self.hash))[1:]

    def _next(self, ids: np.ndarray) -> np.ndarray:
        """The id after each position of a piece, 0 at its end."""
        out = np.zeros(len(ids), np.int64)
        out[:-1] = np.where(self.joined[1:], ids[1:], 0)
        return out

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct nodes (as first and second id), and the node of each word."""
        second = self._next(self.ids)
        node, at = np.unique(self.ids * len(self.hash) + second, return_inverse=True)
        return node // len(self.hash), node % len(self.hash), at

    def edges(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct edges that start with a frequent word, and their weights."""
        other = len(self.hash)
        hashes, size = np.append(self.hash, OTHER), other + 1
        frequent = np.append(frequent, True)
        frequent[END] = True
        second = self._next(self.ids)
        third = self._next(second)
        keep = frequent[self.ids]
        first, second, third = self.ids[keep], second[keep], third[keep]
        second = np.where(frequent[second], second, other)
        third = np.where(frequent[third] & (second != other), third, other)
        node, at = np.unique(first * size + second, return_inverse=True)
        edge, n = np.unique(at * size + third, return_counts=True)
        node, third = node[edge // size], edge % size
        return hashes[node // size], hashes[node % size], hashes[third], n


class Filter:
    """Bloom filter of hashes in ``2^bits`` cells, packed eight to a byte."""

    def __init__(self, cells: np.ndarray, bits: int):
        self.cells, self.bits = cells, bits

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for k in range(2):
            # two disjoint runs of bits of the hash
            cell = (h.view(np.uint64) >> np.uint64(32 * k)) & np.uint64((1 << self.bits) - 1)
            out &= (self.cells[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def _mix(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """One number for a node, for looking it up among hot ones (equal nodes have equal numbers)."""
    return h1.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h2.view(np.uint64)


def _slices(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[Slice]:
    for whole in batches:
        for batch in slices(whole, SLICE_BYTES, rows=1 << 20):
            found = Slice(batch.column("text"), batch.column("lang").to_pylist(), seed)
            if len(found.ids):
                yield found


# ------------------------------------------------------------------ Spark jobs


def vocabulary(rows: DataFrame) -> tuple[DataFrame, list[tuple[int, int]], int]:
    """``h, lang, word, n`` of all words, written; the hot nodes; and the seed of the hashes."""
    for seed in range(SEEDS):
        def run(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for s in _slices(batches, seed):
                n = s.counts()
                for at in range(0, len(n), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.record_batch([pa.array(s.hash[1:][part]), pa.nulls(len(n[part]), pa.int64()), pa.array(s.langs[part], pa.string()),
                                           pa.array(s.words[part], pa.binary()), pa.array(n[part], pa.int64())],
                                          names=["h", "h2", "lang", "word", "n"])
                a, b, at = s.nodes()
                n = np.bincount(at)
                top = np.flatnonzero(n * HOT >= n.sum())
                yield pa.record_batch([pa.array(s.hash[a[top]]), pa.array(s.hash[b[top]]), pa.nulls(len(top), pa.string()),
                                       pa.nulls(len(top), pa.binary()), pa.array(n[top], pa.int64())],
                                      names=["h", "h2", "lang", "word", "n"])

        seen = cut_lineage(rows.mapInArrow(run, "h long, h2 long, lang string, word binary, n long")
                           .groupBy("h", "h2", "lang", "word").agg(F.sum("n").alias("n")))
        words = seen.where("h2 IS NULL")
        shared = words.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where((F.col("k") > 1) | F.col("h").isin(END, OTHER))
        if shared.isEmpty():
            break
    else:
        raise RuntimeError("no seed keeps all words apart")
    total = words.agg(F.sum("n")).first()[0] or 0
    # a node with 1/HOT of all words has that share of some slice; what was seen of it sums to half of that
    # at least for a node worth dealing out, so there are at most 2 * HOT
    hot = seen.where(F.col("h2").isNotNull() & (F.col("n") * 2 * HOT >= total)).select("h", "h2").collect()
    return (words.select("h", "lang", F.col("word").cast("string").alias("word"), "n"),
            [(r["h"], r["h2"]) for r in hot], seed)


def frequent_words(words: DataFrame, min_count: int) -> Filter:
    """Bloom filter of the words with ``min_count`` occurrences; at most ``MAX_FILTER`` bits come to the driver."""
    frequent = words.where(F.col("n") >= min_count).select("h")
    bits = max(15, min(MAX_FILTER, max(1, frequent.count()) * FILTER_BITS - 1).bit_length())
    bits = min(bits, MAX_FILTER.bit_length() - 1)
    mask = F.lit((1 << bits) - 1).cast("long")
    cells = frequent.select(F.explode(F.array(*[F.shiftrightunsigned("h", 32 * k).bitwiseAND(mask) + 1 for k in range(2)])).alias("c"))
    blocks = (cells.groupBy(F.bitmap_bucket_number("c").alias("block"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits"))).collect()
    size = 1 << 12  # bytes of a block
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in blocks:
        raw = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["block"] - 1) * size:r["block"] * size] = raw[:len(out) - (r["block"] - 1) * size]
    return Filter(out, bits)


def graph(rows: DataFrame, hot: list[tuple[int, int]], seed: int, frequent: Filter, min_count: int) -> DataFrame:
    """``h1, h2, h3, n``, written: flows of nodes (``h3`` null), of the rare nodes of a word together (``h2`` null
    too), and the weights of heavy edges."""
    known = _mix(*(np.array([x[i] for x in hot], np.int64) for i in range(2)))
    shared = rows.sparkSession.sparkContext.broadcast((frequent.cells, frequent.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = Filter(*shared.value)
        for s in _slices(batches, seed):
            h1, h2, h3, n = s.edges(filt.has(s.hash))
            salt = np.where(np.isin(_mix(h1, h2), known), 1 + (h3.view(np.uint64) >> np.uint64(32)) % np.uint64(SALTS), 0)
            for at in range(0, len(n), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.record_batch([pa.array(x[part]) for x in (h1, h2, h3, salt.astype(np.int32), n.astype(np.int64))],
                                      names=["h1", "h2", "h3", "salt", "n"])

    edges = (rows.mapInArrow(run, "h1 long, h2 long, h3 long, salt int, n long")
             .repartition("h1", "h2", "salt").groupBy("h1", "h2", "salt", "h3").agg(F.sum("n").alias("n")))
    # each edge adds to its node, and stands for itself if it is heavy; all in the same partition
    none = F.lit(None).cast("long")
    heavy = (F.col("n") >= min_count) & ~F.col("h3").isin(END, OTHER)
    parts = edges.select("h1", "h2", "salt", "n", F.explode(F.when(heavy, F.array(none, "h3")).otherwise(F.array(none))).alias("h3"))
    flows = parts.groupBy("h1", "h2", "salt", "h3").agg(F.sum("n").alias("n"))
    # (a hot node is in parts, so its flow is not known yet)
    kept = ~F.col("h2").isin(END, OTHER) & ((F.col("n") >= min_count) | (F.col("salt") > 0))
    return cut_lineage(flows.select("h1", F.when(kept, F.col("h2")).alias("h2"), "h3", "n")
                       .groupBy("h1", "h2", "h3").agg(F.sum("n").alias("n")))


def unary_paths(edges: DataFrame) -> DataFrame:
    """``words array<long>, n``: maximal paths of the unary edges ``h1, h2, h3, n``, by pointer doubling: each node
    knows a node some steps before it, and in each round takes over what that one knows."""
    state = cut_lineage(edges.select(F.col("h2").alias("a"), F.col("h3").alias("b"), F.col("h1").alias("ra"),
                                     F.col("h2").alias("rb"), F.lit(1).cast("long").alias("d"), "n"))
    while True:
        back = state.select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("ra").alias("na"),
                            F.col("rb").alias("nb"), F.col("d").alias("more"))
        jumped = state.join(back, ["ra", "rb"], "left")
        state = cut_lineage(jumped.select(
            "a", "b", F.coalesce("na", "ra").alias("ra"), F.coalesce("nb", "rb").alias("rb"),
            (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), "n", F.col("more").isNotNull().alias("moved")))
        if state.where("moved").isEmpty():
            break
    # a path is part of a piece, so no longer than a text
    rest = F.transform(F.array_sort(F.collect_list(F.struct("d", "b"))), lambda x: x["b"])
    return (state.groupBy("ra", "rb").agg(rest.alias("rest"), F.max("n").alias("n"))
            .select(F.concat(F.array("ra", "rb"), "rest").alias("words"), "n"))


def _windows(path: str, size: int) -> Column:
    """All windows of ``size`` words along a path."""
    return F.transform(F.sequence(F.lit(1), F.size(path) - (size - 1)), lambda i: F.slice(path, i, size))


def candidates(found: DataFrame, min_count: int, cover: int) -> DataFrame:
    """``h1, h2, h3 (null for pairs), a, first, last``: candidates that no longer one covers. ``first`` and ``last``
    are the counts of the pairs that a phrase of three words starts and ends with."""
    nodes = cut_lineage(found.where((F.col("h3").isNull()) & F.col("h2").isNotNull() & (F.col("n") >= min_count))
                        .select("h1", "h2", F.col("n").alias("f")))
    edges = found.where("h3 IS NOT NULL")
    edges = (edges.join(nodes.withColumnRenamed("f", "first"), ["h1", "h2"])
             .join(nodes.toDF("h2", "h3", "last"), ["h2", "h3"]))
    edges = cut_lineage(edges.withColumn("unary", (F.col("n") == F.col("first")) & (F.col("n") == F.col("last"))))
    paths = cut_lineage(unary_paths(edges.where("unary")))
    along = (paths.select("n", F.explode(_windows("words", 3)).alias("w"))
             .select(F.col("w")[0].alias("h1"), F.col("w")[1].alias("h2"), F.col("w")[2].alias("h3"), F.col("n").alias("a"),
                     F.col("n").alias("first"), F.col("n").alias("last")))
    other = edges.where("NOT unary")
    threes = along.unionByName(other.select("h1", "h2", "h3", F.col("n").alias("a"), "first", "last"))
    on_path = paths.select(F.explode(_windows("words", 2)).alias("w")).select(F.col("w")[0].alias("h1"), F.col("w")[1].alias("h2"))
    widest = (other.select(F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("x"), "n")
              .groupBy("x.h1", "x.h2").agg(F.max("n").alias("w")))
    twos = (nodes.join(on_path, ["h1", "h2"], "left_anti").join(widest, ["h1", "h2"], "left")
            .where(100 * F.coalesce("w", F.lit(0)) < cover * F.col("f")))
    none = F.lit(None).cast("long")
    return threes.unionByName(twos.select("h1", "h2", none.alias("h3"), F.col("f").alias("a"), none.alias("first"), none.alias("last")))


def _score(a: str, l: str, r: str) -> Column:
    """floor(10^6 a^2 / (l r)) in whole numbers of up to 38 digits."""
    a, l, r = (f"CAST({x} AS DECIMAL(19, 0))" for x in (a, l, r))
    return F.expr(f"CAST({a} * {a} * CAST(1000000 AS DECIMAL(7, 0)) AS DECIMAL(38, 0)) div ({l} * {r})")


def _cut(k: int, l: str, r: str) -> Column:
    """What cutting after word ``k`` gives; the least of several is the one that counts."""
    return F.struct(_score("a", l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, cover: int = COVER, top: int = TOP,
            lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    words, hot, seed = vocabulary(rows)
    found = graph(rows, hot, seed, frequent_words(words, min_count), min_count)
    # the count of a word is the flow of all nodes that begin with it
    flow = found.where("h3 IS NULL").groupBy(F.col("h1").alias("h")).agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    named = cut_lineage(flow.join(words.select("h", "lang", "word"), "h"))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = cut_lineage(candidates(found, min_count, cover))
    small = broadcast_if_small(named, 96)
    for i in (1, 2, 3):
        out = out.join(small.select(F.col("h").alias(f"h{i}"), F.col("f").alias(f"f{i}"), F.col("word").alias(f"w{i}"),
                                    *([F.col("lang")] if i == 1 else [])), f"h{i}", "left" if i == 3 else "inner")
    best = F.when(F.col("h3").isNull(), _cut(1, "f1", "f2")).otherwise(F.least(_cut(1, "f1", "last"), _cut(2, "first", "f3")))
    out = (out.withColumn("best", best)
           .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "best.l", "best.r", "best.score"))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(min_count: int = MIN_COUNT, cover: int = COVER, top: int = TOP) -> str:
    """DuckDB SQL for :func:`phrases`: all grams of one to three words, counted apart."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
        grams AS (
            SELECT lang, ws[i:i + k - 1] AS g, count(*) AS f
            FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM split, (SELECT unnest([1, 2, 3]) AS k))
            GROUP BY ALL),
        cand AS (SELECT lang, g, f AS a FROM grams WHERE len(g) > 1 AND f >= {min_count}),
        longer AS (
            SELECT lang, g, max(a) AS a FROM (
                SELECT lang, g[1:2] AS g, a FROM cand WHERE len(g) = 3
                UNION ALL SELECT lang, g[2:3], a FROM cand WHERE len(g) = 3) GROUP BY ALL),
        kept AS (SELECT c.* FROM cand c LEFT JOIN longer x ON c.lang = x.lang AND c.g = x.g
                 WHERE x.a IS NULL OR 100 * x.a < {cover} * c.a),
        cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM kept),
        scored AS (
            SELECT c.lang, c.g, c.a, c.k, p.f AS l, q.f AS r,
                   CAST(1000000::HUGEINT * c.a * c.a // (p.f::HUGEINT * q.f) AS BIGINT) AS score
            FROM cuts c JOIN grams p ON p.lang = c.lang AND p.g = c.g[1:c.k]
                        JOIN grams q ON q.lang = c.lang AND q.g = c.g[c.k + 1:]),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        sizes AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM split GROUP BY lang)
        SELECT x.lang, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
               array_to_string(g, ' ') AS phrase, a, l, r, n, score
        FROM lowest x JOIN sizes s ON x.lang = s.lang
        QUALIFY rank <= {top}
    """
