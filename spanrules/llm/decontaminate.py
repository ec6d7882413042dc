"""Benchmark decontamination by the q-gram lemma.

A passage of ``L`` characters and a stretch of a document within ``e`` edits of it share at least
``L + 1 - q - q e`` character q-grams, and their diagonals (position in the document less
position in the passage) span at most ``e``. So the shared q-grams of every passage are counted
in bands of ``2 (e + 1)`` diagonals, one beginning every ``e + 1``; a band that reaches the bound is
a region, and an alignment of the passage with the stretch of text that the band covers settles whether it holds the
passage with at most ``e`` edits. Bands whose stretches overlap are aligned as one, and passages with the same
beginning together until they part, or until none can be within its budget: benchmarks are full of passages with
a stem in common, and a document that holds the stem is a region of each.

The budget ``e`` is ``EDIT_RATE`` of the passage's length, less where the lemma would ask for no
shared q-gram. Texts are compared in lower case with every run of white space as one space.

The benchmark is the stated query set: it is held against all documents in blocks of about
``BLOCK_CHARS`` characters, whose q-gram index is what is broadcast. Documents are read once for
each block and never shuffled.

Defined cases: a null text on either side counts as empty; passages shorter than ``Q`` characters
match nothing; equal passages match alike, each under its item; rows that repeat an item and its
text count once; rows that repeat a document get a row each; of several places of a passage in a
document the one with the fewest edits counts, then the first; empty tables give an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrules.llm.common import slices, without_ids
from spanrules.session import cut_lineage

Q = 8
EDIT_RATE = 0.08
BLOCK_CHARS = 2_000_000
TABLE_BITS = 21
POSTINGS = 1 << 22    # expanded at a time
CHECK_EVERY = 64      # characters between two looks at the fewest edits
STOP = 0x110001  # no character: stands between texts
FROM = 1 << 24  # diagonals count from here below the start of the text: longer than any block of passages
BAND_BITS = 31  # for texts of up to 2^31 characters, Arrow's own limit for a string


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(chars: np.ndarray) -> np.ndarray:
    """Hash of the ``Q`` characters that begin at each position."""
    n = len(chars) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(Q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += chars[i:i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def budget(length: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed in a passage: as many as leave the lemma a shared q-gram to ask for."""
    return max(0, min(int(rate * length), (length - Q) // Q))


def build_index(items: list[tuple[int, str]], rate: float) -> dict:
    """Plain arrays: the sorted q-gram hashes, their postings (passage, position), a bit table that
    most other q-grams miss, and the passages with budgets and bounds."""
    texts = [t for _, t in items]
    parts = [_codes(_chars(t)) for t in texts]
    codes = np.concatenate(parts)
    item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    pos = np.concatenate([np.arange(len(p)) for p in parts])
    order = np.argsort(codes, kind="stable")
    keys, start = np.unique(codes[order], return_index=True)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[keys >> np.uint64(64 - TABLE_BITS)] = True
    edits = np.array([budget(len(t), rate) for t in texts])
    length = np.array([len(t) for t in texts])
    return {"ids": [i for i, _ in items], "texts": texts, "keys": keys,
            "start": np.append(start, len(codes)), "item": item[order], "pos": pos[order], "table": table,
            "edits": edits, "need": length + 1 - Q - Q * edits}


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first, count)


class Stretch:
    """A stretch of text, to be aligned with passages: a bit for each of its characters, and as state after some
    characters of a passage the steps up and down, from one end of the stretch to the next, of the
    fewest edits that turn these characters into what ends there."""

    def __init__(self, text: str):
        self.size = len(text)
        self.every = (1 << self.size) - 1
        places: dict[str, list[int]] = {}
        for i, ch in enumerate(text):
            places.setdefault(ch, []).append(i)
        self.places = {}
        for ch, found in places.items():
            bits = np.zeros(self.size, bool)
            bits[found] = True
            self.places[ch] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        self.anywhere = (0, 0)          # the passage may begin anywhere
        self.at_start = (self.every, 0)

    def after(self, state: tuple[int, int], chars: str) -> tuple[int, int]:
        up, down = state
        every, places = self.every, self.places
        for ch in chars:
            same = places.get(ch, 0)
            across = (((same & up) + up) ^ up) | same
            more = down | (every & ~(across | up))
            less = up & across
            more = (more << 1) | 1
            less <<= 1
            same |= down
            up = every & (less | ~(same | more))
            down = every & more & same
        return up, down

    def edits(self, state: tuple[int, int], taken: int) -> np.ndarray:
        """Fewest edits by end of the match, 0 to the size of the stretch, after ``taken`` characters."""
        width = self.size // 8 + 1
        up, down = (np.unpackbits(np.frombuffer(x.to_bytes(width, "little"), np.uint8), bitorder="little")[:self.size]
                    for x in state)
        out = np.full(self.size + 1, taken, np.int64)
        out[1:] += np.cumsum(up.astype(np.int64) - down)
        return out


def place(passage: str, stretch: str, edits: int) -> tuple[int, int]:
    """Start and stop of the first match with just as many ``edits``, the fewest there are."""
    back = Stretch(stretch[::-1])
    ends = back.edits(back.after(back.anywhere, passage[::-1]), len(passage))
    start = len(stretch) - int(np.flatnonzero(ends == edits)[-1])
    rest = Stretch(stretch[start:])
    return start, start + int((rest.edits(rest.after(rest.at_start, passage), len(passage)) == edits).argmax())


def align(passages: list[str], budgets: list[int], stretch: str) -> dict[int, tuple[int, int, int]]:
    """By number in ``passages`` (sorted texts): (edits, start, stop) of the best match of the whole passage
    with a part of ``stretch``, of those with at most as many edits as its budget."""
    bits, found = Stretch(stretch), {}
    todo = [(0, len(passages), 0, bits.anywhere)]   # passages that begin alike, how far they are read, the state
    while todo:
        first, stop, depth, state = todo.pop()
        one, other = passages[first], passages[stop - 1]
        x, y = _chars(one), _chars(other)
        both = min(len(x), len(y))
        apart = np.flatnonzero(x[:both] != y[:both])[:1]
        shared, most = int(apart[0]) if len(apart) else both, max(budgets[first:stop])
        while depth < shared:
            step = min(shared, depth + CHECK_EVERY)
            state, depth = bits.after(state, one[depth:step]), step
            if bits.edits(state, depth).min() > most:
                break
        if depth < shared or bits.edits(state, depth).min() > most:
            continue
        # shorter passages come first among those that begin alike
        while first < stop and len(passages[first]) == depth:
            least = int(bits.edits(state, depth).min())
            if least <= budgets[first]:
                found[first] = (least, *place(passages[first], stretch, least))
            first += 1
        while first < stop:
            ch, last = passages[first][depth], first + 1
            while last < stop and passages[last][depth] == ch:
                last += 1
            todo.append((first, last, depth, state))
            first = last
    return found


def _regions(codes: np.ndarray, text_at: np.ndarray, index: dict) -> np.ndarray:
    """Rows (text, passage, first diagonal) of the bands that reach the bound; diagonals run over
    all texts, laid one after the other."""
    where = np.flatnonzero(index["table"][codes >> np.uint64(64 - TABLE_BITS)])
    slot = np.searchsorted(index["keys"], codes[where])
    slot[slot == len(index["keys"])] = 0
    real = index["keys"][slot] == codes[where]
    where, slot = where[real], slot[real]
    count = index["start"][slot + 1] - index["start"][slot]
    portion = np.cumsum(count) // POSTINGS
    bands, counts = [], []
    for i, j in itertools.pairwise([0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), len(where)]):
        hit = _expand(index["start"][slot[i:j]], count[i:j])
        place = np.repeat(where[i:j], count[i:j])
        item = index["item"][hit]
        step = index["edits"][item] + 1
        text = np.searchsorted(text_at, place, "right") - 1
        band = (place - text_at[text] - index["pos"][hit] + FROM) // step
        key = (text.astype(np.int64) * len(index["ids"]) + item) << BAND_BITS
        one, n = np.unique(np.concatenate([key + band, key + band - 1]), return_counts=True)
        bands.append(one)
        counts.append(n)
    both, at = np.unique(np.concatenate(bands), return_inverse=True)
    n = np.bincount(at, np.concatenate(counts), len(both))
    item = (both >> BAND_BITS) % len(index["ids"])
    found = np.flatnonzero(n >= index["need"][item])
    both, item = both[found], item[found]
    step = index["edits"][item] + 1
    return np.column_stack([(both >> BAND_BITS) // len(index["ids"]), item,
                            (both & ((1 << BAND_BITS) - 1)) * step - FROM])


def _together(wanted: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """Sorted stretches (start, stop, passage) that overlap as one, at most twice as long as the shortest in it."""
    a = b = least = 0
    items: set[int] = set()
    for start, stop, item in wanted:
        if items and (start >= b or max(b, stop) - a > 2 * min(least, stop - start)):
            yield a, b, tuple(sorted(items))
            items = set()
        if not items:
            a, b, least = start, stop, stop - start
        items.add(item)
        b, least = max(b, stop), min(least, stop - start)
    if items:
        yield a, b, tuple(sorted(items))


def _matches(part: str, items: tuple[int, ...], index: dict) -> dict[int, tuple[int, int, int]]:
    """(edits, start, stop) by passage of ``items`` that the stretch ``part`` holds."""
    found, rest = {}, []
    for item in items:
        passage = index["texts"][item]
        at = part.find(passage)
        if at >= 0:
            found[item] = (0, at, at + len(passage))
        elif index["edits"][item]:
            rest.append(item)
    rest.sort(key=lambda item: index["texts"][item])
    near = align([index["texts"][i] for i in rest], [int(index["edits"][i]) for i in rest], part) if rest else {}
    return found | {rest[i]: match for i, match in near.items()}


def find_passages(texts: list[str | None], index: dict) -> list[tuple[int, int, int, int, int]]:
    """(text, passage, edits, start, stop) of the passages that the texts hold, in terms of the
    normalised texts."""
    plain = [_chars(normalise(t)) for t in texts]
    gap = np.full(Q, STOP, np.uint32)
    text_at = np.cumsum([0, *[len(p) + Q for p in plain]])[:-1]
    codes = _codes(np.concatenate([x for p in plain for x in (p, gap)]))
    stretches: dict[int, list[tuple[int, int, int]]] = {}
    for text, item, low in _regions(codes, text_at, index).tolist():
        edits, size = int(index["edits"][item]), len(index["texts"][item])
        a, b = max(0, low - edits), min(len(plain[text]), low + 2 * (edits + 1) + size + edits)
        if a < b:
            stretches.setdefault(text, []).append((a, b, item))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    known: dict[tuple[str, tuple[int, ...]], dict[int, tuple[int, int, int]]] = {}   # copies hold the same
    for text, wanted in stretches.items():
        for a, b, items in _together(sorted(wanted)):
            part = plain[text][a:b].tobytes().decode("utf-32-le")
            if (part, items) not in known:
                known[part, items] = _matches(part, items, index)
            for item, (edits, start, stop) in known[part, items].items():
                found = (edits, a + start, a + stop)
                best[text, item] = min(best.get((text, item), found), found)
    return [(*k, *v) for k, v in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and passage that it holds: ``doc_id, item_id, edits, start, stop``."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"),
                             F.coalesce(F.col(item_text), F.lit("")).alias("text")).where("item IS NOT NULL").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // BLOCK_CHARS + 1
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {dict(docs.dtypes)[id_col]}, item_id long, edits int, start long, stop long"
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text")
        known = [(i, t) for i, t in ((r["item"], normalise(r["text"])) for r in part.collect()) if len(t) >= Q]
        index = spark.sparkContext.broadcast(build_index(known, rate) if known else None)

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, 2 << 20) if index.value is not None else ():
                    found = find_passages(batch.column("text").to_pylist(), index.value)
                    yield pa.record_batch([
                        batch.column("id").take(pa.array([x[0] for x in found], pa.int64())),
                        pa.array([index.value["ids"][x[1]] for x in found], pa.int64()),
                        pa.array([x[2] for x in found], pa.int32()), pa.array([x[3] for x in found], pa.int64()),
                        pa.array([x[4] for x in found], pa.int64())], names=["id", "item_id", "edits", "start", "stop"])

        one = rows.mapInArrow(search, schema)
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a passage, columns unchanged."""
    found = contaminated(docs, benchmark, rate, id_col, text_col)
    return without_ids(docs, cut_lineage(found.select(id_col).distinct()), id_col)
