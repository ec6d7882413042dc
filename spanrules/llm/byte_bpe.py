"""Byte-level BPE encoding and decoding by a two-tier lookup.

Text is cut into pre-tokens by the vocabulary's pattern. Tier one is a minimal perfect hash over
the vocabulary: one probe tells whether a whole pre-token is a token. Tier two takes the misses:
their bytes form a linked list, a heap holds the ranks of adjacent pairs, and the pair of the
lowest rank (the first of equals) is merged until none is left; every push and pop costs
O(log n), so a pre-token of any length takes O(n log n).

The hash table, the ranks and the tokens' bytes are what is broadcast: their size is that of the
vocabulary file. Encoding and decoding are maps over the documents without a shuffle. A task
remembers the pre-tokens it has met, ``MEMO`` of them at most.

Defined cases: a null or empty text has no ids and decodes to no bytes; whole texts are encoded,
special tokens never are; the other columns of the table are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrules.llm.common import slices

MEMO = 300_000
MEMO_BYTES = 64  # longer pre-tokens are not remembered
BUCKET = 3       # keys per bucket of the perfect hash


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a line holds a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


# ------------------------------------------------------------------ tier one


def _slot(h: int, d: int, n: int) -> int:
    """Slot of hash ``h`` under displacement ``d``; a negative one is the slot itself."""
    return -d - 1 if d < 0 else (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 24) % n


def perfect_hash(keys: list[bytes]) -> tuple[list[int], list[int]]:
    """Displacements by bucket, and the index of the key in each of ``len(keys)`` slots.

    Hash and displace: the fullest buckets first look for a displacement that puts all their keys
    into free slots; buckets of one key take the slots that are left.
    """
    n = len(keys)
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(n // BUCKET + 1)]
    for i, key in enumerate(keys):
        h = xxhash.xxh3_64_intdigest(key)
        buckets[h % len(buckets)].append((h, i))
    displace, slots = [0] * len(buckets), [-1] * n
    alone = []
    for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
        own = buckets[b]
        if len(own) < 2:
            alone += [b] * len(own)
            continue
        d = 0
        while True:
            at = {_slot(h, d, n) for h, _ in own}
            if len(at) == len(own) and all(slots[s] < 0 for s in at):
                break
            d += 1
        displace[b] = d
        for h, i in own:
            slots[_slot(h, d, n)] = i
    free = (s for s in range(n) if slots[s] < 0)
    for b in alone:
        s = next(free)
        displace[b], slots[s] = -s - 1, buckets[b][0][1]
    return displace, slots


def vocabulary(ranks: dict[bytes, int]) -> dict:
    """Plain tables for the executors: the perfect hash with the token and id in each slot, the
    ranks, and the bytes of all ids, one after the other, with their offsets."""
    keys = list(ranks)
    displace, slots = perfect_hash(keys)
    ids = list(ranks.values())
    size = max(ids, default=-1) + 1
    tokens = [b""] * size
    for token, i in ranks.items():
        tokens[i] = token
    return {"displace": displace, "keys": [keys[i] for i in slots], "ids": [ids[i] for i in slots],
            "ranks": ranks, "flat": np.frombuffer(b"".join(tokens), np.uint8),
            "at": np.cumsum([0, *map(len, tokens)])}


def whole_token(piece: bytes, voc: dict) -> int | None:
    """The id of ``piece`` if it is a token: one probe of the perfect hash and one comparison."""
    keys = voc["keys"]
    if not keys:
        return None
    h = xxhash.xxh3_64_intdigest(piece)
    slot = _slot(h, voc["displace"][h % len(voc["displace"])], len(keys))
    return voc["ids"][slot] if keys[slot] == piece else None


# ------------------------------------------------------------------ tier two


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``piece`` by merges: a heap of pair ranks over a linked list of parts."""
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    live = bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        if not live[i]:
            continue
        mid = after[i]
        if mid >= n or after[mid] != end:
            continue                      # one of the two parts has been merged meanwhile
        after[i], live[mid] = end, 0
        if end < n:
            before[end] = i
            stop = after[end]
            if (r := ranks.get(piece[i:stop])) is not None:
                heappush(heap, (r, i, stop))
        left = before[i]
        if left >= 0 and (r := ranks.get(piece[left:end])) is not None:
            heappush(heap, (r, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


class _Pieces(dict):
    """Ids of the pre-tokens met so far; looks up those it does not have."""

    def __init__(self, voc: dict):
        super().__init__()
        self.voc = voc

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        one = whole_token(raw, self.voc)
        ids = (one,) if one is not None else tuple(merge(raw, self.voc["ranks"]))
        if len(raw) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


def encode_texts(texts: list[str | None], pieces: _Pieces, cut) -> list[np.ndarray]:
    from itertools import chain

    return [np.fromiter(chain.from_iterable(map(pieces.__getitem__, cut(t or ""))), np.int32) for t in texts]


def decode_ids(ids: np.ndarray, voc: dict) -> bytes:
    """The bytes of the tokens, gathered from the table in one step."""
    ids = np.asarray(ids, np.int64)
    first, size = voc["at"][ids], voc["at"][ids + 1] - voc["at"][ids]
    ends = np.cumsum(size)
    where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
    return voc["flat"][where].tobytes()


# ------------------------------------------------------------------ Spark jobs


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>, decoded binary``: the ids of every whole text, and what they decode
    to, in one pass. ``path`` is the vocabulary file, ``pattern`` cuts texts into pre-tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(read_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        voc = shared.value
        pieces, cut = _Pieces(voc), regex.compile(pattern).findall
        for whole in batches:
            for batch in slices(whole, 2 << 20):
                ids = encode_texts(batch.column("text").to_pylist(), pieces, cut)
                yield pa.record_batch([
                    batch.column("id"),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()),
                                             pa.array(np.concatenate(ids) if ids else [], pa.int32())),
                    pa.array([decode_ids(x, voc) for x in ids], pa.binary())], names=["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids``: the token ids of every whole text."""
    return round_trip(docs, path, pattern, id_col, text_col).select(id_col, "ids")


def decode(frame: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``frame`` with the bytes that its ids stand for (null ids: no bytes)."""
    shared = frame.sparkSession.sparkContext.broadcast(vocabulary(read_ranks(path)))

    @F.pandas_udf("binary")
    def bytes_of(ids):
        return ids.map(lambda x: decode_ids(x if x is not None else [], shared.value))

    return frame.withColumn(to, bytes_of(F.col(ids_col)))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_tokens, ids_sha256, decoded_sha256``."""
    return round_trip(docs, path, pattern, id_col, text_col).select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
