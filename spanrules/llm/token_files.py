"""Token ids in binary files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents one after the other, two bytes an id where the
vocabulary allows it, and no offset table: the ends of the documents are an ascending sequence and
are kept as Elias-Fano code. Of each end the low ``l`` bits are stored as they are, the rest in
unary in a bit vector, about ``2 + l`` bits a document with ``l = log2(ids / documents)``. The place
of every ``SAMPLE``-th one of that vector (32 bits) makes ``select`` a short scan, so the bounds of
any document come from the code itself (:class:`EliasFano`). The document ids, ascending too, are
a second such sequence.

Layout: magic, ids, ends (low, high, samples), document ids (low, high, samples), a JSON footer, its
length (4 bytes), magic. Files are written front to back, so any file system of ``pyarrow.fs`` does.

:func:`write` deals the documents by ranges of their id, each task encodes and writes one file; a
file counts once the manifest (a table in the same folder, written by Spark after the tasks) names
it, so a task that runs again leaves nothing that is read. :func:`documents` reads the files back.

A word's ids do not depend on its neighbours (the vocabulary splits at white space and normalises
nothing across it), so each distinct word is encoded once per task by the tokenizers library.

Defined cases: a null text is the empty text; an empty text has only the end id; null ids come
first, rows of one id in the order of a hash of their texts; ids are integers, negative ones
too; an empty table makes no file and reads back empty; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanrules.llm.common import slices, whole_text
from spanrules.session import scratch_path, ship_by_value

MAGIC = b"SPANTOK1"
SAMPLE = 512
FILE_BYTES = 64 << 20  # of text a file, counting ROW_BYTES for each document
ROW_BYTES = 64
SLICE_BYTES = 16 << 20  # of text encoded at once
MEMO = 1 << 20         # words whose ids a task remembers
READ_IDS = 1 << 22     # ids read at once

ship_by_value(__name__)


# ------------------------------------------------------------------ Elias-Fano


class EliasFano:
    """An ascending sequence of ``n`` integers from 0, repeats allowed, with ``select``."""

    def __init__(self, n: int, l: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.l, self.low, self.high, self.samples = n, l, low, high, samples

    @classmethod
    def of(cls, values) -> "EliasFano":
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, *(np.empty(0, d) for d in (np.uint8, np.uint8, "<u4")))
        if (v[1:] < v[:-1]).any():
            raise ValueError("the sequence must ascend")
        l = max(0, (int(v[-1]) // n).bit_length() - 1)
        ones = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        if int(ones[-1]) >= 1 << 32:
            raise ValueError("too many documents for one file")
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        low = ((v[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, l, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"),
                   ones[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        first, last = i * self.l, (i + 1) * self.l
        raw = int.from_bytes(self.low[first // 8:(last + 7) // 8].tobytes(), "little")
        return raw >> first % 8 & (1 << self.l) - 1

    def select(self, i: int) -> int:
        """Value ``i``: from the sampled one before it, on along the bit vector."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        while True:
            window = np.unpackbits(self.high[byte:byte + SAMPLE], bitorder="little")
            window[:skip] = 0
            ones = np.flatnonzero(window)
            if left < len(ones):
                return (byte * 8 + int(ones[left]) - i) << self.l | self._low(i)
            left, byte, skip = left - len(ones), byte + SAMPLE, 0

    def values(self) -> np.ndarray:
        """The whole sequence, as uint64."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64)
        high = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.l)
        low = np.unpackbits(self.low, bitorder="little")[:self.n * self.l].reshape(self.n, self.l)
        return high | (low.astype(np.uint64) << np.arange(self.l, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def parts(self) -> tuple[dict, list[bytes]]:
        made = [x.tobytes() for x in (self.low, self.high, self.samples)]
        return {"n": self.n, "l": self.l, "sizes": [len(x) for x in made]}, made

    @classmethod
    def read(cls, head: dict, raw: bytes) -> "EliasFano":
        a, b, _ = np.cumsum(head["sizes"])
        return cls(head["n"], head["l"], np.frombuffer(raw[:a], np.uint8), np.frombuffer(raw[a:b], np.uint8),
                   np.frombuffer(raw[b:], "<u4"))


# ------------------------------------------------------------------ files


def _open(path: str):
    """File system and path in it: a local (shared) folder, or any that pyarrow reaches."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), path)


class TokenFile:
    """One file, opened for reading: only the codes are held, ids are read where they are asked for."""

    def __init__(self, path: str):
        system, inner = _open(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        tail = self.file.read_at(4 + len(MAGIC), size - 4 - len(MAGIC))
        if tail[4:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        length = int.from_bytes(tail[:4], "little")
        self.head = json.loads(self.file.read_at(length, size - len(tail) - length))
        at = len(MAGIC) + self.head["n_ids"] * self.head["width"]
        codes = []
        for part in ("ends", "doc_ids"):
            n = sum(self.head[part]["sizes"])
            codes.append(EliasFano.read(self.head[part], self.file.read_at(n, at)))
            at += n
        self.ends, self.keys = codes

    def __len__(self) -> int:
        return self.ends.n

    def bounds(self, i: int) -> tuple[int, int]:
        """Where the ids of document ``i`` of the file start and end."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` (exclusive) as uint32."""
        w = self.head["width"]
        raw = self.file.read_at((last - first) * w, len(MAGIC) + first * w)
        return np.frombuffer(raw, f"<u{w}").astype("<u4")

    def doc_ids(self) -> list[int | None]:
        base = self.head["base"]
        return [None] * self.head["n_null"] + [base + int(x) for x in self.keys.values()]

    def close(self) -> None:
        self.file.close()


class _Writer:
    def __init__(self, path: str, width: int):
        system, inner = _open(path)
        self.out, self.width = system.open_output_stream(inner), width
        self.out.write(MAGIC)
        self.lengths: list[np.ndarray] = []
        self.keys: list[pa.Array] = []

    def add(self, keys: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.lengths.append(lengths)
        self.keys.append(keys)

    def close(self) -> tuple[int, int]:
        ends = np.cumsum(np.concatenate(self.lengths))
        keys = pa.chunked_array(self.keys).cast(pa.int64())
        known = keys.drop_null().to_numpy()
        base = int(known[0]) if len(known) else 0
        head = {"width": self.width, "n_ids": int(ends[-1]), "n_null": keys.null_count, "base": base}
        for part, code in (("ends", EliasFano.of(ends)),
                           ("doc_ids", EliasFano.of(known.astype(np.uint64) - np.uint64(base % (1 << 64))))):
            head[part], made = code.parts()
            for raw in made:
                self.out.write(raw)
        footer = json.dumps(head).encode()
        self.out.write(footer + len(footer).to_bytes(4, "little") + MAGIC)
        self.out.close()
        return len(ends), int(ends[-1])


# ------------------------------------------------------------------ encoding


class _Words:
    """Ids of the distinct words seen so far, in one array; ``slot[word]`` says where."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        # a run of letters is one piece to the pre-tokenizer; its last id, and no other, closes a word
        closes = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        closes[[i for t, i in tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True
        self.closes = closes
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.first, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def slots(self, words: pa.Array) -> np.ndarray:
        """Where the ids of each of the (distinct) words are."""
        known = words.to_pylist()
        new = pa.array([w for w in known if w not in self.slot], words.type)
        letters = pc.match_substring_regex(new, r"^\p{L}+$")
        self._letters(new.filter(letters).to_pylist())
        self._learn(new.filter(pc.invert(letters)).to_pylist())
        return np.fromiter(map(self.slot.__getitem__, known), np.int64, len(known))

    def _letters(self, words: list[str]) -> None:
        """Words of letters only, many in one text: cut where a word closes."""
        for at in range(0, len(words), JOINED):
            some = words[at:at + JOINED]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):  # each word closes once at least, so here exactly once
                self._keep(some, ids, np.diff(ends, prepend=0))
            else:  # a letter whose lower case holds a mark
                self._learn(some)

    def _learn(self, words: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self._keep(words, np.fromiter(chain.from_iterable(got), np.int32),
                   np.fromiter(map(len, got), np.int64, len(got)))

    def _keep(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.slot.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, size])


WORD_END = "</w>"
JOINED = 20_000
# a closing mark after an ASCII letter is a piece of its own to the pre-tokenizer
CLOSED = r"^[\x00-\x7f]*[a-z][.,;:!?]$"


def encode_texts(texts: pa.Array, words: _Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, each closed by ``end_id``; and how many each has."""
    if len(words.slot) > MEMO:
        words.clear()
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    # distinct words: ASCII ones lowered as the normaliser does, in two pieces: all but a closing mark, and the mark
    word = coded.dictionary
    word = pc.if_else(pc.string_is_ascii(word), pc.ascii_lower(word), word)
    closed = pc.match_substring_regex(word, CLOSED)
    pieces = []
    for piece in (pc.if_else(closed, pc.utf8_slice_codeunits(word, 0, -1), word),
                  pc.if_else(closed, pc.utf8_slice_codeunits(word, -1), "")):
        piece = piece.dictionary_encode()
        pieces.append(words.slots(piece.dictionary)[piece.indices.to_numpy()])
    slot = np.stack(pieces, 1).ravel()
    flat = _spread(words.flat, words.first[slot], words.size[slot])
    ends = np.concatenate([[0], np.cumsum(words.size[slot])])[::2]
    # and all words of the texts, by their distinct word
    order = coded.indices.to_numpy()
    size = np.diff(ends)[order]
    out = _spread(flat, ends[:-1][order], size)
    n_words = np.cumsum(split.value_lengths().to_numpy())
    after = np.concatenate([[0], np.cumsum(size)])[n_words]
    return np.insert(out, after, end_id), np.diff(after, prepend=0) + 1


def _spread(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices ``flat[first:first + size]`` one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(first - (ends - size), size)]


def _by_words(spec: dict) -> bool:
    """Whether words can be encoded one by one: every step works within runs of non-blanks."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    plain = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"}
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return plain and pre[0].get("type") == "Split" and bool(pre[0].get("invert")) and not spec.get("post_processor")


# ------------------------------------------------------------------ Spark jobs


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text`` dealt by ranges of the id, ascending in each partition. Hash of the text and row
    number break ties, so that one id (null, say) may hold any share of the rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(F.col(text_col).cast("string")).alias("text"))
    weight = rows.agg(F.sum(F.octet_length("text") + F.lit(ROW_BYTES))).first()[0] or 0
    keys = ("id", "h", "r")
    return (rows.withColumn("h", F.xxhash64("text")).withColumn("r", F.monotonically_increasing_id())
            .repartitionByRange(1 + weight // FILE_BYTES, *keys).sortWithinPartitions(*keys).select("id", "text"))


def write(docs: DataFrame, path: str, out: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all documents, in ascending order of their id, into the folder ``out``; ``path``
    is the tokenizer's JSON file. Returns the manifest: ``part, file, n_docs, n_ids, file_start``."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not _by_words(spec):
        raise ValueError("this tokenizer's steps reach across white space")
    shared = spark.sparkContext.broadcast(json.dumps(spec))
    top = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    width = 2 if top < 1 << 16 else 4
    if "://" not in out and not out.startswith("file:"):
        import os

        os.makedirs(out, exist_ok=True)
    elif out.startswith("file:"):
        system, inner = _open(out)
        system.create_dir(inner, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        part = TaskContext.get().partitionId()
        file, words = None, None
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES, rows=1 << 20):
                if file is None:
                    words = _Words(Tokenizer.from_str(shared.value))
                    name = f"part-{part:05d}-{uuid.uuid4().hex}.tok"
                    file = _Writer(f"{out.rstrip('/')}/{name}", width)
                file.add(batch.column("id"), *encode_texts(batch.column("text"), words, end_id))
        if file is not None:
            n_docs, n_ids = file.close()
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()),
                                   pa.array([n_ids], pa.int64())], names=["part", "file", "n_docs", "n_ids"])

    made = _ordered(docs, id_col, text_col).mapInArrow(run, "part int, file string, n_docs long, n_ids long")
    table = f"{out.rstrip('/')}/manifest"
    made.write.parquet(table)
    return manifest(spark, out)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """One row per file, in order; ``file_start`` counts the ids of all files before it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file, not per document
    rows = spark.read.parquet(f"{out.rstrip('/')}/manifest")
    return rows.withColumn("file_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def documents(spark: SparkSession, out: str) -> DataFrame:
    """Reads the files back: ``doc_id, start, n_tokens, ids array<int>`` per document."""
    return _read(spark, out, "doc_id long, start long, n_tokens long, ids array<int>", _with_ids)


def digests(spark: SparkSession, out: str) -> DataFrame:
    """Reads the files back: ``doc_id, start, n_tokens, ids_crc32`` per document."""
    return _read(spark, out, "doc_id long, start long, n_tokens long, ids_crc32 long", _with_crc)


def _with_ids(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))


def _with_crc(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    import zlib

    raw, at = memoryview(ids.tobytes()), [0, *(ends * 4).tolist()]
    return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])], pa.int64())


def _read(spark: SparkSession, out: str, schema: str, column) -> DataFrame:
    files = manifest(spark, out)
    n = max(1, files.count())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(f"{out.rstrip('/')}/{row['file']}")
                ends, keys = file.ends.values().astype(np.int64), file.doc_ids()
                i, done = 0, 0
                while i < len(ends):
                    j = max(i + 1, int(np.searchsorted(ends, done + READ_IDS, "right")))
                    ids = file.ids(done, int(ends[j - 1]))
                    length = np.diff(ends[i:j], prepend=done)
                    yield pa.record_batch([
                        pa.array(keys[i:j], pa.int64()), pa.array(row["file_start"] + ends[i:j] - length, pa.int64()),
                        pa.array(length, pa.int64()), column(ids, ends[i:j] - done)], names=names)
                    i, done = j, int(ends[j - 1])
                file.close()

    # a task for each file
    return files.select("part", "file", "file_start").repartitionByRange(n, "part").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` into a folder of the shared checkpoint folder and reads the digests back."""
    out = scratch_path(docs.sparkSession, f"tokens-{uuid.uuid4().hex}")
    write(docs, path, out, end_id, id_col, text_col)
    return digests(docs.sparkSession, out).withColumnRenamed("doc_id", id_col)
