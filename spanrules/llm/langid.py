"""Language identification of mixed-language text.

Words are runs of letters of one script. The script narrows the languages that come into question;
each of these scores a word by the log-probabilities of its character trigrams. Viterbi over the
words of a text, with a penalty for every switch of language, labels spans; the language of the
text is the one whose spans hold most letters, its score their share of all letters.

The models are learned from labelled documents: a sample of about ``PER_LANGUAGE`` documents of
each language (a documented bound; the choice hashes the id), of which only trigram counts reach
the driver. Prediction reads the text alone, every text whole, and needs no shuffle: a map over the
documents, with the steps of Viterbi taken for all texts of a slice at once.

Defined cases: a text that is null or has no letter has no spans, language ``und`` and score 0;
so has every text when there is nothing to learn from. A word in a script that no language was
learned in speaks for none. Of equally good labels the language that sorts first wins. Rows
without an id are never learned from. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrules.llm.common import slices

PER_LANGUAGE = 1500
SWITCH = 10.0        # log-odds that a switch of language costs
BUCKETS_BITS = 16    # of the trigram tables
SCRIPT_SHARE = 0.002  # of a language's letters, for a script to count as its own
NEVER = -1e4
UNKNOWN = "und"

# First code points of blocks of letters and their scripts, from the Unicode charts.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"),
    (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2E80, "Han"),
    (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x31F0, "Kana"), (0x3400, "Han"), (0xA000, "Yi"),
    (0xA640, "Cyrillic"), (0xA720, "Latin"), (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"),
    (0x20000, "Han"),
]


def _char_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For code points below 0x20000: lower case; 0 no letter, 1 mark, 2 letter; script."""
    import unicodedata

    n = 0x20000
    low = np.arange(n, dtype=np.uint32)
    kind = np.zeros(n, np.uint8)
    for i in range(n):
        c = chr(i)
        if c.isalpha():
            kind[i] = 2
            if len(c.lower()) == 1:
                low[i] = ord(c.lower())
        elif unicodedata.category(c)[0] == "M":
            kind[i] = 1
    names = sorted({s for _, s in SCRIPTS})
    first = [a for a, _ in SCRIPTS]
    ids = np.array([names.index(s) for _, s in SCRIPTS], np.uint8)
    return low, kind, ids[np.searchsorted(first, np.arange(n), "right") - 1]


class _Words:
    """The words of some texts: text, first and last code point, script, letters, trigram buckets."""

    def __init__(self, texts: list[str | None], tables: tuple):
        low, kind, script = tables
        raw = np.frombuffer("".join(f"{t or ''}\n" for t in texts).encode("utf-32-le"), np.uint32)
        at = np.cumsum([0, *[len(t or "") + 1 for t in texts]])
        c = np.minimum(raw, 0x1FFFF)
        k = kind[c]
        k[raw >= 0x20000] = 2
        sc = script[c]
        sc[raw >= 0x20000] = script[0x4E00]
        inside = k > 0
        letter = k == 2
        prev_in = np.concatenate([[False], inside[:-1]])
        change = np.concatenate([[False], (sc[1:] != sc[:-1]) & letter[1:] & letter[:-1]])
        first = inside & (~prev_in | change)
        start = np.flatnonzero(first)
        next_new = np.concatenate([first[1:], [True]])
        next_out = np.concatenate([~inside[1:], [True]])
        stop = np.flatnonzero(inside & (next_new | next_out)) + 1
        x = np.where(inside, low[c], 0).astype(np.uint64)
        left = np.concatenate([[0], x[:-1]]).astype(np.uint64)
        right = np.concatenate([x[1:], [0]]).astype(np.uint64)
        h = (left * np.uint64(0x9E3779B97F4A7C15) + x * np.uint64(0xC2B2AE3D27D4EB4F)
             + right * np.uint64(0x165667B19E3779F9))
        h ^= h >> np.uint64(31)
        self.bucket = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKETS_BITS)).astype(np.int32)
        letters = np.concatenate([[0], np.cumsum(letter)])
        held = letters[stop] - letters[start]
        real = held > 0  # marks alone are no word
        self.start, self.stop, self.letters = start[real], stop[real], held[real]
        self.text = np.searchsorted(at, self.start, "right") - 1
        self.at = at
        self.script = sc[self.start]
        self.inside = inside


def count_trigrams(texts: list[str], tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the trigram buckets, and letters by script."""
    w = _Words(texts, tables)
    grams = np.bincount(w.bucket[w.inside], minlength=1 << BUCKETS_BITS)
    return grams, np.bincount(w.script, weights=w.letters, minlength=256).astype(np.int64)


def make_model(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict | None:
    """Log-probabilities by trigram bucket and language, and the languages of each script."""
    langs = sorted(c for c, (grams, _) in counts.items() if grams.sum())
    if not langs:
        return None
    grams = np.array([counts[c][0] for c in langs], float) + 0.1
    scripts = np.array([counts[c][1] for c in langs], float)
    known = scripts >= SCRIPT_SHARE * scripts.sum(1, keepdims=True)
    known &= scripts > 0
    return {"langs": langs, "logp": np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32).copy(),
            "allowed": known.T.copy(), "tables": _char_tables()}


def word_scores(w: _Words, model: dict) -> np.ndarray:
    """Log-probability of every word in every language, ``NEVER`` where its script rules it out."""
    if not len(w.start):
        return np.zeros((0, len(model["langs"])), np.float32)
    gains = model["logp"][w.bucket]
    gains[~w.inside] = 0
    total = np.add.reduceat(gains, w.start)
    # up to the next word there are no letters but marks that stand alone: these count to neither
    allowed = model["allowed"][w.script]
    some = allowed.any(1)
    return np.where(some[:, None], np.where(allowed, total, NEVER), 0).astype(np.float32)


def viterbi(score: np.ndarray, size: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word: texts of ``size`` words lie one after the other. Takes step t
    of all texts that have one at once."""
    n, langs = score.shape
    path = np.zeros(n, np.int16)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    if not len(order):
        return path
    size_in = size[order]
    first = (np.cumsum(size) - size)[order]
    active = np.searchsorted(-size_in, -np.arange(size_in[0]), "left")  # texts longer than t words
    stay = np.ones((n, langs), bool)
    top = np.zeros(n, np.int16)
    value = score[first].astype(np.float64)
    ended = np.empty((len(order), langs))
    for t in range(1, size_in[0]):
        m = active[t]
        if m < len(value):
            ended[m:len(value)] = value[m:]
            value = value[:m]
        at = first[:m] + t
        best = value.argmax(1)
        other = value[np.arange(m), best][:, None] - penalty
        top[at] = best
        stay[at] = value >= other
        value = np.maximum(value, other) + score[at]
    ended[:len(value)] = value
    state = ended.argmax(1)
    path[first + size_in - 1] = state
    for t in range(size_in[0] - 1, 0, -1):
        m = active[t]
        at = first[:m] + t
        now = path[at]
        path[at - 1] = np.where(stay[at, now], now, top[at])
    return path


def label(texts: list[str | None], model: dict, penalty: float = SWITCH, part: int = 1 << 20):
    """For each text its spans ``(start, stop, language, letters)`` in code points, as flat arrays with
    offsets, and its language and score. Words are scored in parts of about ``part`` characters."""
    words, scores, group, used, base = [], [], [], 0, 0
    for i, t in enumerate(texts):
        group.append(t)
        used += len(t or "")
        if used >= part or i + 1 == len(texts):
            w = _Words(group, model["tables"])
            scores.append(word_scores(w, model))
            words.append((w.text + base, w.start - w.at[w.text], w.stop - w.at[w.text], w.letters))
            base, group, used = base + len(group), [], 0
    text, start, stop, letters = (np.concatenate(x) for x in zip(*words))
    n, langs = len(texts), len(model["langs"])
    state = viterbi(np.concatenate(scores), np.bincount(text, minlength=n), penalty)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (state[1:] != state[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(text))[:len(head)] - 1
    sums = np.add.reduceat(letters, head) if len(head) else np.empty(0, np.int64)
    by = np.bincount(text * langs + state, weights=letters, minlength=n * langs).reshape(n, langs)
    total = by.sum(1)
    best = by.argmax(1)
    share = by[np.arange(n), best] / np.maximum(total, 1)
    offsets = np.searchsorted(text[head], np.arange(n + 1))
    return (offsets, start[head], stop[tail], state[head], sums), best, share, total > 0


# ------------------------------------------------------------------ Spark jobs


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> dict | None:
    """Models from a sample of about ``per_language`` of the ``docs`` of each language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not sizes:
        return None
    share = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 30)) < share * (1 << 30)
    sample = (rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                          F.col(lang_col).cast("string").alias("lang")).where(drawn).select("text", "lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, sums = _char_tables(), {}
        for whole in batches:
            for batch in slices(whole, 1 << 20):
                langs = batch.column("lang").to_pylist()
                texts = batch.column("text").to_pylist()
                for lang in set(langs):
                    got = count_trigrams([t for t, x in zip(texts, langs) if x == lang], tables)
                    had = sums.get(lang, (0, 0))
                    sums[lang] = (got[0] + had[0], got[1] + had[1])
        yield pa.record_batch([pa.array(list(sums), pa.string()),
                               pa.array([g.astype("<i8").tobytes() for g, _ in sums.values()], pa.binary()),
                               pa.array([s.astype("<i8").tobytes() for _, s in sums.values()], pa.binary())],
                              names=["lang", "grams", "scripts"])

    # a few tasks: each sends a table of counts for each language, whatever the number of documents
    found = sample.repartition(6).mapInArrow(count, "lang string, grams binary, scripts binary").collect()
    counts: dict[str, tuple] = {}
    for r in found:
        had = counts.get(r["lang"], (0, 0))
        counts[r["lang"]] = (np.frombuffer(r["grams"], "<i8") + had[0], np.frombuffer(r["scripts"], "<i8") + had[1])
    return make_model(counts)


def label_spans(docs: DataFrame, model: dict | None, penalty: float = SWITCH, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``id_col, spans array<struct<start, stop, lang, letters>>, lang_pred, score`` per document."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"id {kind}, spans array<struct<start: long, stop: long, lang: string, letters: long>>, "
              "lang_pred string, score double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of the trigram tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value or make_model({"": (np.ones(1 << BUCKETS_BITS), np.ones(256))})
        langs = np.array(model["langs"], object)
        for whole in batches:
            for batch in slices(whole, 8 << 20):
                spans, best, share, has = label(batch.column("text").to_pylist(), model, penalty)
                has = has & (shared.value is not None)
                offsets = spans[0] if shared.value is not None else spans[0] * 0
                cut = slice(0, offsets[-1])
                struct = pa.StructArray.from_arrays(
                    [pa.array(spans[1][cut], pa.int64()), pa.array(spans[2][cut], pa.int64()),
                     pa.array(langs[spans[3][cut]], pa.string()), pa.array(spans[4][cut], pa.int64())],
                    names=["start", "stop", "lang", "letters"])
                yield pa.record_batch([
                    batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct),
                    pa.array(np.where(has, langs[best], UNKNOWN), pa.string()),
                    pa.array(np.where(has, share, 0.0), pa.float64())], names=["id", "spans", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
