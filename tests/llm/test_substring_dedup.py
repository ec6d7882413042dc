import random

import numpy as np
import pyarrow as pa

from spanrules.llm import substring_dedup as sd


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuvwz") for _ in range(rng.randrange(2, 10))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows],
                                 "doc_id long, text string, start int, chunks int, key string")


def test_gear_hash_rolls():
    raw = np.frombuffer(prose(random.Random(1), 60).encode(), np.uint8)
    gear, h, want = sd._gear(), 0, []
    for b in raw:
        h = (2 * h + int(gear[b])) % (1 << 32)
        want.append(h)
    assert sd.gear_hash(raw)[sd.WINDOW:].tolist() == want[sd.WINDOW:]


def test_chunks_cover_the_text_and_survive_insertions():
    rng = random.Random(2)
    a = prose(rng, 400) + " äöü漢字 " * 20
    b = a[:300] + "inserted words here" + a[300:]
    offsets, (start, size, d1, d2, again) = sd._chunks(pa.array([a, None, b, ""]))
    assert np.diff(offsets)[[1, 3]].tolist() == [0, 0]
    for text, i in ((a, 0), (b, 2)):
        s, n = start[offsets[i]:offsets[i + 1]], size[offsets[i]:offsets[i + 1]]
        assert "".join(text[x:x + y] for x, y in zip(s, n)) == text
    first, second = (set(zip(d1[offsets[i]:offsets[i + 1]], d2[offsets[i]:offsets[i + 1]])) for i in (0, 2))
    assert len(first - second) <= 4


def test_planted_passages_are_found(spark):
    rng = random.Random(3)
    passages = [prose(rng, 60) for _ in range(4)]
    rows, holds = [], {}
    for i in range(80):
        text = prose(rng, 150)
        if i % 4 == 1:
            p = passages[i % len(passages) if i < 40 else 0]
            at = rng.randrange(len(text))
            text = text[:at] + p + text[at:]
            holds[i] = p
        rows.append((i, text))
    shared = {i for i in holds if sum(p == holds[i] for p in holds.values()) > 1}
    df = sd.repeats(frame(spark, rows))
    found = df.collect()
    assert {r["doc_id"] for r in found} == shared
    texts = dict(rows)
    for r in found:
        assert texts[r["doc_id"]][r["start"]:r["stop"]] in texts[r["keep_id"]]
        assert r["removed"] == (r["keep_id"] != r["doc_id"])
        assert r["stop"] - r["start"] > 0.5 * len(holds[r["doc_id"]])
    out = sd.without_repeats(frame(spark, rows))
    assert out.columns == frame(spark, []).columns
    cut = {}
    for i, text in rows:
        at, kept = 0, ""
        for a, b in sorted((r["start"], r["stop"]) for r in found if r["doc_id"] == i and r["removed"]):
            kept, at = kept + text[at:a], b
        cut[i] = kept + text[at:]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == cut


def test_cases(spark):
    rng = random.Random(4)
    long, own = prose(rng, 30_000), prose(rng, 80)
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, long), (6, long), (7, own + " ... " + own),
            (8, prose(rng, 90)), (8, prose(rng, 90)), (9, "é" * 5000)]
    rows.append(rows[4])
    found = sd.repeats(frame(spark, rows)).collect()
    by = {}
    for r in found:
        by.setdefault((r["doc_id"], r["removed"]), []).append((r["start"], r["stop"], r["keep_id"]))
    assert by[5, False] == [(0, len(long), 5)] and by[6, True] == [(0, len(long), 5)]
    (again,) = by[7, True]
    assert again[0] >= len(own) and again[2] == 7
    assert {i for i, _ in by} <= {5, 6, 7, 9}
    assert sd.repeats(frame(spark, [])).count() == 0
    assert sd.without_repeats(frame(spark, [])).count() == 0


def test_whole_passages_of_51_words(spark):
    rng = random.Random(5)
    vocabulary = prose(rng, 3000).split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, holds = [], {}
    for i in range(300):  # each passage stands in two documents
        p = text(51)
        for j in (2 * i, 2 * i + 1):
            a, b = text(40) + " <", "> " + text(40)
            rows.append((j, a + p + b))
            holds[j] = (len(a), len(a) + len(p))
    got = {}
    for r in sd.repeats(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["stop"], r["keep_id"], r["removed"]))
    missed = [j for j in holds if j not in got]
    assert len(missed) <= 4
    for j, spans in got.items():  # " <" and "> " stand beside every passage
        (start, stop, keep, removed) = max(spans, key=lambda s: s[1] - s[0])
        assert start <= holds[j][0] and stop >= holds[j][1]
        assert (keep, removed) == (j // 2 * 2, j % 2 == 1)
        assert stop - start <= holds[j][1] - holds[j][0] + 16


def test_seeds_grow_over_text_without_chunks(spark):
    rng = random.Random(6)
    p = prose(rng, 30)
    # no chunk ends in a run of one letter: it takes several passes
    rows = [(1, "a " + p + "x" * 3000 + "1 end"), (2, "b " + p + "x" * 3000 + "2 other")]
    (cut,) = [r for r in sd.repeats(frame(spark, rows)).collect() if r["removed"]]
    assert (cut["doc_id"], cut["start"], cut["stop"]) == (2, 1, 2 + len(p) + 3000)
    out = {r["doc_id"]: r["text"] for r in sd.without_repeats(frame(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "b2 other"}


def test_runs_of_a_long_copy_are_compared_once(spark, monkeypatch):
    rng = random.Random(7)
    whole = [prose(rng, 50)[:240] + "." for _ in range(40)]
    # every second piece of 2 and 3 is owned by 1: the runs that 3 shares with 2 have gaps, all of them the same
    other = [p if i % 2 == 0 else prose(rng, 60)[:len(p) - 1] + "!" for i, p in enumerate(whole)]
    rows = [(1, "".join(other)), (2, "".join(whole)), (3, "".join(whole)), (4, "".join(whole[:21]) + prose(rng, 20))]
    compared, cut_lineage = [], sd.cut_lineage

    def counted(df):
        out = cut_lineage(df)
        if "wanted" not in out.columns and "near" in out.columns:
            compared.append(sum(len(r["near"]) for r in out.select("near").collect()))
        return out

    monkeypatch.setattr(sd, "cut_lineage", counted)
    found = {(r["doc_id"], r["removed"]): (r["start"], r["stop"], r["keep_id"])
             for r in sd.repeats(frame(spark, rows)).collect() if r["doc_id"] > 2}
    assert found[3, True] == (0, len(rows[1][1]), 2)
    start, stop, keep = found[4, True]
    assert (start, keep) == (0, 2) and 0 <= stop - len("".join(whole[:21])) <= 2
    assert sum(compared) < 4 * sum(len(t) for _, t in rows)


def test_filter_lets_the_wanted_texts_through(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc")
    wanted = rows.where("doc % 50 = 0")
    got = {r["doc"] for r in sd._likely(rows, wanted).collect()}
    assert got >= {r["doc"] for r in wanted.collect()} and len(got) < 1000


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], "doc_id long, text string").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    seen, cut_lineage = [], sd.cut_lineage

    def counted(df):
        seen.append(int(spark.conf.get(key)) if "MapInArrow" in df._jdf.queryExecution().toString() else 0)
        return cut_lineage(df)

    before = spark.conf.get(key)
    monkeypatch.setattr(sd, "cut_lineage", counted)
    sd.repeats(rows).count()
    assert set(seen) == {0, 512} and int(before) > 512 and spark.conf.get(key) == before
