import random
import time

import pytest

from spanrules.llm import decontaminate

SF = "/root/testdata/sf0.001"


def edits(passage, text):
    """Fewest edits of ``passage`` to a stretch of ``text``, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(passage, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j - 1] + (a != b), row[j] + 1, now[-1] + 1))
        row = now
    return min(row)


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j - 1] + (x != y), row[j] + 1, now[-1] + 1))
        row = now
    return row[-1]


def mangle(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(1, len(out) - 1)
        what = rng.randrange(3)
        if what == 0:
            out[at] = rng.choice("abcxyz")
        elif what == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("abcxyz"))
    return "".join(out)


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, gone int"),
            spark.createDataFrame(items, "item_id long, text string"))


def test_matches_brute_force(spark):
    rng = random.Random(7)
    syllables = ["tha", "ren", "dis", "ou", "ple", "ka", "mor", "ti"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(50)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(4, 25)))) for i in range(8)]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(40))
        if i % 3:
            passage = rng.choice(items)[1]
            text = text[:90] + " " + mangle(rng, passage, rng.randrange(0, len(passage) // 10 + 2)) + " " + text[90:]
        docs.append((i, text))
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(*frames(spark, docs, items)).collect()}
    want = {}
    for i, text in docs:
        for j, passage in items:
            p = decontaminate.normalise(passage)
            e = edits(p, decontaminate.normalise(text))
            if e <= decontaminate.budget(len(p)):
                want[i, j] = e
    assert len(want) > 25 and len(set(want.values())) > 2
    assert got == want


def test_cases(spark):
    passage = "The quick brown fox jumps over the lazy dog by the river."
    items = [(1, passage), (2, passage), (2, passage), (3, None), (4, ""), (5, "tiny"), (6, "exactly8")]
    docs = [(1, None), (2, ""), (3, f"before {passage} after"), (4, "THE  QUICK\nbrown fox jumps over the lazy\tdog by the river."),
            (5, "tiny"), (6, "is exactly8 here"), (7, "the quick brown fox sleeps"), (3, f"before {passage} after"),
            (8, "z " * 100_000 + passage + " z" * 100_000)]
    d, b = frames(spark, docs, items)
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.contaminated(d, b).collect())
    assert got == [(3, 1, 0), (3, 1, 0), (3, 2, 0), (3, 2, 0), (4, 1, 0), (4, 2, 0), (6, 6, 0), (8, 1, 0), (8, 2, 0)]
    left = decontaminate.drop_contaminated(d, b)
    assert left.columns == d.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 5, 7]


def test_place_of_the_passage(spark):
    passage = "the quick brown fox jumps over the lazy dog by the river."
    d, b = frames(spark, [(1, "Here " + passage.replace("lazy", "lzy"))], [(1, passage)])
    r = decontaminate.contaminated(d, b).first()
    assert (r["edits"], r["start"], r["stop"]) == (1, 5, 5 + len(passage) - 1)


def test_blocks_of_the_benchmark_give_the_same_rows(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    once = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == once
    plain = {(r["doc_id"], b["item_id"]) for r in docs.collect() for b in bench.collect() if b["text"] in r["text"]}
    assert plain and plain <= {(r[0], r[1]) for r in once}


def test_alignment_finds_the_first_of_the_best(spark):
    rng = random.Random(8)
    for _ in range(60):
        passage = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 12)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 30)))
        best = min((edits_between(passage, text[a:b]), a, b) for a in range(len(text) + 1) for b in range(a, len(text) + 1))
        assert decontaminate.align([passage], [20], text) == {0: best}
        assert decontaminate.align([passage], [best[0] - 1], text) == {}


def test_passages_that_begin_alike_are_aligned_as_if_alone():
    rng = random.Random(9)
    stem = "".join(rng.choice("abcd ") for _ in range(150))
    passages = sorted(stem[:rng.choice((60, 100, 150))] + "".join(rng.choice("abcd ") for _ in range(rng.randrange(60)))
                      for _ in range(40))
    passages = sorted(passages + passages[:3] + [stem[:60], stem])
    budgets = [len(p) // rng.choice((4, 6, 12)) for p in passages]
    text = "xx" + mangle(rng, passages[7], 6) + "xx"
    alone = {}
    for i, (p, e) in enumerate(zip(passages, budgets)):
        for match in decontaminate.align([p], [e], text).values():
            alone[i] = match
            assert match[0] == edits(p, text)
        assert (i in alone) == (edits(p, text) <= e)
    assert decontaminate.align(passages, budgets, text) == alone and 5 < len(alone) < len(passages)


def test_many_passages_of_one_stem(spark):
    rng = random.Random(10)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    stem = prose(140)
    items = [(i, stem + " " + prose(130)) for i in range(4000)]
    docs = [(i, prose(20) + " " + mangle(rng, items[17 * i][1], 9) + " " + prose(20)) for i in range(3)]
    docs += [(9, stem + " and then something else " + prose(120)), (10, docs[0][1])]
    start = time.time()
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(*frames(spark, docs, items)).collect()}
    assert set(got) == {(0, 0), (1, 17), (2, 34), (10, 0)} and all(0 < e <= 9 for e in got.values())
    assert time.time() - start < 120


def test_portions_of_postings_give_the_same_rows(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    once = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "POSTINGS", 50)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == once


@pytest.mark.parametrize("docs,items", [([], [(1, "some benchmark passage")]), ([(1, "text")], [])])
def test_empty_tables(spark, docs, items):
    d, b = frames(spark, docs, items)
    assert decontaminate.contaminated(d, b).count() == 0
    assert decontaminate.drop_contaminated(d, b).count() == len(docs)
