import itertools
import zlib

import numpy as np
import pytest

from spanrules.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_columns(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = queries.op10_langid(spark, SF)
    assert df.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = df.collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


TRAIN = [(1, "the cat and the dog sat on the mat with the other cats " * 3, "en"),
         (2, "der hund und die katze liegen auf der alten matte im haus " * 3, "de"),
         (3, "кошка и собака сидели на старом ковре в большом доме " * 3, "ru"),
         (4, "ignored", None), (5, None, "en"), (None, "zzz zzz", "xx")]


@pytest.fixture(scope="module")
def model(spark):
    return langid.learn(spark.createDataFrame(TRAIN, "doc_id long, text string, lang string"))


def test_spans_of_mixed_text(spark, model):
    assert model["langs"] == ["de", "en", "ru"]
    english, german, russian = "the cat and the dog sat on the mat with the cats", \
        "der hund und die katze liegen auf der matte", "собака сидели на ковре"
    text = f"{english}. {german}! {russian}"
    docs = spark.createDataFrame([(1, text, 7, 8.0), (2, None, 7, 8.0), (3, "", 7, 8.0), (4, "123 !?", 7, 8.0),
                                  (5, "собака", 7, 8.0), (6, "漢字", 7, 8.0), (7, "cat " * 60_000, 7, 8.0)],
                                 "doc_id long, text string, spans int, score double")
    got = {r["doc_id"]: r for r in langid.label_spans(docs, model).collect()}
    spans = [(s["lang"], text[s["start"]:s["stop"]]) for s in got[1]["spans"]]
    assert spans == [("en", english), ("de", german), ("ru", russian)]
    assert got[1]["lang_pred"] == "en" and 0 < got[1]["score"] < 1
    for i in (2, 3, 4):
        assert (got[i]["spans"], got[i]["lang_pred"], got[i]["score"]) == ([], "und", 0.0)
    assert (got[5]["lang_pred"], got[5]["score"]) == ("ru", 1.0)
    assert got[6]["lang_pred"] == "de"  # no language speaks for it: the first
    assert got[7]["lang_pred"] == "en" and len(got[7]["spans"]) == 1


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([4, 0, 6, 1, 5])
    score = rng.normal(size=(sizes.sum(), 3)) * 3
    path = langid.viterbi(score, sizes, 2.0)
    at = 0
    for n in sizes:
        own = score[at:at + n]

        def value(states):
            return sum(own[i][s] for i, s in enumerate(states)) - 2.0 * sum(a != b for a, b in zip(states, states[1:]))

        best = max((value(s) for s in itertools.product(range(3), repeat=n)), default=0)
        assert value(tuple(path[at:at + n])) == pytest.approx(best)
        at += n


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.learn(docs) is None
    r = langid.label_spans(docs, None).first()
    assert (r["spans"], r["lang_pred"], r["score"]) == ([], "und", 0.0)
    assert langid.label_spans(docs.limit(0), None).count() == 0
    assert langid.learn(docs.limit(0)) is None
