import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanrules.llm import quality

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    learn, held = labels.where("pmod(doc_id, 5) <> 0"), labels.where("pmod(doc_id, 5) = 0")
    scored = quality.with_scores(docs, quality.fit(docs, learn, max_labelled=2000, max_pool=1500))
    rows = scored.join(held, "doc_id").select("quality", "score").collect()
    assert len(rows) > 300
    good = [r["score"] >= quality.THRESHOLD for r in rows if r["quality"] == 1]
    bad = [r["score"] < quality.THRESHOLD for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_keeps_columns_and_odd_rows(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels, max_labelled=800, max_pool=300)
    odd = spark.createDataFrame(
        [(1, None, None, None, None, 1.0, "p"), (2, "", "en", "src1", 0, 2.0, "q"), (2, "", "en", "src1", 0, 2.0, "q"),
         (3, "x" * 300_000, "zz", "new", 5, 3.0, "r"), (None, "Plain words of a text.", "en", "src2", 22, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long, score double, c0 string")
    out = quality.with_scores(odd, model, "score2")
    assert out.columns == [*odd.columns, "score2"]
    rows = out.collect()
    assert sorted(map(str, (tuple(r)[:-1] for r in rows))) == sorted(map(str, map(tuple, odd.collect())))
    assert all(0 <= r["score2"] <= 1 for r in rows)
    assert quality.with_scores(odd.limit(0), model, "s").count() == 0


def test_nothing_to_learn_keeps_everything(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 0), (None, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        out = quality.keep_good(docs, known)
        assert out.columns == docs.columns and out.count() == 2


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 1040).astype(float)
    views = tuple((2 * y - 1)[:, None] * s + rng.normal(size=(1040, 6)) for s in (1.2, 0.9))
    labelled, pool, test = slice(0, 40), slice(40, 740), slice(740, None)
    held = np.arange(40) % 4 == 0
    model = quality.co_train(tuple(v[labelled] for v in views), y[labelled], held, tuple(v[pool] for v in views))
    p = model.score(tuple(v[test] for v in views))
    assert np.mean((p > 0.5) == y[test]) > 0.97
    assert quality.co_train(tuple(v[:4] for v in views), np.ones(4), held[:4], tuple(v[pool] for v in views)) is None


def test_of_rows_that_repeat_an_id_the_least_teaches(spark, tables):
    docs, labels = tables
    docs = docs.select("doc_id", "text", "lang", "source").where("text IS NOT NULL")
    other = docs.select("doc_id", (F.concat(F.lit("\U0010ffff"), F.reverse("text"))).alias("text"), "lang", "source")
    once = quality.fit(docs, labels, max_labelled=300, max_pool=100)
    for both in (docs.unionByName(other).unionByName(docs), other.unionByName(docs).repartition(5)):
        model = quality.fit(both, labels, max_labelled=300, max_pool=100)
        a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in quality.with_scores(docs, m).collect())
                for m in (once, model))
        assert a == b


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["one text", "", None, "zwei Texte", "q", "ещё один"]
    together = quality.content_features(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert (quality.content_features(pa.array([text], pa.string()))[0] == together[i]).all()
    names = ["en", None, "de", "de", "x", "ru"]
    together = quality.metadata_features(pa.array(texts, pa.string()), names, names)
    for i, text in enumerate(texts):
        assert (quality.metadata_features(pa.array([text], pa.string()), names[i:i + 1], names[i:i + 1])[0] == together[i]).all()
