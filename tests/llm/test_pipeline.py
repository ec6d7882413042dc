"""The stages of the pipeline on a small table, each held against brute force on its own input."""

import hashlib
import shutil

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from spanrules.llm import byte_bpe, decontaminate, quality, queries

from llm_helpers import jaccard_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The table before the first stage and after each."""
    out = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], SF).write.parquet(str(out / name))
        frames.append(spark.read.parquet(str(out / name)))
    yield frames
    shutil.rmtree(out, ignore_errors=True)


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and df.dtypes == steps[0].dtypes


def test_quality_stage(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = set(ids(steps[1]))
    before = set(ids(steps[0]))
    good = [i in kept for i in before if truth.get(i) == 1]
    bad = [i in kept for i in before if truth.get(i) == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) <= 0.35 * len(bad)
    scores = quality.with_scores(steps[0], quality.fit(steps[0], labels)).where("score >= 0.5")
    assert ids(scores) == sorted(kept)


def test_exact_dedup_stage(steps):
    last = {}
    for i, t in texts(steps[1]):
        last[t] = max(i, last.get(t, i))
    assert ids(steps[2]) == sorted(last.values())


def test_exact_dedup_stage_leaves_one_row_of_each_text(spark):
    rows = [(1, "a", 2), (1, "a", 1), (1, "a", None), (2, "b", 1), (3, "b", 2), (3, "b", 1), (None, "c", 2), (None, "c", 1),
            (None, "d", 1), (4, "d", 1), (4, "e", 1), (5, "f", 1), (5, "g", 1), (6, "", 1), (6, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = corpus_pipeline.exact_dedup_stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(
        [(1, "a"), (3, "b"), (None, "c"), (4, "d"), (4, "e"), (5, "f"), (5, "g"), (6, None)], key=repr)


def test_jaccard_stage(steps):
    want = jaccard_components(texts(steps[2]), 5, 0.8)
    assert ids(steps[3]) == sorted(i for i, c in want.items() if i == c)


def test_jaccard_stage_links_from_four_fifths(spark):
    words = [f"w{i}" for i in range(104)]
    near = words[:92] + [f"x{i}" for i in range(12)]  # 88 of 112 shingles in common: 0.79
    close = words[:95] + [f"y{i}" for i in range(9)]  # 91 of 109: 0.83
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(close)), (3, " ".join(near))],
                                 "doc_id long, text string")
    assert ids(corpus_pipeline.jaccard_stage(spark, docs, SF)) == [1, 3]


def test_decontaminate_stage(spark, steps):
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, decontaminate.normalise(t)) for i, t in texts(steps[3])]
    assert ids(steps[4]) == sorted(i for i, t in rows if not any(x in t for x in items))


def test_byte_bpe_stage(steps):
    path, pattern = queries.vocabulary_file()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    want = {}
    for i, t in texts(steps[4]):
        tokens = enc.encode_ordinary(t)
        want[i] = (len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest(),
                   hashlib.sha256(t.encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in steps[5].collect()} == want


def test_run_equals_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps[-1].collect()))


def test_stages_take_odd_tables(spark):
    cols = "doc_id long, text string, lang string, source string, n_chars long, kept int, score double, sha string"
    odd = [(1, None, None, None, None, 1, 0.5, "a"), (2, "", "en", "s", 0, None, None, None), (2, "", "en", "s", 0, 1, 1.0, "b"),
           (3, "Words of a text. " * 30_000, "en", "s", 5, 1, 1.0, "c"), (None, "No id", "en", "s", 5, 1, 1.0, "d")]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, cols)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns, name
            assert stage(spark, docs, SF).count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(names)
    assert public_tokenizers.PATTERN == queries.vocabulary_file()[1]
