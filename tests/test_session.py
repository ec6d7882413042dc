"""Session helpers: lineage cuts into the shared folder, JVM-side literal frames."""

from spanrules.functions.columns import literal_frame
from spanrules.session import checkpoint_dir, cut_lineage


def test_checkpoint_dir_is_set(spark):
    assert checkpoint_dir(spark)


def test_cut_lineage_parquet_roundtrip(spark):
    df = literal_frame(spark, [(1, [1.0, 2.0]), (2, [])], "k int, v array<double>")
    cut = cut_lineage(df)
    assert sorted((r.k, list(r.v)) for r in cut.collect()) == [(1, [1.0, 2.0]), (2, [])]


def test_cut_lineage_names_parquet_cannot_store(spark):
    df = spark.range(3).withColumnRenamed("id", "a b,c")
    cut = cut_lineage(df)
    assert sorted(r[0] for r in cut.collect()) == [0, 1, 2]


def test_literal_frame_empty(spark):
    df = literal_frame(spark, [], "j int, i int")
    assert df.count() == 0 and df.columns == ["j", "i"]
