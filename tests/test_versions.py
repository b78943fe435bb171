import pytest
from pyspark.sql import functions as F

from quillgraph.sources import versions

KIND = "id long, name string, parts array<int>"


def rows(df):
    return sorted((r.id, r.name, r.parts) for r in df.collect())


def test_versions_and_an_empty_one(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    assert versions.current(at) is None and versions.load(spark, at, KIND).count() == 0
    df = spark.createDataFrame([(i, f"n{i} é\n\"x\"", [i, i + 1]) for i in range(50)] + [(99, None, None)], KIND).repartition(4)
    first = versions.save(df, at)
    assert rows(versions.load(spark, at, KIND)) == rows(df)
    second = versions.save(versions.load(spark, at, KIND).where("id < 10"), at)  # read and rewritten at once
    assert versions.load(spark, at, KIND).count() == 10 and versions.load(spark, at, KIND, first).count() == 51 and first != second
    versions.save(df.where("id < 0"), at)
    assert versions.load(spark, at, KIND).count() == 0 and versions.load(spark, at, KIND, second).count() == 10


def test_a_task_killed_midway_leaves_the_old_version(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    df = spark.range(1000).select("id", F.lit("a").alias("name"), F.array(F.lit(1)).alias("parts")).repartition(4)
    old = versions.save(df, at)
    dies = df.withColumn("name", F.when(F.col("id") == 777, F.raise_error(F.lit("the task is lost"))).otherwise(F.lit("b")))
    with pytest.raises(Exception):
        versions.save(dies, at)
    assert versions.current(at) == old and rows(versions.load(spark, at, KIND)) == rows(df)
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == sorted(["CURRENT", old])  # nothing of the lost one stays
    versions.save(df.withColumn("name", F.lit("b")), at)
    assert {r.name for r in versions.load(spark, at, KIND).collect()} == {"b"}


def test_files_by_key(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(i, k, [i]) for i, k in enumerate(["a/b", "a/b", "c d", "", None, "_x", ".y", "hot"] + ["hot"] * 200)], KIND)
    versions.save(df, at, "name")
    names = [f.rsplit("/", 1)[1] for f in versions.listed(at)]
    assert sorted(names) == sorted(["a%2Fb.json", "c%20d.json", "%00.json", "%5Fx.json", "%2Ey.json", "hot.json"])
    assert versions.load(spark, at, KIND).count() == df.count()
    assert rows(spark.read.schema(KIND).json([f for f in versions.listed(at) if f.endswith("hot.json")])) == rows(df.where("name = 'hot'"))
