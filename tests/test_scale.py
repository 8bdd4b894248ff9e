"""Results must not change with the size of the input, the number of cores or the number of levels."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.ranking import global_position
from quarry.operators import blocks, describe, kmeans, prepare, umap, validate
from quarry.session import cut, drop, ensure_checkpoint_dir


def test_far_small_group_gets_a_centre(spark):
    """20 rows in 200,000: a sample of a few thousand rows would mostly miss them."""
    near = spark.range(200_000).select(F.col("id").alias("row_id"), F.array(F.rand(1), F.rand(2)).alias("x"))
    far = spark.range(20).select((F.col("id") + 1_000_000).alias("row_id"), F.array(F.rand(3) + 500, F.rand(4) + 500).alias("x"))
    centres = kmeans.fit_grid(near.unionByName(far), [2], restarts=2)[2].centres
    assert sorted(np.round(centres[:, 0], -2).tolist()) == [0.0, 500.0]


def test_an_offset_costs_no_digits(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (100, 2)), rng.normal(6, 1, (100, 2))])
    out = []
    for offset in (0.0, 1e8):
        df = spark.createDataFrame([(i, [float(v) + offset for v in row], i // 100) for i, row in enumerate(x)], "row_id long, x array<double>, cluster int")
        m = validate.cluster_moments(df)
        fit = kmeans.fit_grid(df, [2], restarts=2)[2]
        out.append((validate.calinski_harabasz(m).first()[0], fit.inertia, fit.centres - offset))
    assert out[0][0] == pytest.approx(out[1][0], rel=1e-5) and out[0][1] == pytest.approx(out[1][1], rel=1e-5)
    assert np.allclose(out[0][2], out[1][2], atol=1e-5)


def test_layout_does_not_depend_on_cores(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(400, 4))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id long, x array<double>")
    found = []
    for cores, parts in ((2, 3), (64, 7)):
        monkeypatch.setattr(blocks, "parallelism", lambda s, n=cores: n)
        rows = umap.embed(df.repartition(parts), 8, rounds=2, epochs=5, block_rows=64).orderBy("row_id").collect()
        found.append(np.array([[r.d1, r.d2] for r in rows]))
    assert np.allclose(found[0], found[1], atol=1e-6)


def test_many_levels(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("a"), F.concat(F.lit("v"), (F.col("id") % 1500).cast("string")).alias("b"), "id")
    wide = describe.crosstab(df, "a", "b")
    assert len(wide.columns) == 1502 and sum(r.total for r in wide.collect()) == 3000
    assert len(prepare.fit_levels(df, ["b"])["b"]) == 1500
    assert prepare.one_hot_long(df, ["b"], ["id"]).count() == 3000


def test_rows_stay_where_they_are_for_fences(spark):
    df = spark.range(10_000).select("id", (F.col("id") % 97).cast("double").alias("v"), (F.col("id") % 5).alias("g"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (describe.box_stats(df, ["v"]), describe.box_stats(df, ["v"], ["g"]), describe.fliers(df, ["v"], "id"), describe.histogram(df, ["v"], 10)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan or "Range" not in plan.split("SortMergeJoin")[0]
            assert "hashpartitioning(variable" not in plan.split("BroadcastHashJoin")[-1]
        assert describe.box_stats(df, ["v"]).first().n == 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_without_a_label_are_left_out(spark):
    rows = [(i, [float(i), 0.0], None if i % 5 == 0 else i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, cluster int")
    known = df.where("cluster is not null")
    assert validate.silhouette(df).first() == validate.silhouette(known).first()
    assert validate.davies_bouldin(validate.cluster_moments(df)).first() == validate.davies_bouldin(validate.cluster_moments(known)).first()


def test_positions_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("v"))
        rows = global_position(df, ["v"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [r.v for r in sorted(rows, key=lambda r: r.pos)] == sorted(r.v for r in rows) and sorted(r.pos for r in rows) == list(range(3000))


def test_superseded_tables_can_be_deleted(spark):
    df = cut(spark.range(10))
    drop(df)
    with pytest.raises(Exception):  # noqa: B017
        df.count()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_many_clusters(spark):
    df = spark.range(6000).select(F.col("id").alias("row_id"), F.array((F.col("id") % 1500) * 1.0, F.rand(5)).alias("x"), (F.col("id") % 1500).cast("int").alias("cluster"))
    m = validate.cluster_moments(df)
    c = np.array([[r.centre[0], r.centre[1], r.mean_dist] for r in m.collect()])
    d = np.hypot(c[:, None, 0] - c[None, :, 0], c[:, None, 1] - c[None, :, 1])
    np.fill_diagonal(d, np.inf)
    assert validate.davies_bouldin(m).first()[0] == pytest.approx(((c[:, None, 2] + c[None, :, 2]) / d).max(axis=1).mean())
