import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions.quantiles import quantiles
from quarry.functions.ranking import global_position
from quarry.operators import describe, prepare, reshape

RNG = np.random.default_rng(3)


def table(spark, **cols):
    names = list(cols)
    rows = [tuple(None if v is None else (float(v) if isinstance(v, (float, np.floating)) else v) for v in r) for r in zip(*cols.values())]
    kinds = {float: "double", np.float64: "double", int: "int", str: "string"}
    first = {n: next(v for v in c if v is not None) for n, c in cols.items()}
    return spark.createDataFrame(rows, ", ".join(f"{n} {kinds[type(first[n])]}" for n in names))


@pytest.mark.parametrize("shape", ["smooth", "tied", "heavy tail"])
def test_narrowed_quantiles_equal_numpy(spark, shape):
    n = 3000
    v = {"smooth": RNG.normal(size=n), "tied": np.where(np.arange(n) % 3 > 0, 1.5, RNG.normal(size=n)), "heavy tail": RNG.pareto(0.7, size=n)}[shape]
    g = np.where(np.arange(n) % 3 == 0, "a", "b")
    df = spark.createDataFrame([(float(a), str(b)) for a, b in zip(v, g)], "v double, g string").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for by in ([], ["g"]):
        for direct in (50, 1_000_000):
            for r in quantiles(df, ["v"], probs, by, direct_rows=direct).collect():
                part = v if not by else v[g == r["g"]]
                assert r["n"] == len(part)
                assert [r[f"q{i}"] for i in range(5)] == pytest.approx(np.quantile(part, probs).tolist(), rel=1e-12)


def test_many_columns_share_their_scans(spark):
    """No row is copied per column, whatever their number, and columns with gaps, ties and nothing at all stand side by side."""
    n, names = 4000, [f"c{i}" for i in range(12)]
    m = RNG.normal(size=(n, 12))
    m[:, 1] = np.round(m[:, 1])
    m[:, 2] = 7.0
    m[RNG.random(n) < 0.4, 3] = np.nan
    m[:, 4] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in m]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    probs = [0.01, 0.25, 0.5, 0.75, 0.999]
    for direct in (100, 10_000_000):
        found = quantiles(df, names, probs, direct_rows=direct)
        assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r["variable"]: (r["n"], [r[f"q{i}"] for i in range(5)]) for r in found.collect()}
        assert sorted(got) == sorted(set(names) - {"c4"})
        for i, c in enumerate(names):
            part = m[:, i][~np.isnan(m[:, i])]
            if len(part):
                assert got[c][0] == len(part) and got[c][1] == pytest.approx(np.quantile(part, probs).tolist(), rel=1e-12)
    assert quantiles(df.limit(0), names, probs).count() == 0


def test_nulls_and_nan_are_skipped(spark, tmp_path):
    from quarry import sources

    spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 3.0)], "row_id long, v double").write.parquet(str(tmp_path / "t"))
    df = sources.read_table(spark, str(tmp_path / "t"))
    assert describe.null_report(df).collect() == [("v", 2)]
    assert tuple(describe.center_spread(df, ["v"]).first()) == ("v", 2.0, 2.0, pytest.approx(2 ** 0.5))
    assert describe.null_report(prepare.impute(df, prepare.fit_medians(df, ["v"]))).count() == 0


def test_histogram_closes_the_last_bin_and_keeps_empty_ones(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 9, 10, 10]], "v double")
    got = [r["count"] for r in describe.histogram(df, ["v"], 5).orderBy("bin").collect()]
    assert got == np.histogram([0, 0, 1, 9, 10, 10], 5)[0].tolist()
    flat = describe.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), ["v"], 4).orderBy("bin").collect()
    assert [r["count"] for r in flat] == np.histogram([2.0] * 3, 4)[0].tolist()


def test_values_on_a_fence_stay(spark):
    v = [1.0, 2, 3, 4, 5, 6, 7, 8, 13.25, 13.26, -100]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(99, None)], "row_id long, v double")
    fence = prepare.Fence(0, 0, -1.0, 13.25)
    kept = {r["row_id"] for r in prepare.drop_outliers(df, {"v": fence}).collect()}
    assert kept == {0, 1, 2, 3, 4, 5, 6, 7, 8, 99}
    assert prepare.outlier_report(df, {"v": fence}).first()["outliers"] == 2


def test_outlier_rows_are_the_union_over_columns(spark):
    a = [*RNG.normal(size=200), 50.0, 0.0, 60.0]
    b = [*RNG.normal(size=200), 0.0, 70.0, 80.0]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "row_id long, a double, b double")
    fit = prepare.fit_fences(df, ["a", "b"])
    out = np.zeros(len(a), bool)
    for c, v in (("a", np.array(a)), ("b", np.array(b))):
        q1, q3 = np.quantile(v, [0.25, 0.75])
        assert (fit[c].low, fit[c].high) == pytest.approx((q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
        out |= (v < fit[c].low) | (v > fit[c].high)
    assert prepare.outlier_report(df, fit).first()["rows_any"] == out.sum()
    assert {r["row_id"] for r in prepare.drop_outliers(df, fit).collect()} == set(np.nonzero(~out)[0].tolist())


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(3.0, "b"), (6.0, "a"), (3.0, "a"), (6.0, "b"), (None, None)], "v double, s string")
    assert prepare.fit_modes(df, ["v", "s"]) == {"v": 3.0, "s": "a"}


def test_one_hot_keeps_all_levels_and_rejects_new_ones(spark):
    df = spark.createDataFrame([(1, 3.0, 2), (2, 7.0, 1), (3, 6.0, 2)], "row_id long, thal double, cp int")
    levels = prepare.fit_levels(df, ["cp", "thal"])
    out = prepare.one_hot(df, levels, ["row_id"])
    assert out.columns == ["row_id", "cp_1", "cp_2", "thal_3.0", "thal_6.0", "thal_7.0"]
    assert [tuple(r) for r in out.orderBy("row_id").collect()] == [(1, 0, 1, 1, 0, 0), (2, 1, 0, 0, 0, 1), (3, 0, 1, 0, 1, 0)]
    new = spark.createDataFrame([(4, 3.0, 9)], "row_id long, thal double, cp int")
    with pytest.raises(Exception, match="not seen"):
        prepare.one_hot(new, levels, ["row_id"]).collect()
    assert sum(prepare.one_hot(new, levels, unseen="zeros").first()[:2]) == 0


def test_standardize_population_std_and_constant_column(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(10)], "a double, b double")
    fit = prepare.fit_scaler(df, ["a", "b"])
    z = prepare.standardize(df, fit)
    got = np.array([tuple(r) for r in z.collect()])
    assert got[:, 0] == pytest.approx((np.arange(10) - 4.5) / np.arange(10).std())
    assert (got[:, 1] == 0).all()
    back = np.array([tuple(r) for r in prepare.inverse_standardize(z, fit).collect()])
    assert back[:, 0] == pytest.approx(np.arange(10))
    assert (back[:, 1] == 5).all()


def test_pairwise_complete_correlation(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, None], [2.0, 1.0, 4.0, 3.0, 9.0]
    r = {(x["a"], x["b"]): x["r"] for x in describe.correlation(table(spark, a=a, b=b), ["a", "b"]).collect()}
    assert r[("a", "b")] == pytest.approx(np.corrcoef(a[:4], b[:4])[0, 1])
    assert r[("a", "a")] == pytest.approx(1.0)


def test_global_position(spark):
    df = spark.range(0, 1000, 1, 7).select(((F.col("id") * 7919) % 1000).alias("v"))
    got = {r["v"]: r["pos"] for r in global_position(df, ["v"]).collect()}
    assert got == {v: v for v in range(1000)}


def test_merge_records_fills_missing_metrics(spark):
    a = spark.createDataFrame([("m1", 1.0)], "model string, x double")
    b = spark.createDataFrame([("m2", 2.0)], "model string, y double")
    assert {tuple(r) for r in reshape.merge_records(a, b).collect()} == {("m1", 1.0, None), ("m2", None, 2.0)}


def test_noise_summary(spark):
    df = spark.createDataFrame([(c,) for c in [-1, -1, 0, 0, 0, 1]], "cluster int")
    assert tuple(describe.noise_summary(df).first()) == (6, 2, 2, pytest.approx(100 / 3), 1, 3)
    empty = describe.noise_summary(df.filter("cluster = -1")).first()
    assert (empty["clusters"], empty["min_size"]) == (0, None)


def test_correlation_of_many_columns(spark):
    """500 columns with gaps, an offset, one that never varies, one that is empty."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 500)) + 0.5 * rng.normal(size=(300, 1)) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7], x[:, 9] = 3.0, np.nan
    names = [f"v{i}" for i in range(500)]
    want = pd.DataFrame(x, columns=names).corr().to_numpy()
    table = pa.table({n: pa.array(x[:, i], from_pandas=True) for i, n in enumerate(names)})
    got = describe.correlation(spark.createDataFrame(table).repartition(3), names).toPandas()
    have = np.full((500, 500), np.nan)
    have[got.pos_a, got.pos_b] = got.r
    want[7, 7] = np.nan
    assert len(got) == 250000 and (got.a == got.pos_a.map(lambda i: f"v{i}")).all()
    assert np.allclose(have, want, atol=1e-9, equal_nan=True)
