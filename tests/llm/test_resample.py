import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import resample
from quarry.llm.common import documents


def test_models_and_weights(spark):
    """Buckets against counts of the words themselves, where no two fall together."""
    rows = [(1, "good words here."), (2, "Good words there"), (3, "bad stuff!! bad"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (None, 1)], "doc_id long, quality int")

    def bag(t):
        w = re.findall(r"[a-z0-9]+|[^\sa-z0-9]+", t.lower())
        return Counter([*w, *zip(w, w[1:])])

    raw, target = sum((bag(t or "") for _, t in rows), Counter()), bag(rows[0][1]) + bag(rows[1][1])
    assert len(set(resample.grams(pa.array([" ".join(t or "" for _, t in rows)]))[0].tolist())) >= len(raw)
    size = 1 << resample.BUCKET_BITS
    ratio = lambda g: math.log((target[g] + 1) / (target.total() + size)) - math.log((raw[g] + 1) / (raw.total() + size))
    got = {r.doc_id: r.log_weight for r in resample.weights(docs, resample.log_ratios(docs, labels)).collect()}
    for i, t in rows[:3]:
        assert abs(got[i] - sum(n * ratio(g) for g, n in bag(t).items())) < 1e-9
    assert got[4] == got[5] == resample.NOTHING


def test_largest(spark):
    values = np.random.default_rng(3).integers(0, 400, 5000) / 7.0
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(9000 + i, -1e12) for i in range(500)], "doc_id long, key double")
    order = sorted(((-r.key, r.doc_id) for r in df.collect()))
    for k in (0, 1, 17, 2500, 4999, 5100, 5499, 5500, 9999):
        assert sorted((-r.key, r.doc_id) for r in resample.largest(df, k).collect()) == order[:k]


def test_draw_prefers_good_documents(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    drawn = resample.draw(docs, labels)
    assert drawn.count() == round(resample.good_share(labels) * docs.count())
    share = {r.quality: r.s for r in labels.join(drawn.select("doc_id", F.lit(1.0).alias("d")), "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("d", F.lit(0.0))).alias("s")).collect()}
    assert share[1] > 0.95 and share[0] < 0.1


def test_gumbel_noise_draws_in_proportion(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    keys = resample.weights(docs, np.zeros(1 << resample.BUCKET_BITS)).toPandas()["key"]
    assert abs(keys.mean() - 0.5772) < 0.05 and abs(keys.std() - 1.2825) < 0.05


def test_edge_cases(spark, edge, none):
    labels = spark.createDataFrame([(4, 1), (None, None), (5, 0)], "doc_id long, quality int")
    assert resample.draw(edge, labels, 3).count() == 3
    words = edge.where("trim(text) <> ''").count() - 1
    assert resample.draw(edge, labels, words).where("n_grams = 0").count() == 0
    assert resample.draw(none, labels).count() == 0
    assert resample.draw(edge, labels.limit(0)).count() == 0 and resample.draw(edge, labels.limit(0), 4).count() == 4
