import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.llm import exact
from quarry.llm.common import documents


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    out = []
    for t, ids in groups.items():
        keep, first = min((i for i in ids if i is not None), default=None), True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=str)


def naive(docs, capacity):
    """(depth, prefix) of the buckets that hold keys, split one by one."""
    keys, out = [r.key & (1 << 64) - 1 for r in exact.keyed(docs).select("key").distinct().collect()], []

    def split(own, depth, prefix):
        if len(own) <= capacity:
            return out.append((depth, prefix)) if own else None
        for bit in (0, 1):
            split([k for k in own if k >> 63 - depth & 1 == bit], depth + 1, prefix << 1 | bit)

    split(keys, 0, 0)
    return sorted(out)


def test_directory_of_crowded_keys(spark, monkeypatch):
    """Keys that share long prefixes: buckets of many depths, several looks, joined and broadcast alike."""
    monkeypatch.setattr(exact, "key_of", lambda norm: F.when(F.xxhash64(norm) % 3 == 0, F.shiftrightunsigned(F.xxhash64(norm), 50)).otherwise(F.xxhash64(norm)))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), (F.col("id") % 2500).cast("string")).alias("text"))
    buckets = exact.directory(exact.keyed(docs).select("key").distinct(), 20)
    assert sorted((r.depth, r.prefix) for r in buckets.table.collect()) == naive(docs, 20) and max(buckets.levels) > 50 and len(buckets.others) > 3
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for few in (1 << 20, 0):
        monkeypatch.setattr(exact, "FEW", few)
        assert sorted(map(tuple, exact.decide(docs, capacity=20).collect()), key=str) == brute(rows)


def test_edge_cases(spark, edge, none):
    rows = [(r.doc_id, r.text or "") for r in edge.collect()]
    assert sorted(map(tuple, exact.decide(edge).collect()), key=str) == brute(rows)
    assert exact.decide(none).count() == 0
    assert exact.keep_rows(none).columns == none.columns
    kept = exact.keep_rows(edge)
    assert kept.columns == edge.columns and kept.count() == len({re.sub(r"\s+", " ", t) for _, t in rows})


def test_documents_and_split_buckets(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert sorted(map(tuple, exact.decide(docs).collect()), key=str) == brute(rows)
    assert sorted(map(tuple, exact.decide(docs, capacity=5).collect()), key=str) == brute(rows)
    index, buckets = exact.build(docs, capacity=5)
    assert sum(buckets.levels.values()) > 32 and max(buckets.levels) > 5 and buckets.table.count() == sum(buckets.levels.values())
    sizes = exact.with_bucket(index.drop("bucket"), buckets).groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 5 and len(sizes) == buckets.table.count()
    assert sorted((r.depth, r.prefix) for r in buckets.table.collect()) == naive(docs, 5)
    asked = docs.where("doc_id < 9").select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit("")).alias("text"))
    assert exact.lookup(index, buckets, asked).where("keep_id is null").count() == 0
    assert exact.lookup(index, buckets, asked.withColumn("text", F.concat("text", F.lit("?")))).where("keep_id is not null").count() == 0


def test_one_hot_text(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same  text").otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"))
    got = exact.decide(docs)
    assert got.where("group_size = 1667").count() == 1667 and got.where("kept").count() == 5000 - 1666
    assert exact.keep_rows(docs.union(docs)).count() == 5000 - 1666


def test_buckets_route_and_decide(spark, monkeypatch):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), (F.col("id") % 15000).cast("string")).alias("text")).repartition(6)
    index, buckets = exact.build(docs)
    assert buckets.table.count() >= 4  # at the capacity of the query
    files = index.withColumn("file", F.input_file_name()).groupBy("bucket").agg(F.countDistinct("file").alias("n"), F.count(F.lit(1)).alias("size")).collect()
    assert len(files) > 3 and all(r.n == 1 and r.size <= exact.CAPACITY for r in files)
    # Chains: 15,000 texts under 100 keys.
    monkeypatch.setattr(exact, "key_of", lambda norm: F.xxhash64(F.substring(norm, -2, 2)))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, exact.decide(docs, capacity=5).collect()), key=str) == brute(rows)
    # A row whose directory leads elsewhere finds no entry.
    other = exact.Directory(buckets.table, {buckets.usual + 1: 1})
    asked = docs.limit(50)
    assert exact.lookup(index, other, asked).where("keep_id is not null").count() == 0


def test_clashing_names_and_maps(spark):
    """Columns with the names used inside, one that cannot be ordered, NULL and repeated ids, two texts under one id."""
    names = "_keep _keep_key _keep_sha _key _sha _id _row row id hash class root bucket".split()
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (None, "seven eight nine ten eleven"), (None, "a b c d e f g"), (4, "x y z w v u"), (4, "p q r s t u"), (4, "p q r s t u"), (5, None)]
    docs = spark.createDataFrame([(i, t, *range(len(names)), {"a": 1}) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names) + ", m map<string,int>")
    got = exact.keep_rows(docs)
    assert got.columns == docs.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted({(i, t) for i, t in rows if i != 2}, key=str)
    assert exact.keep_rows(docs.where("doc_id is not null and doc_id <> 4")).count() == 2
