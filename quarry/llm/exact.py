"""Exact copies by an extendible-hash index on shared files, in DataFrame operations only.

Every row has a 64-bit key, a hash of its text. A directory maps the leading bits of a key to a bucket. It starts with one
bucket and doubles as long as a bucket holds more keys than its capacity, so only overfull buckets get longer prefixes. Rows
go to the task of their bucket, copies summed beforehand in shares of the tasks. There the texts of one key form a chain that
is told apart by bytes: each text of the chain becomes an index entry with its SHA-256, the row that stays and the number of
rows. Rows look up their entry by bucket, key and SHA-256.

Texts are equal when identical after every run of white space (space, tab to carriage return) became one space. NULL
text counts as empty. Rows with equal text and equal doc_id are copies like others: one of them stays. A NULL doc_id
stays only if no row of its text has one. Other columns are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, one_of_each, unused
from quarry.session import cut

#: Keys a bucket may hold before it is split: some tens of MB of texts.
CAPACITY = 1 << 12
#: Rows that one text sends to its bucket at most; each sums the copies of a share of the tasks.
SHARES = 16
#: Bits added to prefixes per look at the counts of buckets that are still overfull after the first look.
STEP = 8
#: Buckets of unusual depth that are broadcast at most, some tens of MB; more are joined like any table.
FEW = 1 << 20


@dataclass
class Directory:
    """The buckets that hold keys, as a written table (depth, prefix), and how many there are of each depth.

    Most buckets have the same depth, the ``usual`` one: theirs follows from the key alone. Only the others are looked up.
    """

    table: DataFrame
    levels: dict[int, int]

    @property
    def usual(self) -> int:
        return max(self.levels, key=lambda d: (self.levels[d], d), default=0)

    @property
    def others(self) -> list[int]:
        return sorted(set(self.levels) - {self.usual})


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def key_of(norm: Column) -> Column:
    return F.xxhash64(norm)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, norm)."""
    norm = id_and_text(docs).select("doc_id", normalised(F.col("text")).alias("norm"))
    return norm.select("doc_id", key_of(F.col("norm")).alias("key"), "norm")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text_sha256)."""
    return _texts(docs).select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256"))


def entries(docs: DataFrame, buckets: Directory) -> DataFrame:
    """(bucket, key, text_sha256, keep_id, group_size): rows are routed by bucket, and the chain of each key is told apart by
    bytes in the bucket's task. Copies are summed within tasks and shares of tasks before, however many there are."""
    sums = [F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")]
    rows = with_bucket(_texts(docs), buckets).select("bucket", "key", "norm", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), (F.spark_partition_id() % SHARES).alias("share"))
    shared = rows.groupBy("bucket", "key", "norm", "share").agg(*sums).drop("share")
    chains = shared.repartition("bucket").groupBy("bucket", "key", "norm").agg(*sums)
    return chains.select("bucket", "key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned(F.col("key"), 64 - depth) if depth else F.lit(0).cast("long")


def _first(depth: int) -> Column:
    """The first key of the bucket, in unsigned order moved to signed."""
    return F.shiftleft(_prefix(depth), 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> Directory:
    """The shortest prefixes whose buckets hold at most ``capacity`` of the (distinct) keys.

    Counts by prefix stay in tables; the driver sees one number per depth. A chain of texts with one key is never split.
    """
    n, leaves, depth, full = keys.count(), None, 0, None
    if n <= capacity:
        return Directory(keys.sparkSession.range(1).select(F.lit(0).alias("depth"), F.col("id").alias("prefix")), {0: 1})
    deeper = min(64, (n // capacity).bit_length() + 1)
    while full is None or depth < 64 and not full.isEmpty():
        rows = keys if full is None else keys.join(full, _prefix(depth) == F.col("above"), "left_semi")
        counts = rows.groupBy(_prefix(deeper).alias("deep")).agg(F.count(F.lit(1)).alias("n"))
        # Doubling: an overfull bucket of a level becomes two of the next.
        every = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned("deep", deeper - d).alias("prefix")) for d in range(depth + 1, deeper + 1)]))
        sizes = cut(counts.select(every.alias("b"), "n").groupBy("b.depth", "b.prefix").agg(F.sum("n").alias("n")))
        over = (F.col("n") > capacity) & (F.col("depth") < 64)
        halved = sizes.where(over).select((F.col("depth") + 1).alias("below"), F.col("prefix").alias("parent"))
        fits = sizes.where(~over)
        deep = fits.join(halved, (F.col("depth") == F.col("below")) & (F.shiftrightunsigned("prefix", 1) == F.col("parent")), "left_semi")
        found = cut(fits.where(F.col("depth") == depth + 1).unionByName(deep).select("depth", "prefix"))
        leaves = found if leaves is None else leaves.unionByName(found)
        full = sizes.where(over & (F.col("depth") == deeper)).select(F.col("prefix").alias("above"))
        depth, deeper = deeper, min(deeper + STEP, 64)
    return Directory(leaves, {r["depth"]: r["count"] for r in leaves.groupBy("depth").count().collect()})


def with_bucket(rows: DataFrame, buckets: Directory) -> DataFrame:
    """Adds ``bucket``: the first key of the bucket's range, in unsigned order moved to signed."""
    bucket, columns = _first(buckets.usual), rows.columns
    for depth in buckets.others:
        here = buckets.table.where(F.col("depth") == depth).select(F.col("prefix").alias(f"_prefix{depth}"))
        here = F.broadcast(here) if sum(buckets.levels[d] for d in buckets.others) <= FEW else here
        rows = rows.join(here, _prefix(depth) == F.col(f"_prefix{depth}"), "left")
        bucket = F.when(F.col(f"_prefix{depth}").isNotNull(), _first(depth)).otherwise(bucket)
    return rows.select(*columns, bucket.alias("bucket"))


def build(docs: DataFrame, capacity: int = CAPACITY, rows: DataFrame | None = None) -> tuple[DataFrame, Directory]:
    """The index as a table in the shared folder, each bucket in one file and sorted by key, and its directory. ``rows`` are
    those of :func:`keyed`, where they are written already."""
    buckets = directory(cut((_texts(docs) if rows is None else rows).select("key").distinct()), capacity)
    return cut(entries(docs, buckets).sortWithinPartitions("bucket", "key", "text_sha256")), buckets


def decide(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``; copies of a (doc_id, text) pair keep one."""
    rows = cut(keyed(docs))
    index, buckets = build(docs, capacity, rows)
    pairs = with_bucket(rows, buckets).groupBy("bucket", "key", "text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    return _decided(pairs, index)


def _decided(pairs: DataFrame, index: DataFrame) -> DataFrame:
    rows = pairs.join(index, ["bucket", "key", "text_sha256"])
    rows = rows.select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def keep_rows(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names and types."""
    decisions = cut(decide(docs, capacity))
    id_, sha_ = unused("_keep", docs.columns), unused("_keep_sha", docs.columns)
    kept = decisions.where("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha_))
    dropped = decisions.where("not kept")
    # Where one id stands for both a row that stays and one that goes, the id alone does not tell them apart.
    mixed = dropped.select("doc_id").intersect(kept.select(F.col(id_).alias("doc_id"))).limit(1).count() > 0 or decisions.where("doc_id is null").limit(1).count() > 0
    if not mixed:
        return docs.join(kept.select(id_), docs["doc_id"].cast("long") == F.col(id_), "left_semi")
    sha = F.sha2(normalised(docs["text"].cast("string")), 256)
    rows = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (sha == F.col(sha_)), "left_semi")
    return one_of_each(rows, sha)


def lookup(index: DataFrame, buckets: Directory, texts: DataFrame) -> DataFrame:
    """Rows of ``texts`` (doc_id, text) with the keep_id and group_size of the index entry with equal text, NULL without."""
    asked = with_bucket(keyed(texts), buckets)
    return asked.join(index.select("bucket", "key", "text_sha256", "keep_id", "group_size"), ["bucket", "key", "text_sha256"], "left").select("doc_id", "keep_id", "group_size", "text_sha256")
