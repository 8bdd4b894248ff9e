import re
from collections import defaultdict

import pandas as pd
import pytest

import corpus_pipeline
from quarry.llm import toxicity
from quarry.session import cut
from tests.llm.test_near import brute as near_brute

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    given, expected = {r.doc_id: r.text for r in docs.collect()}, None
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, SF))
        if name == "toxicity":
            score = toxicity.fit(docs, labels).score(pd.Series(list(given.values())))
            expected = {i for i, s in zip(given, score) if s < 0.5}
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for i, t in given.items():
                groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
            expected = {min(ids) for ids in groups.values()}
        elif name == "near_dedup":
            expected = {i for i, _, c in near_brute([(i, t or "") for i, t in given.items()]) if i == c}
        elif name == "decontamination":
            flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
            leaked = {i for i, t in given.items() if any(flat(x) in flat(t) for x in items)}
            assert not leaked & {r.doc_id for r in out.collect()} and out.count() >= len(given) - 2 * len(leaked) - 3
            expected = None
        else:
            rows = out.collect()
            assert {r.doc_id for r in rows} == set(given)
            by = defaultdict(list)
            for r in rows:
                by[r.sequence_id].append((r.offset, r.length))
            assert all(sum(n for _, n in v) <= 4096 for v in by.values()) and len(by) <= -(-sum(r.length for r in rows) // 4096) + 2
            continue
        assert out.columns == docs.columns
        docs, given = out, {r.doc_id: r.text for r in out.collect()}
        assert expected is None or set(given) == expected, name


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100


def _strange(spark):
    """Names used inside the stages, a column that cannot be ordered, NULL and repeated ids, two texts under one id."""
    names = "_keep _key _keep_key _keep_sha _sha _id _row row id hash class root bucket piece start length offset".split()
    text = "one two three four five six seven eight"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, "nine ten eleven twelve thirteen fourteen"), (3, None), (4, ""), (5, "alpha beta gamma delta epsilon zeta eta"), (5, "quite another text under one id")]
    return spark.createDataFrame([(i, t, "en", "s", 1, *range(len(names)), {"a": 1}) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names) + ", m map<string,int>")


@pytest.mark.parametrize("empty", [False, True])
def test_all_stages_on_strange_tables(spark, tmp_path, empty):
    docs = _strange(spark)
    docs = docs.limit(0) if empty else docs
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (2, 0), (None, 1), (5, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "Alpha beta gamma delta, epsilon zeta eta"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = [9, 5, 5, 4]
    for (name, stage), n in zip(corpus_pipeline.STAGES[:-1], left):
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns and kept.count() == (0 if empty else n), name
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.count() == (0 if empty else 4)
