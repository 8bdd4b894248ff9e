"""DuckDB SQL twins of the registered queries."""
from __future__ import annotations

from quarry.plans.features import LOW, OTHER

RFM = """rfm AS (
  SELECT o.row_id, n_orders, total, avg_price, recency, c_acctbal, c_mktsegment FROM (
    SELECT o_custkey AS row_id, count(*)::DOUBLE AS n_orders, sum(o_totalprice) AS total, avg(o_totalprice) AS avg_price,
           date_diff('day', max(o_orderdate)::DATE, DATE '2002-01-01')::DOUBLE AS recency
    FROM orders GROUP BY 1) o JOIN (SELECT c_custkey AS row_id, c_acctbal, c_mktsegment FROM customer) c USING (row_id))"""
GAPS = """gaps AS (
  SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN value END AS value,
         CASE WHEN event_id % 23 <> 0 THEN event_type END AS event_type FROM events)"""


def _emb(rules) -> str:
    """Embeddings with a linear projection of all coordinates (64 in the given tables) by rules for the weights."""
    low = ", ".join(f"list_dot_product(embedding::DOUBLE[], {[rule(i) for i in range(64)]}::DOUBLE[])" for rule in rules)
    return f"e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, [{low}] AS y, label AS cluster FROM embeddings)"


EMB = _emb(LOW)
DIST = f"{EMB}, d AS (SELECT a.id AS i, b.id AS j, a.cluster AS ci, b.cluster AS cj, list_distance(a.x, b.x) AS dh, list_distance(a.y, b.y) AS dl FROM e a JOIN e b ON a.id <> b.id)"
SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
CONT = ["n_orders", "total", "avg_price", "recency", "c_acctbal"]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _summary(t: str, cols) -> str:
    q = lambda c, p: f"round(quantile_cont({c}, {p}), 2)"
    return _union(
        f"SELECT '{c}' AS variable, count({c}) AS count, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, round(min({c}), 2) AS min, "
        f"{q(c, 0.25)} AS q25, {q(c, 0.5)} AS q50, {q(c, 0.75)} AS q75, round(max({c}), 2) AS max FROM {t}" for c in cols)


def _box(source: str, keys: str) -> str:
    """``source``: CTEs ending in ``v(keys, value)``."""
    return f"""WITH {source},
    q AS (SELECT {keys}, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM v WHERE value IS NOT NULL GROUP BY ALL),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)
    SELECT {keys}, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(low, 6) AS low, round(high, 6) AS high,
      round(min(value) FILTER (value >= low AND value <= high), 6) AS whisker_low, round(max(value) FILTER (value >= low AND value <= high), 6) AS whisker_high,
      count(*) FILTER (value < low OR value > high) AS fliers
    FROM v JOIN f USING ({keys}) WHERE value IS NOT NULL GROUP BY {keys}, n, q1, median, q3, low, high"""


def _long(t: str, cols, ids: str = "") -> str:
    return _union(f"SELECT {ids}'{c}' AS variable, {c}::DOUBLE AS value FROM {t}" for c in cols)


FENCE = """qf AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
  g AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM qf)"""


def _zscore(cols) -> str:
    return ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in cols)


def _rounded(cols, n=6) -> str:
    return ", ".join(f"round({c}, {n}) AS {c}" for c in cols)


CORR = f"WITH {RFM}" + " " + _union(
    f"SELECT '{a}' AS a, '{b}' AS b, {i} AS pos_a, {j} AS pos_b, round(corr({a}, {b}), 6) AS r FROM rfm" for i, a in enumerate(CONT) for j, b in enumerate(CONT))

PCA2 = f"""WITH {RFM}, s AS (SELECT var_samp(recency) AS a, covar_samp(recency, n_orders) AS b, var_samp(n_orders) AS c, avg(recency) AS m1, avg(n_orders) AS m2 FROM rfm),
  ev AS (SELECT *, (a + c + sqrt((a - c) ^ 2 + 4 * b * b)) / 2 AS l1, (a + c - sqrt((a - c) ^ 2 + 4 * b * b)) / 2 AS l2 FROM s),
  u AS (SELECT *, b / sqrt(b * b + (l1 - a) ^ 2) AS v11, (l1 - a) / sqrt(b * b + (l1 - a) ^ 2) AS v12, b / sqrt(b * b + (l2 - a) ^ 2) AS v21, (l2 - a) / sqrt(b * b + (l2 - a) ^ 2) AS v22 FROM ev),
  w AS (SELECT *, CASE WHEN abs(v11) >= abs(v12) THEN sign(v11) ELSE sign(v12) END AS s1, CASE WHEN abs(v21) >= abs(v22) THEN sign(v21) ELSE sign(v22) END AS s2 FROM u),
  p AS (SELECT l1, l2, m1, m2, v11 * s1 AS p11, v12 * s1 AS p12, v21 * s2 AS p21, v22 * s2 AS p22 FROM w)"""

CENTRES = f"""{RFM}, z AS (SELECT row_id, {_zscore(CONT)} FROM rfm), z2 AS (SELECT row_id, n_orders AS a, recency AS b FROM z),
  c0 AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS cluster, a AS ca, b AS cb FROM z2 WHERE row_id <= 4)"""


def _lloyd(src: str, out: str) -> str:
    return f"""{out}_as AS (SELECT row_id, a, b, arg_min(cluster, ((a - ca) * (a - ca) + (b - cb) * (b - cb), cluster)) AS cluster FROM z2 JOIN {src} ON true GROUP BY ALL),
  {out} AS (SELECT cluster, avg(a) AS ca, avg(b) AS cb, count(*) AS n FROM {out}_as GROUP BY 1)"""


SIL = f"""{DIST}, n AS (SELECT cluster, count(*) AS n FROM e GROUP BY 1),
  s AS (SELECT i, ci, cj, sum(dh) AS s FROM d GROUP BY ALL),
  m AS (SELECT i, ci, max(CASE WHEN cj = ci THEN s / (n.n - 1) END) AS a, min(CASE WHEN cj <> ci THEN s / n.n END) AS b FROM s JOIN n ON n.cluster = s.cj GROUP BY ALL),
  sil AS (SELECT i AS row_id, ci AS cluster, (b - a) / greatest(a, b) AS silhouette FROM m)"""
MOM = f"""{EMB}, long AS (SELECT cluster, id, unnest(x) AS v, unnest(range(1, 65)) AS t FROM e), cen AS (SELECT cluster, t, avg(v) AS c FROM long GROUP BY ALL),
  pd AS (SELECT l.cluster, id, sum((v - c) ^ 2) AS d2 FROM long l JOIN cen USING (cluster, t) GROUP BY ALL),
  sp AS (SELECT cluster, avg(sqrt(d2)) AS s, sum(d2) AS w, count(*) AS n FROM pd GROUP BY 1)"""


def _trust(edge: str, far: str, name: str) -> str:
    return f"""WITH {DIST}, near AS (SELECT i, j, {far} AS t FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY {edge}, j) <= 5),
      rk AS (SELECT near.i, near.j, 1 + count(*) FILTER (d.{far} < t) AS rank FROM near JOIN d ON d.i = near.i GROUP BY ALL), n AS (SELECT count(*)::DOUBLE AS n FROM e)
      SELECT round(1 - 2 / (any_value(n) * 5 * (2 * any_value(n) - 16)) * sum(greatest(rank - 5, 0)), 6) AS {name} FROM rk, n"""


JACC = f"""nh AS (SELECT i, list(j) AS h FROM (SELECT i, j FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY dh, j) <= 10) GROUP BY 1),
  nl AS (SELECT i, list(j) AS l FROM (SELECT i, j FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY dl, j) <= 10) GROUP BY 1)"""
SPEAR = """pr AS (SELECT dh, dl FROM d WHERE i < j),
  rr AS (SELECT rank() OVER (ORDER BY dh) + (count(*) OVER (PARTITION BY dh) - 1) / 2.0 AS rh, rank() OVER (ORDER BY dl) + (count(*) OVER (PARTITION BY dl) - 1) / 2.0 AS rl FROM pr)"""


def _agree(source: str, keys: str = "") -> str:
    """``source``: CTEs ending in ``t(<keys> a, b)``."""
    k, on = (f"{keys}, ", f"USING ({keys})") if keys else ("", "ON true")
    g = f"GROUP BY {keys}" if keys else ""
    return f"""WITH {source}, c AS (SELECT {k}a, b, count(*)::DOUBLE AS c FROM t GROUP BY ALL),
      ra AS (SELECT {k}a, sum(c) AS c FROM c GROUP BY ALL), rb AS (SELECT {k}b, sum(c) AS c FROM c GROUP BY ALL),
      x AS (SELECT {k}sum(c * (c - 1) / 2) AS s, sum(c) AS n, sum(c * ln(c)) AS eab FROM c {g}), y AS (SELECT {k}sum(c * (c - 1) / 2) AS pa, sum(c * ln(c)) AS ea FROM ra {g}),
      z AS (SELECT {k}sum(c * (c - 1) / 2) AS pb, sum(c * ln(c)) AS eb FROM rb {g}),
      q AS (SELECT *, pa * pb / (n * (n - 1) / 2) AS ex, ln(n) - ea / n AS ha, ln(n) - eb / n AS hb, ln(n) - eab / n AS hab FROM x JOIN y {on} JOIN z {on})
      SELECT {k}n::BIGINT AS n, round((s - ex) / ((pa + pb) / 2 - ex), 6) AS ari, round(2 * (ha + hb - hab) / (ha + hb), 6) AS nmi FROM q"""


METRICS = """mt AS (SELECT l_returnflag AS model, 'mean_price' AS metric, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1
  UNION ALL SELECT l_returnflag, 'mean_discount', avg(l_discount) FROM lineitem GROUP BY 1
  UNION ALL SELECT l_returnflag, 'rows', count(*)::DOUBLE FROM lineitem GROUP BY 1)"""


def oracle() -> dict[str, str]:
    z = f"{RFM}, z AS (SELECT row_id, {_zscore(CONT)} FROM rfm)"
    box_ev = "v AS (SELECT event_type, 'value' AS variable, value FROM events)"
    prio = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    onehot = lambda col, lv: ", ".join(f"CASE WHEN {col} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"{col}_{v}\"" for v in lv)
    out = {
        # sources
        "schema_report": _union(
            f"SELECT '{c}' AS \"column\", '{t}' AS type, '{r}' AS role, '{d}' AS description, count({c}) AS non_null FROM customer"
            for c, t, r, d in [("c_custkey", "bigint", "key", "customer number"), ("c_name", "string", "", ""), ("c_nationkey", "int", "nominal", "nation"),
                               ("c_acctbal", "double", "continuous", "account balance"), ("c_mktsegment", "string", "nominal", "market segment")]),
        "shape": "SELECT count(*) AS n_rows, 11::BIGINT AS n_columns FROM lineitem",
        "join_features_target": "SELECT c_custkey AS row_id, c_acctbal, c_mktsegment, n_name AS target FROM customer JOIN nation ON c_nationkey = n_nationkey",
        "csv_round_trip": f"WITH {z} SELECT row_id, {_rounded(CONT)} FROM z",
        # reshape
        "wide_to_long": _long("lineitem", ["l_discount", "l_tax"], "l_orderkey, l_linenumber, "),
        "first_rows": "SELECT o_orderkey AS row_id, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5",
        "remove_rows": "SELECT c_custkey AS row_id, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
        "attach_labels": "SELECT doc_id AS row_id, n_chars, quality AS cluster FROM documents JOIN labels USING (doc_id)",
        # describe
        "describe_summary": _summary("lineitem", LINE),
        "center_spread": _union(f"SELECT '{c}' AS variable, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std FROM lineitem" for c in LINE),
        "value_counts": "SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1",
        "null_report": f"WITH {GAPS} SELECT * FROM (SELECT 'event_id' AS variable, count(*) FILTER (event_id IS NULL) AS nulls FROM gaps UNION ALL SELECT 'value', count(*) FILTER (value IS NULL) FROM gaps UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL) FROM gaps) WHERE nulls > 0",
        "modes": _union(f"SELECT * FROM (SELECT '{c}' AS variable, {c}::VARCHAR AS mode, count(*) AS count FROM lineitem GROUP BY {c} ORDER BY count DESC, {c} LIMIT 1)" for c in ["l_returnflag", "l_linestatus", "l_linenumber"]),
        "histogram20": """WITH b AS (SELECT min(value) AS lo, max(value) AS hi, avg(value) AS mean FROM events), g AS (SELECT unnest(range(1, 21))::INT AS bin),
          c AS (SELECT least(floor((value - lo) / (hi - lo) * 20)::INT + 1, 20) AS bin, count(*) AS n FROM events, b GROUP BY 1)
          SELECT 'value' AS variable, g.bin, round(lo + (g.bin - 1) * ((hi - lo) / 20), 6) AS "left", round(lo + g.bin * ((hi - lo) / 20), 6) AS "right", coalesce(n, 0) AS count, round(mean, 6) AS mean
          FROM g JOIN b ON true LEFT JOIN c ON c.bin = g.bin""",
        "boxplot_stats": _box(box_ev, "event_type, variable"),
        "boxplot_long": _box(f"v AS ({_long('lineitem', LINE)})", "variable"),
        "boxplot_before_after": _box(f"{FENCE}, v AS (SELECT 'before' AS stage, 'value' AS variable, value FROM events UNION ALL SELECT 'after', 'value', value FROM events, g WHERE value >= low AND value <= high)", "stage, variable"),
        "box_fliers": f"WITH {FENCE} SELECT event_id, 'value' AS variable, value FROM events, g WHERE value < low OR value > high",
        "corr_matrix": CORR,
        "corr_strong_pairs": f"SELECT a, b, round(r, 3) AS r FROM ({CORR}) WHERE pos_a > pos_b AND abs(r) >= 0.3",
        "corr_masked": f"SELECT a, b, CASE WHEN abs(r) >= 0.3 THEN round(r, 3) END AS r FROM ({CORR}) WHERE pos_a > pos_b",
        "crosstab_total": "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\", count(*) AS total FROM lineitem GROUP BY 1",
        "contingency_long": "SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2",
        "cluster_profile": "SELECT c_mktsegment, round(avg(c_acctbal), 2) AS c_acctbal FROM customer GROUP BY 1",
        "cluster_sizes": "SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY 1",
        "noise_summary": "WITH c AS (SELECT CASE WHEN label < 2 THEN -1 ELSE label END AS cluster, count(*) AS size FROM embeddings GROUP BY 1) SELECT sum(size)::BIGINT AS n, count(*) FILTER (cluster <> -1) AS clusters, coalesce(sum(size) FILTER (cluster = -1), 0)::BIGINT AS noise, round(100.0::DOUBLE * coalesce(sum(size) FILTER (cluster = -1), 0)::DOUBLE / sum(size)::DOUBLE, 6) AS noise_pct, min(size) FILTER (cluster <> -1) AS min_size, max(size) FILTER (cluster <> -1) AS max_size FROM c",
        # prepare
        "impute_median": f"WITH {GAPS} SELECT event_id, coalesce(value, (SELECT median(value) FROM gaps)) AS value FROM gaps",
        "impute_mode": f"WITH {GAPS} SELECT event_id, coalesce(event_type, (SELECT event_type FROM gaps WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type FROM gaps",
        "iqr_report": f"WITH {FENCE} SELECT 'value' AS variable, round(q1, 6) AS q1, round(q3, 6) AS q3, round(low, 6) AS low, round(high, 6) AS high, count(*) FILTER (value < low OR value > high) AS outliers, count(*) FILTER (value < low OR value > high) AS rows_any FROM events, g GROUP BY ALL",
        "iqr_filter": f"WITH {FENCE} SELECT event_id, value FROM events, g WHERE value >= low AND value <= high",
        "onehot_all_levels": f"SELECT o_orderkey, {onehot('o_orderpriority', prio)}, {onehot('o_orderstatus', ['F', 'O', 'P'])} FROM orders",
        "model_matrix": f"WITH {RFM} SELECT row_id, {_rounded(CONT)}, {onehot('c_mktsegment', SEG)} FROM rfm",
        "standardize": f"WITH {z} SELECT row_id, {_rounded(CONT)} FROM z",
        "standardize_check": f"WITH {z} " + _union(f"SELECT '{c}' AS variable, round(avg({c}), 4) + 0.0 AS mean, round(stddev_samp({c}), 4) AS std FROM z" for c in CONT),
        "inverse_standardize": f"WITH {RFM} SELECT row_id, {', '.join(f'round({c} + 0.00001234, 4) AS {c}' for c in CONT)} FROM rfm",
        # PCA on two columns, closed form
        "pca_eigen2": f"{PCA2} SELECT 1 AS pc, round(l1, 4) AS eigenvalue, round(l1 / (l1 + l2), 6) AS ratio, round(l1 / (l1 + l2), 6) AS cum FROM p UNION ALL SELECT 2, round(l2, 4), round(l2 / (l1 + l2), 6), 1.0 FROM p",
        "pca2_loadings": f"{PCA2} SELECT 'recency' AS variable, 1 AS pc, round(p11, 6) AS loading FROM p UNION ALL SELECT 'n_orders', 1, round(p12, 6) FROM p UNION ALL SELECT 'recency', 2, round(p21, 6) FROM p UNION ALL SELECT 'n_orders', 2, round(p22, 6) FROM p",
        "pca2_project": f"{PCA2} SELECT row_id, round((recency - m1) * p11 + (n_orders - m2) * p12, 5) AS d1, round((recency - m1) * p21 + (n_orders - m2) * p22, 5) AS d2 FROM rfm, p",
        "pca2_inverse": f"{PCA2} SELECT row_id, round(((recency - m1) * p11 + (n_orders - m2) * p12) * p11 + m1, 5) AS recency, round(((recency - m1) * p11 + (n_orders - m2) * p12) * p12 + m2, 5) AS n_orders FROM rfm, p",
        # neighbours and projection quality
        "knn_edges": f"WITH {DIST} SELECT i, j, round(dh, 6) AS dist, row_number() OVER (PARTITION BY i ORDER BY dh, j)::INT AS rank FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY dh, j) <= 10",
        "jaccard_knn": f"WITH {DIST}, {JACC} SELECT round(avg(len(list_intersect(h, l)) / len(list_distinct(list_concat(h, l)))), 6) AS jaccard FROM nh JOIN nl USING (i)",
        "trustworthiness": _trust("dl", "dh", "trustworthiness"),
        "continuity": _trust("dh", "dl", "continuity"),
        "spearman_dist": f"WITH {DIST}, {SPEAR} SELECT round(corr(rh, rl), 6) AS spearman, count(*) AS n_pairs FROM rr",
        # clustering with given centres
        "kmeans_assign_fixed": f"WITH {CENTRES}, {_lloyd('c0', 'c1')} SELECT row_id, cluster::INT AS cluster FROM c1_as",
        "kmeans_lloyd_step": f"WITH {CENTRES}, {_lloyd('c0', 'c1')}, {_lloyd('c1', 'c2')}, {_lloyd('c2', 'c3')} SELECT cluster::INT AS cluster, n, round(ca, 6) AS c1, round(cb, 6) AS c2 FROM c3",
        # validation of given labels
        "silhouette": f"WITH {SIL} SELECT 'cluster' AS model, round(avg(silhouette), 6) AS silhouette FROM sil",
        "silhouette_samples": f"WITH {SIL} SELECT row_id, cluster, round(silhouette, 6) AS silhouette, row_number() OVER (ORDER BY cluster, silhouette, row_id) - 1 AS y, round(avg(silhouette) OVER (), 6) AS mean FROM sil",
        "dunn": f"WITH {DIST}, m AS (SELECT min(dh) FILTER (ci <> cj) AS closest, max(dh) FILTER (ci = cj) AS widest FROM d) SELECT 'cluster' AS model, round(closest, 6) AS closest, round(widest, 6) AS widest, round(closest / widest, 6) AS dunn FROM m",
        "davies_bouldin": f"WITH {MOM}, cd AS (SELECT a.cluster AS i, b.cluster AS j, sqrt(sum((a.c - b.c) ^ 2)) AS d FROM cen a JOIN cen b ON a.t = b.t AND a.cluster <> b.cluster GROUP BY ALL), r AS (SELECT i, max((si.s + sj.s) / d) AS r FROM cd JOIN sp si ON si.cluster = i JOIN sp sj ON sj.cluster = j GROUP BY 1) SELECT round(avg(r), 6) AS davies_bouldin FROM r",
        "calinski_harabasz": f"WITH {MOM}, g AS (SELECT t, avg(v) AS g FROM long GROUP BY 1), b AS (SELECT sum(n * (c - g) ^ 2) AS b FROM cen JOIN g USING (t) JOIN sp USING (cluster)), w AS (SELECT sum(w) AS w, count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n FROM sp) SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b, w",
        "inertia": f"WITH {MOM} SELECT round(sum(w), 6) AS inertia FROM sp",
        "agreement_labels": _agree("t AS (SELECT quality AS a, toxic AS b FROM labels)"),
        "agreement_flags": _agree("t AS (SELECT l_linenumber AS g, l_returnflag AS a, l_linestatus AS b FROM lineitem)", "g").replace("SELECT g, n::BIGINT", "SELECT g AS l_linenumber, n::BIGINT"),
        "core_distance": f"WITH {DIST} SELECT i AS row_id, round(dh, 6) AS core FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY dh, j) = 4",
        # model comparison
        "metric_minmax": f"WITH {METRICS} SELECT model, metric, round(value, 4) AS value, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS scaled FROM mt WINDOW w AS (PARTITION BY metric)",
        "model_compare": f"WITH {METRICS} SELECT model, round(max(value) FILTER (metric = 'mean_price'), 3) AS mean_price, round(max(value) FILTER (metric = 'mean_discount'), 3) AS mean_discount, round(max(value) FILTER (metric = 'rows'), 3) AS rows FROM mt GROUP BY 1",
        "best_per_batch": "WITH r AS (SELECT o_orderstatus AS batch, o_orderpriority AS run, avg(o_totalprice) AS score FROM orders GROUP BY ALL) SELECT batch, run, round(score, 4) AS score FROM r QUALIFY row_number() OVER (PARTITION BY batch ORDER BY score DESC NULLS LAST, run) = 1",
    }
    def metrics(name, dist):
        swap = lambda q: q.replace(DIST, dist)
        return f"""{name} AS (WITH {dist}, {JACC}, {SPEAR}
          SELECT 'jaccard' AS metric, round(avg(len(list_intersect(h, l)) / len(list_distinct(list_concat(h, l)))), 6) AS {name} FROM nh JOIN nl USING (i)
          UNION ALL SELECT 'spearman', round(corr(rh, rl), 6) FROM rr
          UNION ALL SELECT 'trustworthiness', trustworthiness FROM ({swap(_trust("dl", "dh", "trustworthiness"))})
          UNION ALL SELECT 'continuity', continuity FROM ({swap(_trust("dh", "dl", "continuity"))}))"""

    both = f"WITH {metrics('low', DIST)}, {metrics('other', DIST.replace(EMB, _emb(OTHER)))}, c AS (SELECT metric, low, other, CASE WHEN low >= other THEN 'low' ELSE 'other' END AS winner FROM low JOIN other USING (metric))"
    out["projection_compare"] = both + " SELECT metric, low, other, round(other - low, 6) AS delta, winner FROM c"
    out["projection_decide"] = both + " SELECT count(*) FILTER (winner = 'other') AS wins, count(*) AS metrics, CASE WHEN count(*) FILTER (winner = 'other') >= 3 THEN 'other' ELSE 'low' END AS decision FROM c"
    return out
