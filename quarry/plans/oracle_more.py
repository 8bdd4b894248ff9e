"""SQL twins of the queries on cleaned tables, two-column components, given labels and centres."""
from __future__ import annotations

from quarry.plans.features import OTHER
from quarry.plans.labelled import BIN, MAX_EPS
from quarry.plans.oracle import CENTRES, CONT, CORR, EMB, PCA2, RFM, SEG, _agree, _emb, _lloyd, _rounded, _union, oracle

SPIKES = """sp AS (SELECT event_id, user_id::DOUBLE AS user_id, CASE WHEN event_id % 17 <> 0 THEN value + CASE WHEN event_id % 101 = 0 THEN 1e6 ELSE 0 END END AS value,
  (event_id % 50) + CASE WHEN event_id % 97 = 0 THEN 5000.0::DOUBLE ELSE 0.0::DOUBLE END AS load, CASE WHEN event_id % 23 <> 0 THEN event_type END AS event_type FROM events)"""
CLEAN = f"""{SPIKES}, full_ AS (SELECT event_id AS row_id, coalesce(value, (SELECT median(value) FROM sp)) AS value, load,
    coalesce(event_type, (SELECT event_type FROM sp WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type FROM sp),
  fv AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, quantile_cont(load, 0.25) AS c, quantile_cont(load, 0.75) AS e FROM full_),
  clean AS (SELECT full_.* FROM full_, fv WHERE value >= a - 1.5 * (b - a) AND value <= b + 1.5 * (b - a) AND load >= c - 1.5 * (e - c) AND load <= e + 1.5 * (e - c))"""
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
POINTS = f"""{EMB}, p AS (SELECT id AS row_id, y, y[1] AS u, y[2] AS v, cluster AS c, CASE WHEN y[1] > 0 THEN 1 ELSE 0 END AS k2,
    CASE WHEN y[1] > 0 THEN 0 WHEN y[2] > 0 THEN 1 ELSE 2 END AS k3, (CASE WHEN y[1] > 0 THEN 2 ELSE 0 END) + (CASE WHEN y[2] > 0 THEN 1 ELSE 0 END) AS k4 FROM e),
  q AS (SELECT *, CASE WHEN row_id % 7 < 2 THEN -1 ELSE k4 END AS marked FROM p)"""


def _agreement() -> str:
    own = _agree("t AS (SELECT 1)").replace("WITH t AS (SELECT 1), c AS (SELECT a, b, count(*)::DOUBLE AS c FROM t GROUP BY ALL)", "WITH c AS (SELECT g AS a, t.c AS b, count(*)::DOUBLE AS c FROM t GROUP BY ALL)")
    return own.replace("round((s - ex) / ((pa + pb) / 2 - ex), 6)", "(s - ex) / ((pa + pb) / 2 - ex)").replace("round(2 * (ha + hb - hab) / (ha + hb), 6)", "2 * (ha + hb - hab) / (ha + hb)")


def _metrics(model: str, label: str, where: str = "true") -> str:
    """``(model, metric, value)`` of one label column of ``q``."""
    return f"""SELECT {model} AS model, metric, value FROM (
      WITH t AS (SELECT row_id, u, v, c, {label} AS g FROM q WHERE {where}), n AS (SELECT g, count(*) AS n, avg(u) AS cu, avg(v) AS cv FROM t GROUP BY 1),
      w AS (SELECT t.g, n.n, cu, cv, avg(sqrt((u - cu) ^ 2 + (v - cv) ^ 2)) AS s, sum((u - cu) ^ 2 + (v - cv) ^ 2) AS ss FROM t JOIN n USING (g) GROUP BY ALL),
      d AS (SELECT a.row_id AS i, a.g AS gi, b.g AS gj, sqrt((a.u - b.u) ^ 2 + (a.v - b.v) ^ 2) AS d FROM t a JOIN t b ON a.row_id <> b.row_id),
      sm AS (SELECT i, gi, gj, sum(d) AS d FROM d GROUP BY ALL),
      ab AS (SELECT i, gi, max(CASE WHEN gi = gj THEN sm.d / greatest(n.n - 1, 1) END) AS a, min(CASE WHEN gi <> gj THEN sm.d / n.n END) AS b FROM sm JOIN n ON n.g = sm.gj GROUP BY ALL),
      si AS (SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS v FROM ab),
      db AS (SELECT avg(r) AS v FROM (SELECT a.g, max((a.s + b.s) / sqrt((a.cu - b.cu) ^ 2 + (a.cv - b.cv) ^ 2)) AS r FROM w a JOIN w b ON a.g <> b.g GROUP BY 1)),
      ch AS (SELECT (sum(w.n * ((cu - mu) ^ 2 + (cv - mv) ^ 2)) / (count(*) - 1)) / (sum(ss) / (sum(w.n) - count(*))) AS v FROM w, (SELECT avg(u) AS mu, avg(v) AS mv FROM t)),
      du AS (SELECT min(d) FILTER (gi <> gj) / max(d) FILTER (gi = gj) AS v FROM d),
      ag AS ({_agreement()})
      SELECT 'inertia' AS metric, sum(ss) AS value FROM w UNION ALL SELECT 'silhouette', v FROM si UNION ALL SELECT 'davies_bouldin', v FROM db
      UNION ALL SELECT 'calinski_harabasz', v FROM ch UNION ALL SELECT 'dunn', v FROM du UNION ALL SELECT 'ari', ari FROM ag UNION ALL SELECT 'nmi', nmi FROM ag)"""


def _walk(min_samples: int, x: str = "y", max_eps: float = 1e200) -> str:
    """The walk step by step: every point lets in what it reaches, the nearest one left is next, the first on ties."""
    return f"""WITH RECURSIVE {EMB}, t AS (SELECT id, {x} AS y, row_number() OVER (ORDER BY id) AS k FROM e),
          l AS (SELECT a.k, any_value(a.id) AS id, list(list_distance(a.y, b.y) ORDER BY b.k) AS dl FROM t a JOIN t b ON true GROUP BY a.k),
          r AS (SELECT k, id, list_transform(dl, lambda d: CASE WHEN d <= {max_eps} AND list_sort(dl)[{min_samples}] <= {max_eps} THEN d ELSE 1e300::DOUBLE END) AS dl, list_sort(dl)[{min_samples}] AS core FROM l),
          n AS (SELECT count(*) AS n FROM t),
          walk AS (SELECT 0::BIGINT AS pos, 1::BIGINT AS cur, list_transform(range(1, n + 1), lambda k: 1e300::DOUBLE) AS reach, list_transform(range(1, n + 1), lambda k: 0::BIGINT) AS pred, list_transform(range(1, n + 1), lambda k: k = 1) AS seen FROM n
            UNION ALL
            SELECT pos + 1, nxt, reach, pred, list_transform(range(1, len(seen) + 1), lambda k: seen[k] OR k = nxt) FROM (
              SELECT pos, reach, pred, seen, list_position(open, list_min(open)) AS nxt FROM (
                SELECT pos, reach, pred, seen, list_transform(range(1, len(seen) + 1), lambda k: CASE WHEN seen[k] THEN 2e300::DOUBLE ELSE reach[k] END) AS open FROM (
                  SELECT pos, seen, list_transform(range(1, len(seen) + 1), lambda k: CASE WHEN seen[k] THEN reach[k] ELSE least(reach[k], greatest(core, dl[k])) END) AS reach,
                    list_transform(range(1, len(seen) + 1), lambda k: CASE WHEN NOT seen[k] AND greatest(core, dl[k]) < reach[k] THEN id ELSE pred[k] END) AS pred
                  FROM (SELECT walk.pos, walk.seen, walk.reach, walk.pred, r.core, r.dl, r.k AS id FROM walk JOIN r ON r.k = walk.cur) WHERE pos + 1 < len(seen)))))
          SELECT pos, r.id AS row_id, round(CASE WHEN reach[cur] < 1e300 THEN reach[cur] END, 6) AS reachability, round(CASE WHEN core <= {max_eps} THEN core END, 6) AS core, p.id AS predecessor
          FROM walk JOIN r ON r.k = walk.cur LEFT JOIN t p ON p.k = pred[cur] AND reach[cur] < 1e300"""


def more() -> dict[str, str]:
    onehot = ", ".join(f"CASE WHEN event_type = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS event_type_{v}" for v in EVENT_TYPES)
    segments = ", ".join(f"count(*) FILTER (c_mktsegment = '{v}') AS \"{v}\"" for v in SEG)
    cols = ["value", "load", *[f"event_type_{v}" for v in EVENT_TYPES]]
    fence = "qf AS (" + _union(f"SELECT '{c}' AS variable, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM sp" for c in ("value", "load", "user_id")) + "), g AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM qf)"
    lo = "SELECT event_id, 'value' AS variable, value AS x FROM sp UNION ALL SELECT event_id, 'load', load FROM sp UNION ALL SELECT event_id, 'user_id', user_id FROM sp"
    grid = f"grid AS ({_union(_metrics(str(k), f'k{k}') for k in (2, 3, 4))}), rg AS (SELECT model::INT AS k, metric, round(value, 6) AS value FROM grid)"
    variance = "vt AS (SELECT 1 AS pc, l1 / 100 AS eigenvalue, l1 / (l1 + l2) AS ratio, l1 / (l1 + l2) AS cum FROM p UNION ALL SELECT 2, l2 / 100, l2 / (l1 + l2), 1.0::DOUBLE FROM p)"
    stats = _union(f"SELECT '{c}' AS variable, avg({c}) AS m, stddev_pop({c}) AS s FROM rfm" for c in CONT)
    centres = f"WITH {CENTRES}, st AS ({stats}), ce AS (SELECT c.cluster::INT AS cluster, variable, CASE variable WHEN '{CONT[0]}' THEN ca WHEN '{CONT[1]}' THEN cb ELSE 0.0::DOUBLE END AS z, m, s FROM c0 c JOIN st ON true)"
    labels = f"WITH {CENTRES}, {_lloyd('c0', 'c1')}"
    noisy = f"""nb AS ({_metrics("'noisy'", "marked", "marked <> -1")}), sizes AS (SELECT marked AS g, count(*) AS n FROM q GROUP BY 1),
      fact AS (SELECT sum(n)::DOUBLE AS n, (count(*) FILTER (g <> -1))::DOUBLE AS clusters, sum(n) FILTER (g = -1)::DOUBLE AS noise, min(n) FILTER (g <> -1)::DOUBLE AS lo, max(n) FILTER (g <> -1)::DOUBLE AS hi FROM sizes),
      bundle AS (SELECT 'noisy' AS model, metric, round(value, 5) AS value FROM nb WHERE metric <> 'inertia' UNION ALL SELECT 'noisy', 'clusters', clusters FROM fact
        UNION ALL SELECT 'noisy', 'noise_pct', round(100 * noise / n, 5) FROM fact UNION ALL SELECT 'noisy', 'min_size', lo FROM fact UNION ALL SELECT 'noisy', 'max_size', hi FROM fact)"""
    both = f"WITH {POINTS}, {grid}, {noisy}, lm AS (SELECT 'k=' || k AS model, metric, value FROM rg WHERE metric <> 'inertia' UNION ALL SELECT * FROM bundle)"
    names = ["silhouette", "davies_bouldin", "calinski_harabasz", "ari", "nmi", "dunn", "clusters", "noise_pct", "min_size", "max_size"]
    return {
        "iqr_union": f"""WITH {SPIKES}, {fence}, l AS ({lo}), o AS (SELECT l.*, coalesce(x < low OR x > high, false) AS out FROM l JOIN g USING (variable)), u AS (SELECT count(*) AS rows_any FROM (SELECT event_id FROM o WHERE out GROUP BY 1))
          SELECT variable, round(q1, 6) AS q1, round(q3, 6) AS q3, round(low, 6) AS low, round(high, 6) AS high, count(*) FILTER (out) AS outliers, any_value(rows_any) AS rows_any FROM o JOIN g USING (variable), u GROUP BY ALL""",
        "clean_matrix": f"WITH {CLEAN}, m AS (SELECT row_id, value, load, {onehot} FROM clean), z AS (SELECT row_id, {', '.join(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}' for c in cols)} FROM m) SELECT row_id, {_rounded(cols)} FROM z",
        "target_after_cleaning": f"WITH {CLEAN} SELECT event_type AS value, count(*) AS count FROM clean GROUP BY 1",
        "merge_records": "SELECT o_orderstatus AS model, round(avg(o_totalprice), 4) AS mean_price, count(*) AS rows, NULL::DOUBLE AS mean_size FROM orders GROUP BY 1 UNION ALL SELECT p_brand, NULL, count(*), round(avg(p_size), 4) FROM part GROUP BY 1",
        "label_file": "SELECT toxic::INT AS value, count(*) AS count FROM labels GROUP BY 1",
        "onehot_long": "SELECT o_orderkey, 'o_orderpriority' AS variable, o_orderpriority AS level, 1.0::DOUBLE AS value FROM orders WHERE o_orderpriority IS NOT NULL UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus, 1.0 FROM orders WHERE o_orderstatus IS NOT NULL",
        "noise_filter": f"WITH {POINTS} SELECT row_id, marked AS cluster FROM q WHERE marked <> -1",
        "pca2_kaiser": f"{PCA2}, {variance} SELECT count(*) FILTER (eigenvalue > 1) AS components, round(max(cum) FILTER (eigenvalue > 1), 6) AS cum FROM vt",
        "pca2_components_for": f"{PCA2}, {variance} SELECT min(pc) FILTER (cum >= 0.8) AS components, round(min(cum) FILTER (cum >= 0.8), 6) AS cum FROM vt",
        "pca2_scree": f"{PCA2}, {variance} SELECT pc, round(eigenvalue, 4) AS eigenvalue, round(ratio * 100, 4) AS ratio_pct, round(cum * 100, 4) AS cum_pct, 1.0::DOUBLE AS eigen_line, 80.0::DOUBLE AS share_line_pct, eigenvalue > 1 AS above_eigen_line FROM vt",
        "pca2_target": f"{PCA2} SELECT row_id, round((recency - m1) * p11 + (n_orders - m2) * p12, 5) AS d1, round((recency - m1) * p21 + (n_orders - m2) * p22, 5) AS d2, c_mktsegment AS y FROM rfm, p",
        "pca_invariants": f"WITH {RFM}, n AS (SELECT count(*)::DOUBLE AS n, ({len(CONT)} + count(DISTINCT c_mktsegment)) AS p FROM rfm), t AS (SELECT round(p * n / (n - 1), 6) AS t FROM n) SELECT 'total_variance' AS fact, t AS value FROM t UNION ALL SELECT 'variance_of_columns', t FROM t UNION ALL SELECT 'orthonormality_error', 0.0::DOUBLE UNION ALL SELECT 'score_variance_error', 0.0::DOUBLE UNION ALL SELECT 'score_correlation', 0.0::DOUBLE",
        "corr_matrix_products": CORR,
        "silhouette_bounds": oracle()["silhouette"],
        "kmeans_invariants": f"WITH {RFM} SELECT fact, value FROM (VALUES ('rows', (SELECT count(*)::DOUBLE FROM rfm)), ('models', 11.0::DOUBLE), ('clusters', 12.0), ('inertia_falls', 1.0), ('inertia_is_that_of_labels', 1.0), ('below_plain_start', 1.0), ('centres_are_means', 1.0)) t(fact, value)",
        "optics_invariants": f"WITH {RFM}, n AS (SELECT count(*)::DOUBLE AS n FROM rfm) SELECT fact, value::DOUBLE AS value FROM n, LATERAL (VALUES ('rows', n), ('ids', n), ('last_position', n - 1), ('starts', 1.0), ('entered_from_later', 0.0), ('labelled', n), ('torn_clusters', 0.0), ('summary_adds_up', 1.0)) t(fact, value)",
        "umap_invariants": f"WITH {RFM}, n AS (SELECT count(*)::DOUBLE AS n FROM rfm) SELECT fact, value::DOUBLE AS value FROM n, LATERAL (VALUES ('rows', n), ('ids', n), ('lost', 0.0), ('spread', 1.0)) t(fact, value)",
        "projection_alone": f"SELECT 'PCA' AS method, row_id, d1, d2 FROM ({oracle()['pca2_project']})",
        "projections_fixed": f"WITH {EMB}, o AS (SELECT * FROM (WITH {_emb(OTHER)} SELECT * FROM e)) SELECT 'low' AS method, id AS row_id, round(y[1], 6) AS d1, round(y[2], 6) AS d2 FROM e UNION ALL SELECT 'other', id, round(y[1], 6), round(y[2], 6) FROM o",
        "optics_walk": f"SELECT pos, row_id, reachability, core FROM ({_walk(5)})",
        "optics_walk_lists": _walk(5),
        "optics_walk_ties": _walk(5, f"list_transform(y, lambda v: floor(v / {BIN}))"),
        "optics_walk_radius": _walk(5, max_eps=MAX_EPS),
        "optics_walk_radius_ties": _walk(9, f"list_transform(y, lambda v: floor(v / {BIN}))", 1.0),
        "fuzzy_graph_embeddings": f"""WITH RECURSIVE {EMB}, d AS (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM e a JOIN e b ON a.id <> b.id),
          nn AS (SELECT i, j, d FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 14),
          l AS (SELECT i, list(d) AS d, avg(d) AS mean, coalesce(min(d) FILTER (d > 0), 0) AS rho FROM nn GROUP BY 1),
          g AS (SELECT i, mean, rho, list_transform(d, lambda v: greatest(v - rho, 0)) AS gap FROM l),
          b AS (SELECT i, 0 AS step, 0.0::DOUBLE AS lo, 'infinity'::DOUBLE AS hi, 1.0::DOUBLE AS s FROM g
            UNION ALL SELECT i, step + 1, lo2, hi2, CASE WHEN isinf(hi2) THEN s * 2 ELSE (lo2 + hi2) / 2 END FROM (
              SELECT i, step, s, CASE WHEN over_ THEN lo ELSE s END AS lo2, CASE WHEN over_ THEN s ELSE hi END AS hi2 FROM (
                SELECT b.*, list_sum(list_transform(gap, lambda v: exp(-v / s))) > log2(15) AS over_ FROM b JOIN g USING (i) WHERE step < 64))),
          f AS (SELECT b.i, rho, greatest(s, 1e-3 * mean, 1e-12) AS s FROM b JOIN g USING (i) WHERE step = 64),
          w AS (SELECT i, j, exp(-greatest(d - rho, 0) / s) AS w FROM nn JOIN f USING (i))
          SELECT min(i) AS i, CASE WHEN min(i) = least(any_value(i), any_value(j)) THEN greatest(any_value(i), any_value(j)) ELSE least(any_value(i), any_value(j)) END AS j,
            round(sum(w) - (sum(w) ^ 2 - sum(w * w)) / 2, 5) AS w FROM w GROUP BY least(i, j), greatest(i, j)""",
        "label_grid": f"WITH {POINTS}, {grid} SELECT * FROM rg",
        "label_elbow": f"WITH {POINTS}, {grid}, i AS (SELECT k, value, lag(value) OVER (ORDER BY k) - value AS drop FROM rg WHERE metric = 'inertia') SELECT k, round(value, 4) AS value, round(drop, 4) AS drop, round(drop - lead(drop) OVER (ORDER BY k), 4) AS bend FROM i",
        "label_select_k": f"WITH {POINTS}, {grid} SELECT metric, k, value FROM rg WHERE metric IN ('silhouette', 'calinski_harabasz', 'davies_bouldin') QUALIFY row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'davies_bouldin' THEN value ELSE -value END, k) = 1",
        "fixed_centroid_units": f"{centres} SELECT cluster, variable, round(z, 6) AS z, round(z * s + m, 6) AS value FROM ce",
        "fixed_centroid_top5": f"{centres} SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, variable)::INT AS rank, variable, round(z, 6) AS z FROM ce QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, variable) <= 5",
        "fixed_profile": f"{labels} SELECT cluster::INT AS cluster, {', '.join(f'round(avg(r.{c}), 1) AS {c}' for c in CONT)} FROM c1_as JOIN rfm r USING (row_id) GROUP BY 1",
        "fixed_crosstab": f"{labels} SELECT cluster::INT AS cluster, {segments}, count(*) AS total FROM c1_as JOIN rfm USING (row_id) GROUP BY 1",
        "fixed_scatter": f"{labels} SELECT 'point' AS kind, row_id, round(a, 6) AS d1, round(b, 6) AS d2, cluster::INT AS cluster, false AS is_noise FROM c1_as UNION ALL SELECT 'centre', NULL, round(ca, 6), round(cb, 6), cluster::INT, false FROM c0",
        "noisy_bundle": f"WITH {POINTS}, {noisy} SELECT * FROM bundle",
        "label_comparison": both + " SELECT model, " + ", ".join(f"round(max(value) FILTER (metric = '{m}'), 3) AS {m}" for m in names) + " FROM lm GROUP BY 1",
        "label_normalised": both + f" SELECT model, metric, value, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 4) AS scaled FROM lm WHERE metric IN {tuple(names[:6])} WINDOW w AS (PARTITION BY metric)",
    }
