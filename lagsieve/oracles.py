"""The queries' definitions in DuckDB SQL, written from the definitions and not from the plans."""

from __future__ import annotations

NAN, INF = "CAST('nan' AS DOUBLE)", "CAST('inf' AS DOUBLE)"
PI = "3.141592653589793"
PANEL = """
ev AS (SELECT CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS BIGINT) AS t, event_type AS channel, sum(value) AS v FROM events GROUP BY 1, 2),
chs AS (SELECT channel, CAST(row_number() OVER (ORDER BY channel) - 1 AS INT) AS ch FROM (SELECT DISTINCT event_type AS channel FROM events)),
panel AS (SELECT g.t, chs.ch, chs.channel, coalesce(ev.v, CAST(0 AS DOUBLE)) AS v FROM (SELECT unnest(range(0, 720)) AS t) g CROSS JOIN chs LEFT JOIN ev ON ev.t = g.t AND ev.channel = chs.channel),
sc AS (SELECT ch, channel, avg(v) AS mean, CASE WHEN stddev_pop(v) = 0 THEN CAST(1 AS DOUBLE) ELSE stddev_pop(v) END AS scale FROM panel WHERE t < 331 GROUP BY 1, 2),
zp AS MATERIALIZED (SELECT t, panel.ch, panel.channel, v, (v - mean) / scale AS z FROM panel JOIN sc ON sc.ch = panel.ch WHERE t < 552),
lg AS MATERIALIZED (SELECT * FROM (SELECT ch, t AS u, z AS y, lag(z) OVER (PARTITION BY ch ORDER BY t) AS x FROM zp) WHERE x IS NOT NULL),
al AS (SELECT * FROM (VALUES (0, CAST(0.001 AS DOUBLE)), (1, CAST(0.01 AS DOUBLE)), (2, CAST(0.1 AS DOUBLE)), (3, CAST(1 AS DOUBLE)), (4, CAST(10 AS DOUBLE))) a(alpha_idx, alpha))"""
PATH = """,
st AS (SELECT ch, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx, sum(y * y) - count(*) * avg(y) * avg(y) AS syy, sum(x * y) - count(*) * avg(x) * avg(y) AS sxy FROM lg WHERE u < 331 GROUP BY ch),
pa AS (SELECT ch, alpha_idx, alpha, n, sxy / (sxx + alpha) AS slope, my - sxy / (sxx + alpha) * mx AS intercept, sxx / (sxx + alpha) AS df, (syy - 2 * sxy / (sxx + alpha) * sxy + pow(sxy / (sxx + alpha), 2) * sxx) / n AS mse FROM st, al),
pt AS (SELECT ch, alpha_idx, alpha, slope, intercept, df, mse / pow(1 - df / n, 2) AS gcv FROM pa)"""
VAL = PATH + """,
er AS (SELECT pt.ch, alpha_idx, alpha, slope, intercept, avg(pow(y - slope * x - intercept, 2)) AS mse FROM lg JOIN pt ON pt.ch = lg.ch WHERE u >= 331 AND u < 441 GROUP BY ALL),
ft AS (SELECT ch, alpha, slope, intercept FROM (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY mse, alpha_idx) AS k FROM er) WHERE k = 1)"""
GCV = PATH + """,
fg AS (SELECT ch, alpha, slope, intercept FROM (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY gcv, alpha_idx) AS k FROM pt) WHERE k = 1),
inn AS MATERIALIZED (SELECT lg.ch, CASE WHEN u < 331 THEN 'train_fit' WHEN u < 441 THEN 'val_alpha' ELSE 'cert' END AS split, u, y, slope * x + intercept AS pred, y - slope * x - intercept AS resid, alpha, x FROM lg JOIN fg ON fg.ch = lg.ch)"""
SCREEN = GCV + """,
sr AS MATERIALIZED (SELECT i.ch AS target, l.ch AS source, i.u, i.resid AS y, l.x FROM inn i JOIN lg l ON l.u = i.u AND l.ch <> i.ch),
ss AS (SELECT target, source, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx, sum(x * y) - count(*) * avg(x) * avg(y) AS sxy FROM sr WHERE u < 331 GROUP BY 1, 2),
sp AS (SELECT target, source, alpha_idx, alpha, sxy / (sxx + alpha) AS slope, my - sxy / (sxx + alpha) * mx AS intercept FROM ss, al),
se AS (SELECT sp.target, sp.source, alpha_idx, alpha, slope, intercept, avg(pow(y - slope * x - intercept, 2)) AS mse FROM sr JOIN sp ON sp.target = sr.target AND sp.source = sr.source WHERE u >= 331 AND u < 441 GROUP BY ALL),
sb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, source ORDER BY mse, alpha_idx) AS k FROM se) WHERE k = 1),
sx AS MATERIALIZED (SELECT sb.target, sb.source, max(alpha) AS alpha_screen, 1 - sum(pow(y - slope * x - intercept, 2)) / sum(y * y) AS s_screen FROM sr JOIN sb ON sb.target = sr.target AND sb.source = sr.source WHERE u >= 441 GROUP BY 1, 2),
sk AS (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY isnan(s_screen), s_screen DESC, source) AS INT) AS screen_rank FROM sx)"""


def solved(rows: str, keys: str) -> str:
    """CTEs from `rows` (keys, u, y, x1, x2): gains of x2 beside x1 at alpha 1."""
    on = " AND ".join(f"a.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    return f""",
f0 AS (SELECT {keys}, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, sum(x1 * x1) AS q11, sum(x2 * x2) AS q22, sum(x1 * x2) AS q12, sum(x1 * y) AS q1y, sum(x2 * y) AS q2y FROM {rows} WHERE u < 331 GROUP BY ALL),
f1 AS (SELECT {keys}, m1, m2, my, q11 - n * m1 * m1 + 1 AS g11, q22 - n * m2 * m2 + 1 AS g22, q12 - n * m1 * m2 AS g12, q1y - n * m1 * my AS g1y, q2y - n * m2 * my AS g2y FROM f0),
f2 AS (SELECT {keys}, m1, m2, my, g1y / g11 AS s1, (g22 * g1y - g12 * g2y) / (g11 * g22 - g12 * g12) AS b1, (g11 * g2y - g12 * g1y) / (g11 * g22 - g12 * g12) AS b2 FROM f1),
dl AS MATERIALIZED (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, count(*) AS n_cert, (sum(pow(y - my - s1 * (x1 - m1), 2)) - sum(pow(y - my - b1 * (x1 - m1) - b2 * (x2 - m2), 2))) / (count(*) * var_pop(y)) AS delta
       FROM {rows} a JOIN f2 f ON {on} WHERE u >= 441 GROUP BY ALL)"""


PAIRS = ", pr AS MATERIALIZED (SELECT o.ch AS target, s.ch AS source, o.u, o.y, o.x AS x1, s.x AS x2 FROM lg o JOIN lg s ON s.u = o.u AND s.ch <> o.ch)"
SHIFT = PAIRS + """,
sh AS MATERIALIZED (SELECT o.target, o.source, o.b, o.u, o.y, o.x1, s.x AS x2 FROM (SELECT *, (u - 1 + CASE WHEN b < 0 THEN 0 ELSE (b + 1) * 551 // 20 END) % 551 + 1 AS from_u FROM (SELECT target, source, u, y, x1, unnest(range(-1, 19)) AS b FROM pr)) o JOIN lg s ON s.ch = o.source AND s.u = o.from_u)""" + solved("sh", "target, source, b") + """,
dt AS (SELECT target, source, delta AS delta_true FROM dl WHERE b < 0),
sn AS MATERIALIZED (SELECT dl.target, dl.source, any_value(delta_true) AS delta_true, avg(delta) AS delta_null_mean, stddev_pop(delta) AS delta_null_std, any_value(delta_true) - avg(delta) AS aligned_gain,
       (1 + count(*) FILTER (delta >= delta_true)) / CAST(20 AS DOUBLE) AS p_value FROM dl JOIN dt ON dt.target = dl.target AND dt.source = dl.source WHERE b >= 0 GROUP BY 1, 2)"""
EDGES = """
oe AS MATERIALIZED (SELECT CAST(o_custkey % 12 AS INT) AS target, o_orderkey AS source,
  CASE WHEN o_orderkey % 101 = 0 THEN CAST('nan' AS DOUBLE) ELSE ((o_orderkey * 37 % 997 + 1) / CAST(998 AS DOUBLE)) * ((o_orderkey * 37 % 997 + 1) / CAST(998 AS DOUBLE)) * ((o_orderkey * 37 % 997 + 1) / CAST(998 AS DOUBLE)) * ((o_orderkey * 37 % 997 + 1) / CAST(998 AS DOUBLE)) END AS p_value,
  (o_orderkey % 3 <> 0) AS certified_candidate, CAST(o_orderkey % 2 * 300 + 20 AS INT) AS B, o_totalprice / CAST(100000 AS DOUBLE) - 1 AS aligned_gain, (o_orderkey * 53 % 1009) / CAST(1009 AS DOUBLE) AS coherence_peak,
  o_totalprice / CAST(200000 AS DOUBLE) - CAST(0.5 AS DOUBLE) AS delta_true, CASE o_orderkey % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'NULL' ELSE 'DECOY' END AS edge_type FROM orders)"""


def bh(per: str) -> str:
    w = f"PARTITION BY {per}" if per else ""
    match = f"cu.{per} = oe.{per}" if per else "TRUE"
    cols = f"{per}, " if per else ""
    return f""",
ra AS (SELECT {cols}p_value, row_number() OVER ({w} ORDER BY p_value) / CAST(count(*) OVER ({w}) AS DOUBLE) * CAST(0.1 AS DOUBLE) AS threshold FROM oe WHERE NOT isnan(p_value)),
cu AS (SELECT {cols}max(p_value) AS cutoff FROM ra WHERE p_value <= threshold {f'GROUP BY {per}' if per else ''}),
fd AS (SELECT oe.*, CAST(0.1 AS DOUBLE) AS fdr_q, coalesce(NOT isnan(oe.p_value) AND oe.p_value <= cutoff, FALSE) AND certified_candidate AS fdr_pass, B < 200 AS fdr_underpowered FROM oe LEFT JOIN cu ON {match})"""


STABLE = """,
bl AS (SELECT target, source, count(DISTINCT block) AS k FROM (SELECT target, source, unnest([0, 1, 2]) AS block FROM oe) WHERE (source * 7 + block * 3) % 5 < 3 GROUP BY 1, 2),
sl AS (SELECT oe.target, oe.source, coalesce(k, 0) / CAST(3 AS DOUBLE) AS stability_fraction FROM oe LEFT JOIN bl ON bl.target = oe.target AND bl.source = oe.source)"""
ADMIT = EDGES + bh("target") + STABLE + ", ad AS (SELECT fd.*, stability_fraction >= CAST(0.6 AS DOUBLE) AS stability_pass, certified_candidate AND fdr_pass AND stability_fraction >= CAST(0.6 AS DOUBLE) AS e_certified FROM fd JOIN sl ON sl.target = fd.target AND sl.source = fd.source)"


def r(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n.strip()}, {digits}) + CAST(0 AS DOUBLE) AS {n.strip().split('.')[-1]}" for n in names.split(","))


def daily(table: str, day: str, channel: str, value: str, digits: int) -> str:
    return f"""WITH e AS (SELECT CAST(date_diff('day', DATE '1995-01-01', CAST({day} AS DATE)) AS BIGINT) AS t, {channel} AS channel, sum({value}) AS v FROM {table} GROUP BY 1, 2),
c AS (SELECT channel, CAST(row_number() OVER (ORDER BY channel) - 1 AS INT) AS ch FROM (SELECT DISTINCT channel FROM e)), b AS (SELECT min(t) AS lo, max(t) AS hi FROM e)
SELECT g.t - lo AS t, c.ch, c.channel, round(coalesce(e.v, CAST(0 AS DOUBLE)), {digits}) + CAST(0 AS DOUBLE) AS v FROM (SELECT unnest(range(lo, hi + 1)) AS t, lo FROM b) g CROSS JOIN c LEFT JOIN e ON e.t = g.t AND e.channel = c.channel"""


def dft(rows: str, keys: str, n: int) -> str:
    """A relation (keys, k, re, im): the transform of rows (keys, t, x) over n points."""
    return f"SELECT {keys}, k, sum(x * cos(2 * {PI} * ((k * t) % {n}) / {n})) AS re, -sum(x * sin(2 * {PI} * ((k * t) % {n}) / {n})) AS im FROM {rows}, (SELECT unnest(range(0, {n // 2 + 1})) AS k) GROUP BY ALL"


def oracles() -> dict[str, str]:
    w = f"WITH {PANEL.strip()}"
    e = f"WITH {EDGES.strip()}"
    seg = ", sg AS (SELECT ch, seg, t - seg * 69 AS t, z FROM zp, (SELECT unnest(range(0, 7)) AS seg) WHERE t >= seg * 69 AND t < seg * 69 + 138), " \
          f"wn AS (SELECT ch, seg, t, (z - avg(z) OVER (PARTITION BY ch, seg)) * (0.5 - 0.5 * cos(2 * {PI} * t / 138)) AS x FROM sg), ft AS MATERIALIZED ({dft('wn', 'ch, seg', 138)})"
    ranks = "rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / CAST(2 AS DOUBLE)"
    return {
        "panel_hourly": f"{w} SELECT t, ch, channel, {r('v')} FROM panel",
        "panel_orders": daily("orders", "o_orderdate", "o_orderpriority", "o_totalprice", 4),
        "panel_lineitem": daily("lineitem", "l_shipdate", "l_returnflag || l_linestatus", "l_quantity", 6),
        "panel_users": "SELECT CAST(row_number() OVER (ORDER BY lpad(CAST(user_id AS VARCHAR), 12, '0')) - 1 AS INT) AS ch, lpad(CAST(user_id AS VARCHAR), 12, '0') AS channel, CAST(720 AS BIGINT) AS rows, round(sum(CASE WHEN date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) BETWEEN 0 AND 719 THEN value ELSE 0 END), 6) + CAST(0 AS DOUBLE) AS total FROM events GROUP BY user_id",
        "smoke_source": "SELECT t, CAST(k AS INT) AS ch, 'x' || k AS channel, round(sin(t / CAST(7 + k AS DOUBLE)) + CAST(0.1 AS DOUBLE) * k * cos(t / CAST(17 + k AS DOUBLE)), 6) + CAST(0 AS DOUBLE) AS v FROM (SELECT unnest(range(0, 720)) AS t), (SELECT unnest(range(0, 4)) AS k)",
        "splits_table": """WITH c AS (SELECT 720 AS n, 24 AS l), b AS (SELECT n, l, CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS tr, CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) AS te FROM c), d AS (SELECT *, n - te - l AS pre FROM b),
x AS (SELECT *, CAST(floor(pre * CAST(0.6 AS DOUBLE)) AS BIGINT) AS f, CAST(floor(pre * CAST(0.2 AS DOUBLE)) AS BIGINT) AS a FROM d)
SELECT 'original_train' AS name, -1 AS block, CAST(0 AS BIGINT) AS "start", tr AS "end" FROM x UNION ALL SELECT 'original_val', -1, tr - l, n - te FROM x UNION ALL SELECT 'original_test', -1, n - te - l, n FROM x UNION ALL SELECT 'pre_test', -1, 0, pre FROM x
UNION ALL SELECT 'train_fit', -1, 0, f FROM x UNION ALL SELECT 'val_alpha', -1, f, f + a FROM x UNION ALL SELECT 'cert', -1, f + a, pre FROM x UNION ALL SELECT 'stability_block', CAST(i AS INT), pre * i // 3, pre * (i + 1) // 3 FROM x, (SELECT unnest(range(0, 3)) AS i)""",
        "cert_blocks": f"{w} SELECT ch, CAST(i AS INT) AS block, count(*) AS n, min(t) AS first, max(t) AS last FROM zp JOIN (SELECT unnest(range(0, 3)) AS i) ON t >= 441 + 111 * i // 3 AND t < 441 + 111 * (i + 1) // 3 GROUP BY 1, 2",
        "split_roles": f"{w} SELECT ch, CASE WHEN t < 331 THEN 'train_fit' WHEN t < 441 THEN 'val_alpha' ELSE 'cert' END AS split, count(*) AS n FROM zp GROUP BY 1, 2",
        "scaler_stats": f"{w} SELECT ch, channel, {r('mean, scale')} FROM sc",
        "scaled_panel": f"{w} SELECT t, ch, channel, {r('z')} FROM zp",
        "lagged_design": f"{w} SELECT a.ch, a.t AS u, a.t - 1 AS origin, {r('a.z').replace('AS z', 'AS y')}, 'own[' || a.ch || ']_lag_' || k AS feature, {r('b.z').replace('AS z', 'AS value')} FROM zp a, (SELECT unnest([1, 2, 3]) AS k) JOIN zp b ON TRUE WHERE b.ch = a.ch AND b.t = a.t - 1 - k AND a.t >= 4",
        "own_source_design": f"{w} SELECT a.ch AS target, s.ch AS source, a.t AS u, {r('a.z').replace('AS z', 'AS y')}, CASE WHEN b.ch = a.ch THEN 'own[' || a.ch || ']_lag_' || k ELSE 'source_' || s.ch || '[' || s.ch || ']_lag_' || k END AS feature, {r('b.z').replace('AS z', 'AS value')} FROM zp a JOIN chs s ON s.ch <> a.ch, (SELECT unnest([1, 2]) AS k) JOIN zp b ON TRUE WHERE a.t >= 441 AND b.t = a.t - 1 - k AND (b.ch = a.ch OR b.ch = s.ch)",
        "ridge_p1_path": f"{w}{PATH} SELECT ch, alpha_idx, alpha, {r('slope, intercept, df, gcv')} FROM pt",
        "ridge_p2_path": w + """, d2 AS (SELECT * FROM (SELECT ch, t AS u, z AS y, lag(z) OVER (PARTITION BY ch ORDER BY t) AS x1, lag(z, 2) OVER (PARTITION BY ch ORDER BY t) AS x2 FROM zp) WHERE x2 IS NOT NULL AND u < 331),
q AS (SELECT ch, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, sum(x1 * x1) - count(*) * avg(x1) * avg(x1) AS a, sum(x2 * x2) - count(*) * avg(x2) * avg(x2) AS c, sum(x1 * x2) - count(*) * avg(x1) * avg(x2) AS b, sum(x1 * y) - count(*) * avg(x1) * avg(y) AS p, sum(x2 * y) - count(*) * avg(x2) * avg(y) AS q FROM d2 GROUP BY ch),
z AS (SELECT *, ((c + alpha) * p - b * q) / ((a + alpha) * (c + alpha) - b * b) AS b1, ((a + alpha) * q - b * p) / ((a + alpha) * (c + alpha) - b * b) AS b2 FROM q, al) """ + f"SELECT ch, alpha_idx, alpha, {r('b1, b2')}, round(my - b1 * m1 - b2 * m2, 6) + CAST(0 AS DOUBLE) AS intercept FROM z",
        "gcv_alpha_p1": f"{w}{GCV} SELECT ch, alpha FROM fg",
        "valgrid_alpha_p1": f"{w}{VAL} SELECT ch, alpha, {r('slope, intercept')} FROM ft",
        "oos_r2": f"{w}{VAL} SELECT lg.ch, count(*) AS n, round(1 - sum(pow(y - slope * x - intercept, 2)) / (count(*) * var_pop(y)), 6) + CAST(0 AS DOUBLE) AS r2 FROM lg JOIN ft ON ft.ch = lg.ch WHERE u >= 441 GROUP BY 1",
        "ols_p1": f"{w} SELECT ch, round(regr_slope(y, x), 6) + CAST(0 AS DOUBLE) AS slope, round(regr_intercept(y, x), 6) + CAST(0 AS DOUBLE) AS intercept, round(regr_r2(y, x), 6) + CAST(0 AS DOUBLE) AS r2 FROM lg WHERE u < 331 GROUP BY ch",
        "residualize_p1": f"{w}, f AS (SELECT ch, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM lg WHERE u < 331 GROUP BY ch) SELECT lg.ch, u, round(y - i - s * x, 6) + CAST(0 AS DOUBLE) AS resid FROM lg JOIN f ON f.ch = lg.ch WHERE u < 331",
        "incremental_r2": f"{w}{PAIRS}, k AS (SELECT target, source, corr(y, x1) AS r1, corr(y, x2) AS r2, corr(x1, x2) AS r12 FROM pr WHERE u < 331 GROUP BY 1, 2) SELECT target, source, round((r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) - r1 * r1, 6) + CAST(0 AS DOUBLE) AS direct, round(pow(r2 - r1 * r12, 2) / (1 - r12 * r12), 6) + CAST(0 AS DOUBLE) AS partial FROM k",
        "innovation_own_p1": f"{w}{GCV} SELECT ch, split, u, {r('y, pred, resid')}, alpha FROM inn",
        "innovation_describe": f"{w}{GCV} SELECT ch, split, count(*) AS n, round(avg(resid), 6) + CAST(0 AS DOUBLE) AS mean, round(stddev_pop(resid), 6) + CAST(0 AS DOUBLE) AS std FROM inn GROUP BY 1, 2",
        "screen_p1": f"{w}{SCREEN} SELECT target, source, alpha_screen, {r('s_screen')} FROM sx",
        "screen_topm": f"{w}{SCREEN} SELECT target, source, screen_rank, screen_rank <= 2 AND NOT isnan(s_screen) AS passed_screen FROM sk",
        "delta_r2_p1": f"{w}{PAIRS}{solved('pr', 'target, source')} SELECT target, source, {r('delta')}, n_cert FROM dl",
        "shift_null_p1": f"{w}{SHIFT} SELECT target, source, {r('delta_true, delta_null_mean, delta_null_std, aligned_gain, p_value')}, delta_true > 0 AND aligned_gain > 0 AS certified_candidate FROM sn",
        "certify_shift_kernel": f"{w}{SHIFT} SELECT target, source, {r('delta_true, delta_null_mean, delta_null_std, aligned_gain, p_value')}, delta_true > 0 AND aligned_gain > 0 AS certified_candidate FROM sn",
        "csv_source": f"{w} SELECT t, ch, channel, {r('v')} FROM panel WHERE t < 552",
        "evidence_matrix": f"{w}{SHIFT} SELECT CAST(t AS INT) AS target, " + ", ".join(f"round(coalesce(max(CASE WHEN source = {j} THEN aligned_gain END), {NAN}), 6) + CAST(0 AS DOUBLE) AS s{j}" for j in range(5)) + " FROM (SELECT unnest(range(0, 5)) AS t) LEFT JOIN sn ON target = t GROUP BY t",
        "gates_guards": f"""WITH l AS (SELECT l_suppkey AS k, count(*) AS n, avg(l_discount) AS d, var_pop(l_quantity) AS v, max(l_tax) AS m FROM lineitem GROUP BY 1),
c AS (SELECT k, CASE WHEN k % 11 = 0 THEN {NAN} WHEN k % 13 = 0 THEN {INF} ELSE d - CAST(0.05 AS DOUBLE) END AS dt, CASE WHEN k % 7 = 0 THEN {NAN} ELSE CAST(0.0501 AS DOUBLE) - d END AS g, CASE WHEN k % 5 = 0 THEN 7 ELSE n END AS n, CASE WHEN k % 17 = 0 THEN 0 ELSE v END AS v, CASE WHEN k % 19 = 0 THEN 0 ELSE m END AS m FROM l),
x AS (SELECT k, isfinite(dt) AND dt > 0 AS a, isfinite(g) AND g > 0 AS b, n < 8 OR v <= 1e-12 AS nz, n < 8 OR m <= 1e-12 AS sz, NOT isfinite(dt) OR NOT isfinite(g) OR n < 8 OR v <= 1e-12 OR m <= 1e-12 AS un FROM c)
SELECT k AS edge, a AS gate_delta_true, b AS gate_aligned_gain, nz AS near_zero_target_variance, sz AS sparse_zero, un AS unstable_metric, a AND b AND NOT un AS certified_candidate FROM x""",
        "bh_global": f"{e}{bh('')} SELECT target, source, fdr_q, fdr_pass, fdr_underpowered FROM fd",
        "bh_per_target": f"{e}{bh('target')} SELECT target, source, fdr_q, fdr_pass, fdr_underpowered FROM fd",
        "stability_select": f"{e}{STABLE} SELECT target, source, {r('stability_fraction')}, stability_fraction >= CAST(0.6 AS DOUBLE) AS stability_pass, 3 AS stability_k, CAST(0.6 AS DOUBLE) AS stability_min_fraction FROM sl",
        "admission": f"WITH {ADMIT.strip()} SELECT target, source, e_certified FROM ad",
        "admission_summary": f"WITH {ADMIT.strip()} SELECT count(*) AS n_edges, count(*) FILTER (NOT isnan(p_value)) AS n_finite_p, " + ", ".join(f"count(*) FILTER ({c}) AS n_{c}" for c in ("certified_candidate", "fdr_pass", "stability_pass", "e_certified", "fdr_underpowered")) + " FROM ad",
        "adjacency_pivot": f"{w}{SHIFT} SELECT CAST(t AS INT) AS target, " + ", ".join(f"round(coalesce(max(CASE WHEN source = {j} AND aligned_gain > 0 THEN aligned_gain END), 0), 6) + CAST(0 AS DOUBLE) AS s{j}" for j in range(5)) + " FROM (SELECT unnest(range(0, 5)) AS t) LEFT JOIN sn ON target = t GROUP BY t",
        "recall_curve": f"{w}{SCREEN}{SHIFT}, h AS (SELECT screen_rank, aligned_gain > 0 AS hit FROM sk JOIN sn ON sn.target = sk.target AND sn.source = sk.source) SELECT CAST(m AS INT) AS m, count(*) FILTER (hit AND screen_rank <= m) AS kept, count(*) FILTER (hit) AS total, round(count(*) FILTER (hit AND screen_rank <= m) / CAST(count(*) FILTER (hit) AS DOUBLE), 6) AS recall, round(1 - count(*) FILTER (screen_rank <= m) / CAST(count(*) AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS reduction FROM h, (SELECT unnest(range(1, 5)) AS m) GROUP BY m",
        "xcorr_absmax": f"{w}, x AS MATERIALIZED (SELECT ch, t, z - avg(z) OVER (PARTITION BY ch) AS x FROM zp), n AS (SELECT ch, sqrt(sum(x * x)) AS n FROM x GROUP BY ch), s AS (SELECT a.ch AS a, b.ch AS b, k, sum(a.x * b.x) AS s FROM x a, (SELECT unnest(range(-24, 25)) AS k) JOIN x b ON TRUE WHERE b.t = a.t - k AND a.ch <> b.ch GROUP BY 1, 2, 3) SELECT a, b, round(max(abs(s)) / (any_value(na.n) * any_value(nb.n)), 6) AS xcorr FROM s JOIN n na ON na.ch = a JOIN n nb ON nb.ch = b GROUP BY 1, 2",
        "power_spectrum": f"{w}, x AS (SELECT ch, t, z AS x FROM zp), f AS ({dft('x', 'ch', 552)}) SELECT ch, CAST(k AS INT) AS k, round(sqrt(re * re + im * im), 4) + CAST(0 AS DOUBLE) AS amplitude FROM f",
        "circular_autocorr": f"{w}, x AS MATERIALIZED (SELECT ch, t, z - avg(z) OVER (PARTITION BY ch) AS x FROM zp) SELECT a.ch, CAST(k AS INT) AS lag, round(sum(a.x * b.x) / sum(a.x * a.x), 6) + CAST(0 AS DOUBLE) AS r FROM x a, (SELECT unnest(range(0, 25)) AS k) JOIN x b ON TRUE WHERE b.ch = a.ch AND b.t = (a.t + k) % 552 GROUP BY 1, 2",
        "coherence_welch": f"{w}{seg}, p AS (SELECT a.ch AS a, b.ch AS b, a.k, avg(a.re * b.re + a.im * b.im) AS re, avg(a.re * b.im - a.im * b.re) AS im, avg(a.re * a.re + a.im * a.im) AS pa, avg(b.re * b.re + b.im * b.im) AS pb FROM ft a JOIN ft b ON a.seg = b.seg AND a.k = b.k AND a.ch < b.ch GROUP BY 1, 2, 3) SELECT a, b, round(avg((re * re + im * im) / (pa * pb)), 4) AS coherence_mean, round(max((re * re + im * im) / (pa * pb)), 4) AS coherence_peak FROM p WHERE pa * pb > 1e-20 GROUP BY 1, 2",
        "spearman_pairs": f"{w}, k AS MATERIALIZED (SELECT ch, t, {ranks.format(k='ch', v='z')} AS r FROM zp) SELECT a.ch AS a, b.ch AS b, round(corr(a.r, b.r), 6) + CAST(0 AS DOUBLE) AS rho FROM k a JOIN k b ON a.t = b.t AND a.ch < b.ch GROUP BY 1, 2",
        "spearman_screen": f"{e}, k AS (SELECT target, {ranks.format(k='target', v='p_value')} AS a, {ranks.format(k='target', v='coherence_peak')} AS b FROM oe WHERE NOT isnan(p_value)) SELECT target, count(*) AS n, round(corr(a, b), 6) + CAST(0 AS DOUBLE) AS rho FROM k GROUP BY 1",
        "ks_uniform": f"{e}, k AS (SELECT target, p_value AS p, row_number() OVER (PARTITION BY target ORDER BY p_value) AS i, CAST(count(*) OVER (PARTITION BY target) AS DOUBLE) AS n FROM oe WHERE NOT isnan(p_value)) SELECT target, count(*) AS n, round(max(greatest(i / n - p, p - (i - 1) / n)), 6) AS ks, round(avg(CASE WHEN p <= CAST(0.05 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS fpr05, round(avg(p), 6) AS mean_p, round(median(p), 6) AS median_p FROM k GROUP BY 1",
        "ecdf": f"{e} SELECT edge_type, round(p_value, 6) AS x, round(row_number() OVER (PARTITION BY edge_type ORDER BY p_value) / CAST(count(*) OVER (PARTITION BY edge_type) AS DOUBLE), 6) AS y FROM oe WHERE NOT isnan(p_value)",
        "recovery_summary": f"{e}, s AS (SELECT edge_type, count(*) AS n, avg(delta_true) AS a, avg(aligned_gain) AS b, median(p_value) AS c, avg(CASE WHEN certified_candidate AND NOT isnan(p_value) AND p_value <= CAST(0.1 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE 0 END) AS d FROM oe GROUP BY 1) SELECT place, o.edge_type, coalesce(n, 0) AS n, " + ", ".join(f"round(coalesce({x}, {NAN}), 6) + CAST(0 AS DOUBLE) AS {y}" for x, y in (("a", "mean_delta"), ("b", "mean_gain"), ("c", "median_p"), ("d", "admitted_rate"))) + " FROM (VALUES (0, 'TRUE'), (1, 'NULL'), (2, 'DECOY'), (3, 'NONE')) o(place, edge_type) LEFT JOIN s ON s.edge_type = o.edge_type",
        "top_rejected": f"{e} SELECT target, source, {r('coherence_peak, aligned_gain, p_value')} FROM oe WHERE NOT certified_candidate ORDER BY oe.coherence_peak DESC, target, source LIMIT 3",
        "direction_asymmetry": f"{w}{SHIFT} SELECT a.target AS i, a.source AS j, round(abs(a.aligned_gain - b.aligned_gain), 6) AS diff, round(a.aligned_gain, 6) + CAST(0 AS DOUBLE) AS gain_ij, round(b.aligned_gain, 6) + CAST(0 AS DOUBLE) AS gain_ji FROM sn a JOIN sn b ON a.target = b.source AND a.source = b.target AND a.target < a.source ORDER BY abs(a.aligned_gain - b.aligned_gain) DESC, 1 DESC, 2 DESC LIMIT 3",
    }
