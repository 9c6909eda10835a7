"""Information, complexity and dependence measures: one belief a series."""

from __future__ import annotations

from ..catalog import sql_query
from ..sources.tables import OBS_DAY, OBS_DIFF, OBS_EVENTS, PANEL
from .forecasts import r


def measure(name: str, sql: str, doc: str, source: str = OBS_EVENTS) -> None:
    sql_query(name, f"WITH {source}{sql}", doc, layer="signal")


def codes(k: int, column: str = "x0", table: str = "obs") -> str:
    """Code of each value among k quantile bins: how many inner edges are at most the value."""
    edges = ", ".join(f"@pct({column}, {i / k}) AS e{i}" for i in range(1, k))
    terms = " + ".join(f"CASE WHEN o.{column} >= e{i} THEN 1 ELSE 0 END" for i in range(1, k))
    return f", edges AS (SELECT series_id, {edges} FROM {table} GROUP BY series_id), s AS (SELECT o.series_id, o.t, {terms} AS s FROM {table} o JOIN edges e ON o.series_id = e.series_id), p AS (SELECT series_id, t, s, lag(s) OVER (PARTITION BY series_id ORDER BY t) AS q, lag(s, 2) OVER (PARTITION BY series_id ORDER BY t) AS q2 FROM s)"


H_S = ", hs AS (SELECT series_id, -sum(f * log2(f)) AS h FROM (SELECT series_id, count(*) / sum(count(*)) OVER (PARTITION BY series_id) AS f FROM p WHERE q IS NOT NULL GROUP BY series_id, s) z GROUP BY series_id)"
H_Q = ", hq AS (SELECT series_id, -sum(f * log2(f)) AS h FROM (SELECT series_id, count(*) / sum(count(*)) OVER (PARTITION BY series_id) AS f FROM p WHERE q IS NOT NULL GROUP BY series_id, q) z GROUP BY series_id)"
H_J = ", hj AS (SELECT series_id, -sum(f * log2(f)) AS h FROM (SELECT series_id, count(*) / sum(count(*)) OVER (PARTITION BY series_id) AS f FROM p WHERE q IS NOT NULL GROUP BY series_id, s, q) z GROUP BY series_id)"
measure("mutual_information", codes(5) + H_S + H_Q + H_J + f" SELECT hs.series_id, {r('hs.h + hq.h - hj.h', 'mutual_information')}, {r('(hs.h + hq.h - hj.h) / (hs.h + 1e-12)', 'normalized')} FROM hs JOIN hq ON hs.series_id = hq.series_id JOIN hj ON hs.series_id = hj.series_id", "Bits shared by a value and the one before, on 5 quantile bins.")
measure("conditional_entropy", codes(5) + H_Q + H_J + f" SELECT hq.series_id, {r('hj.h - hq.h', 'conditional_entropy')} FROM hq JOIN hj ON hq.series_id = hj.series_id", "Bits of a value given the one before.")
measure("cross_entropy", codes(6) + f", n AS (SELECT series_id, count(*) AS n FROM obs GROUP BY series_id), g AS (SELECT n.series_id, @rows(0, 5)) AS s FROM n), c AS (SELECT g.series_id, g.s, count_if(s.t < n / 2) + 1 AS a, count_if(s.t >= n / 2) + 1 AS b FROM g JOIN n ON g.series_id = n.series_id LEFT JOIN s ON g.series_id = s.series_id AND g.s = s.s GROUP BY g.series_id, g.s), f AS (SELECT series_id, a / sum(a) OVER (PARTITION BY series_id) AS a, b / sum(b) OVER (PARTITION BY series_id) AS b FROM c) SELECT series_id, {r('-sum(a * log2(b))', 'cross_entropy')}, {r('sum(a * log2(a / b))', 'kl_divergence')} FROM f GROUP BY series_id", "First against second half, on 6 bins with one count added to each.")
measure("mdl_complexity", codes(4) + H_S + H_Q + H_J + f", n AS (SELECT series_id, count(*) AS n FROM obs GROUP BY series_id), b AS (SELECT n.series_id, n * hs.h + 1.5 * log2(n) AS b0, n * (hj.h - hq.h) + 6 * log2(n) AS b1 FROM n JOIN hs ON n.series_id = hs.series_id JOIN hq ON n.series_id = hq.series_id JOIN hj ON n.series_id = hj.series_id) SELECT series_id, CASE WHEN b0 <= b1 THEN 0 ELSE 1 END AS mdl_order, {r('least(b0, b1)', 'description_length')} FROM b", "Bits of the data and half a log n for each parameter, for orders 0 and 1 on 4 bins.")
measure("transfer_entropy", f""", edges AS (SELECT series_id, @pct(x0, 0.5) AS a, @pct(x1, 0.5) AS b FROM obs GROUP BY series_id), s AS (SELECT o.series_id, t, CASE WHEN x0 >= a THEN 1 ELSE 0 END AS x, CASE WHEN x1 >= b THEN 1 ELSE 0 END AS y FROM obs o JOIN edges e ON o.series_id = e.series_id),
j AS (SELECT series_id, x, lag(x) OVER w AS xp, lag(y) OVER w AS yp FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)), c AS (SELECT series_id, x, xp, yp, count(*) AS n FROM j WHERE xp IS NOT NULL GROUP BY series_id, x, xp, yp),
k AS (SELECT *, sum(n) OVER (PARTITION BY series_id) AS total, sum(n) OVER (PARTITION BY series_id, xp, yp) AS np, sum(n) OVER (PARTITION BY series_id, x, xp) AS nx, sum(n) OVER (PARTITION BY series_id, xp) AS nxp FROM c)
SELECT series_id, {r('sum(n / total * log2((n / np) / (nx / nxp)))', 'te_y_to_x')} FROM k GROUP BY series_id""", "Bits that the other column's past adds about the next value, on halves at the median.", OBS_DAY)
measure("permutation_entropy", f""", e AS (SELECT series_id, x0 AS a, lead(x0, 1) OVER w AS b, lead(x0, 2) OVER w AS c FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY t)), q AS (SELECT series_id, (CASE WHEN a <= b THEN 4 ELSE 0 END) + (CASE WHEN b <= c THEN 2 ELSE 0 END) + (CASE WHEN a <= c THEN 1 ELSE 0 END) AS p FROM e WHERE c IS NOT NULL)
SELECT series_id, {r('-sum(f * ln(f)) / ln(6)', 'permutation_entropy')} FROM (SELECT series_id, count(*) / sum(count(*)) OVER (PARTITION BY series_id) AS f FROM q GROUP BY series_id, p) z GROUP BY series_id""", "Entropy of the orders of three values, out of the greatest.")
measure("tsallis_entropy", f""", m AS (SELECT series_id, min(dx) AS lo, max(dx) AS hi, least(20, greatest(3, floor(count(dx) / 5))) AS k FROM d GROUP BY series_id), b AS (SELECT d.series_id, least(k - 1, floor((dx - lo) / ((hi - lo) / k + 1e-300))) AS b FROM d JOIN m ON d.series_id = m.series_id WHERE dx IS NOT NULL)
SELECT series_id, {r('1 - sum(f * f)', 'tsallis_entropy')} FROM (SELECT series_id, count(*) / sum(count(*)) OVER (PARTITION BY series_id) AS f FROM b GROUP BY series_id, b) z GROUP BY series_id""", "Entropy of order 2 of a histogram of the steps.", OBS_DIFF)
measure("autocorr_period", f""", c AS (SELECT series_id, t, x0 - avg(x0) OVER (PARTITION BY series_id) AS x FROM obs), a AS (SELECT p.series_id, q.t - p.t AS k, sum(p.x * q.x) AS ac FROM c p JOIN c q ON p.series_id = q.series_id AND p.t <= q.t GROUP BY p.series_id, q.t - p.t), n AS (SELECT series_id, k, ac / max(CASE WHEN k = 0 THEN ac END) OVER (PARTITION BY series_id) AS ac FROM a), l AS (SELECT series_id, k, ac, lag(ac) OVER w AS b, lead(ac) OVER w AS f FROM n WINDOW w AS (PARTITION BY series_id ORDER BY k))
SELECT series_id, min(k) AS period, {r('greatest(0, min_by(ac, k))', 'confidence')} FROM l WHERE k > 0 AND ac > b AND ac > f GROUP BY series_id""", "The lag of the first local maximum of the autocorrelation.")
measure("recurrence_rate", f""", e AS (SELECT series_id, t, x0 AS a, lead(x0, 1) OVER w AS b, lead(x0, 2) OVER w AS c FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY t)), r AS (SELECT series_id, 0.2 * stddev_pop(x0) AS r FROM obs GROUP BY series_id)
SELECT p.series_id, {r('avg(CASE WHEN sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c)) < r THEN 1.0 ELSE 0.0 END)', 'recurrence_rate')} FROM e p JOIN e q ON p.series_id = q.series_id AND p.t < q.t JOIN r ON p.series_id = r.series_id WHERE p.c IS NOT NULL AND q.c IS NOT NULL GROUP BY p.series_id""", "Share of pairs of embedded rows nearer than a fifth of a deviation.")
measure("sample_entropy", f""", e AS (SELECT series_id, t, x0 AS a, lead(x0, 1) OVER w AS b, lead(x0, 2) OVER w AS c FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY t)), r AS (SELECT series_id, 0.2 * stddev_pop(x0) AS r FROM obs GROUP BY series_id),
m AS (SELECT p.series_id, sum(CASE WHEN greatest(abs(p.a - q.a), abs(p.b - q.b)) <= r THEN 1 ELSE 0 END) AS b, sum(CASE WHEN greatest(abs(p.a - q.a), abs(p.b - q.b), abs(p.c - q.c)) <= r THEN 1 ELSE 0 END) AS a FROM e p JOIN e q ON p.series_id = q.series_id AND p.t < q.t JOIN r ON p.series_id = r.series_id WHERE p.c IS NOT NULL AND q.c IS NOT NULL GROUP BY p.series_id)
SELECT series_id, cast(b AS bigint) AS near_pairs, cast(a AS bigint) AS near_triples, {r('CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) ELSE 0 END', 'sample_entropy')} FROM m""", "How seldom pairs that stay near for two rows do so for a third.")
measure("phase_space_takens", f""", e AS (SELECT series_id, t, x0 AS a, lead(x0, 1) OVER w AS b, lead(x0, 2) OVER w AS c FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY t)), g AS (SELECT p.series_id, sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c)) AS d FROM e p JOIN e q ON p.series_id = q.series_id AND p.t < q.t WHERE p.c IS NOT NULL AND q.c IS NOT NULL),
k AS (SELECT series_id, @pct(d, 0.1) AS r1, @pct(d, 0.3) AS r2, @pct(d, 0.5) AS r3, @pct(d, 0.7) AS r4 FROM g GROUP BY series_id), h AS (SELECT g.series_id, avg(CASE WHEN d < r1 THEN 1.0 ELSE 0.0 END) AS c1, avg(CASE WHEN d < r2 THEN 1.0 ELSE 0.0 END) AS c2, avg(CASE WHEN d < r3 THEN 1.0 ELSE 0.0 END) AS c3, avg(CASE WHEN d < r4 THEN 1.0 ELSE 0.0 END) AS c4, max(r1) AS r1, max(r2) AS r2, max(r3) AS r3, max(r4) AS r4 FROM g JOIN k ON g.series_id = k.series_id GROUP BY g.series_id),
v AS (SELECT series_id, ln(c1) AS y, ln(r1) AS x FROM h UNION ALL SELECT series_id, ln(c2) AS y, ln(r2) AS x FROM h UNION ALL SELECT series_id, ln(c3) AS y, ln(r3) AS x FROM h UNION ALL SELECT series_id, ln(c4) AS y, ln(r4) AS x FROM h) SELECT series_id, {r('regr_slope(y, x)', 'correlation_dimension')} FROM v GROUP BY series_id""", "Correlation dimension: slope of the log share of near pairs at four radii.")
measure("rough_volatility", f""", k AS (SELECT p.series_id, q.t - p.t AS k, avg((q.x0 - p.x0) * (q.x0 - p.x0)) AS v FROM obs p JOIN obs q ON p.series_id = q.series_id AND q.t - p.t IN (1, 2, 3, 5, 8, 13, 21) GROUP BY p.series_id, q.t - p.t) SELECT series_id, {r('regr_slope(ln(v), ln(k)) / 2', 'level_hurst')}, CASE WHEN regr_slope(ln(v), ln(k)) / 2 < 0.4 THEN 1 ELSE 0 END AS is_rough FROM k GROUP BY series_id""", "Hurst exponent from the variogram of the level.")
measure("hurst_exponent", f""", z AS (SELECT o.series_id, t, x0, z.size, floor(t / z.size) AS chunk, count(*) OVER (PARTITION BY o.series_id) AS n FROM obs o CROSS JOIN (SELECT 8 AS size UNION ALL SELECT 16 AS size UNION ALL SELECT 32 AS size) z), c AS (SELECT *, x0 - avg(x0) OVER (PARTITION BY series_id, size, chunk) AS y, stddev_pop(x0) OVER (PARTITION BY series_id, size, chunk) AS s, count(*) OVER (PARTITION BY series_id, size, chunk) AS m FROM z), w AS (SELECT *, sum(y) OVER (PARTITION BY series_id, size, chunk ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs FROM c WHERE m = size),
g AS (SELECT series_id, size, chunk, (max(cs) - min(cs)) / max(s) AS rs FROM w WHERE s > 0 GROUP BY series_id, size, chunk), a AS (SELECT series_id, size, avg(rs) AS rs FROM g GROUP BY series_id, size) SELECT series_id, {r('least(1, greatest(0, regr_slope(ln(rs), ln(size))))', 'hurst')} FROM a GROUP BY series_id HAVING count(*) > 1""", "Rescaled range over chunks of 8, 16 and 32 rows.")
measure("infogeom_distance", f""", g AS (SELECT series_id, floor(t / 15) AS k, avg(x0) AS m, stddev_pop(x0) + 1e-9 AS s, count(*) AS c FROM obs GROUP BY series_id, floor(t / 15)), l AS (SELECT series_id, k, m, s, lag(m) OVER (PARTITION BY series_id ORDER BY k) AS pm, lag(s) OVER (PARTITION BY series_id ORDER BY k) AS ps FROM g WHERE c = 15), f AS (SELECT series_id, sqrt(2) * acosh(1 + ((m - pm) * (m - pm) / 2 + (s - ps) * (s - ps)) / (2 * s * ps)) AS f FROM l WHERE pm IS NOT NULL) SELECT series_id, {r('max(f)', 'max_distance')}, {r('avg(f)', 'mean_distance')} FROM f GROUP BY series_id""", "Fisher-Rao distance between the normal laws of neighbouring windows of 15 rows.")
measure("hawkes_intensity", f""", m AS (SELECT series_id, avg(abs(dx)) + 2 * stddev_pop(abs(dx)) AS cut FROM d WHERE dx IS NOT NULL GROUP BY series_id), c AS (SELECT d.series_id, floor((t - 1) * 5 / (n - 1)) AS b, sum(CASE WHEN abs(dx) > cut THEN 1 ELSE 0 END) AS k FROM d JOIN m ON d.series_id = m.series_id WHERE dx IS NOT NULL GROUP BY d.series_id, floor((t - 1) * 5 / (n - 1))) SELECT series_id, cast(sum(k) AS bigint) AS n_events, {r('var_pop(k) / (avg(k) + 1e-12)', 'fano')} FROM c GROUP BY series_id""", "Variance over mean of the counts of large steps in fifths of the series.", OBS_DIFF)
measure("quadratic_hawkes", f""", v AS (SELECT series_id, t, dx * dx AS v, lag(dx * dx) OVER (PARTITION BY series_id ORDER BY t) AS p FROM d) SELECT series_id, {r('least(1, greatest(0, regr_slope(v, p)))', 'quadratic_feedback')} FROM v WHERE p IS NOT NULL GROUP BY series_id""", "Feedback of squared steps on the next.", OBS_DIFF)
measure("soc_criticality", f""", q AS (SELECT series_id, @pct(abs(dx), 0.9) AS cut FROM d WHERE dx IS NOT NULL GROUP BY series_id), e AS (SELECT d.series_id, t, abs(dx) - cut AS x, CASE WHEN abs(dx) > cut THEN 1 ELSE 0 END AS on_ FROM d JOIN q ON d.series_id = q.series_id WHERE dx IS NOT NULL), g AS (SELECT *, t - row_number() OVER (PARTITION BY series_id, on_ ORDER BY t) AS run FROM e), a AS (SELECT series_id, run, sum(x) AS size FROM g WHERE on_ = 1 GROUP BY series_id, run) SELECT series_id, count(*) AS n_avalanches, {r('max(size) / median(size)', 'heaviness')}, {r('1 + count(*) / (sum(ln(size)) - count(*) * ln(min(size)) + 1e-12)', 'exponent', 4)} FROM a GROUP BY series_id""", "Runs of steps beyond their 0.9 quantile as avalanches.", OBS_DIFF)
measure("copula_dependence", f""", k AS (SELECT rank() OVER (ORDER BY x0) + (count(*) OVER (PARTITION BY x0) - 1) / 2.0 AS a, rank() OVER (ORDER BY x1) + (count(*) OVER (PARTITION BY x1) - 1) / 2.0 AS b FROM obs) SELECT {r('corr(a, b)', 'spearman_rho')} FROM k""", "Rank correlation with mean ranks of ties; one series of days.", OBS_DAY)
measure("kendall_tau", f""", s AS (SELECT * FROM obs WHERE t % 5 = 0), c AS (SELECT sum(sign(a.x0 - b.x0) * sign(a.x1 - b.x1)) AS c, count(*) AS n FROM s a JOIN s b ON a.t < b.t) SELECT {r('c / n', 'kendall_tau')}, {r('sin(pi() * c / n / 2)', 'rho_gaussian_copula')} FROM c""".replace(", s AS (SELECT * FROM obs WHERE t % 5 = 0)", "").replace("FROM s a JOIN s b", "FROM obs a JOIN obs b"), "Concordance of all pairs of days.", OBS_DAY)
measure("tail_dependence", f""", q AS (SELECT @pct(x0, 0.9) AS a, @pct(x1, 0.9) AS b, @pct(x0, 0.1) AS c, @pct(x1, 0.1) AS d FROM obs) SELECT {r('count_if(x0 > a AND x1 > b) / (0.1 * count(*))', 'tail_dep_upper')}, {r('count_if(x0 < c AND x1 < d) / (0.1 * count(*))', 'tail_dep_lower')} FROM obs CROSS JOIN q""", "Joint exceedances of the 0.9 and 0.1 quantiles.", OBS_DAY)
measure("hill_tail_index", f""", k AS (SELECT series_id, ln(abs(dx)) AS l, row_number() OVER (PARTITION BY series_id ORDER BY abs(dx) DESC, t) AS k, n FROM d WHERE dx != 0), m AS (SELECT series_id, avg(CASE WHEN k <= greatest(2, floor(n * 0.1)) THEN l END) - max(CASE WHEN k = greatest(2, floor(n * 0.1)) + 1 THEN l END) AS h FROM k GROUP BY series_id) SELECT series_id, {r('h', 'xi')}, {r('1 / (h + 1e-12)', 'tail_index', 4)} FROM m""", "Hill's index of the largest tenth of the steps.", OBS_DIFF)
measure("evt_tail_risk", f""", s AS (SELECT series_id, t, abs(dx) AS a, n FROM d WHERE dx IS NOT NULL), q AS (SELECT series_id, @pct(a, 0.9) AS u, @pct(a, 0.99) AS q99, count(*) AS n FROM s GROUP BY series_id),
e AS (SELECT s.series_id, max(u) AS u, max(q99) AS q99, max(q.n) AS n, count(CASE WHEN a > u THEN a END) AS k, avg(CASE WHEN a > u THEN a - u END) AS m, var_pop(CASE WHEN a > u THEN a - u END) AS v, avg(CASE WHEN a >= q99 THEN a END) AS beyond FROM s JOIN q ON s.series_id = q.series_id GROUP BY s.series_id),
x AS (SELECT *, CASE WHEN k > 2 AND v > 1e-18 THEN least(0.49, greatest(-0.5, 0.5 * (1 - @over(m * m, v)))) ELSE 0 END AS xi FROM e), b AS (SELECT *, coalesce(m, 0) * (1 - xi) AS beta FROM x),
p AS (SELECT *, CASE WHEN k <= 2 THEN q99 WHEN abs(xi) < 1e-4 THEN u - beta * ln(n / (100 * greatest(k, 1))) ELSE u + @over(beta, xi) * (power(n / (100 * greatest(k, 1)), -xi) - 1) END AS level FROM b),
l AS (SELECT series_id, ln(a) AS l, row_number() OVER (PARTITION BY series_id ORDER BY a DESC, t) AS k, n FROM s WHERE a > 0), h AS (SELECT series_id, avg(CASE WHEN k <= greatest(2, floor(n * 0.1)) THEN l END) - max(CASE WHEN k = greatest(2, floor(n * 0.1)) + 1 THEN l END) AS h FROM l GROUP BY series_id)
SELECT p.series_id, k AS n_exceedances, {r('u', 'threshold')}, {r('xi', 'xi')}, {r('beta', 'beta')}, {r('level', 'var_99')}, {r('greatest(level, CASE WHEN k <= 2 THEN beyond ELSE (level + beta - xi * u) / (1 - xi) END)', 'es_99')}, {r('1 / CASE WHEN h > 1e-12 THEN h END', 'tail_index', 4)} FROM p LEFT JOIN h ON p.series_id = h.series_id""", "Generalised Pareto law of steps beyond their 0.9 quantile, by moments, the value at risk and expected shortfall at 0.99 that it gives, and Hill's index. Where at most two steps are beyond, the law is exponential and both are the steps' own.", OBS_DIFF)
measure("vpin", f""", f AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, coalesce(abs(value), 0) AS volume, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE -1 END AS side FROM events),
c AS (SELECT series_id, volume, side, sum(volume) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(volume) OVER (PARTITION BY series_id) / 10 AS size FROM f),
p AS (SELECT series_id, side, cum - volume AS low, cum AS high, size, CASE WHEN size > 0 THEN least(9, greatest(0, cast(floor(@over((cum - volume), size)) AS int))) ELSE 0 END AS i, CASE WHEN size > 0 THEN least(9, greatest(0, cast(ceil(@over(cum, size)) AS int) - 1)) ELSE 0 END AS j FROM c),
k AS (SELECT series_id, side, low, high, size, @rows(i, greatest(i, j))) AS k FROM p), b AS (SELECT series_id, k, sum(side * greatest(0, least(high, (k + 1) * size) - greatest(low, k * size))) AS net, max(size) AS size FROM k GROUP BY series_id, k)
SELECT series_id, count(CASE WHEN size > 0 THEN k END) AS n_buckets, {r('avg(CASE WHEN size > 0 THEN @over(abs(net), size) ELSE 0 END)', 'mean_vpin')} FROM b GROUP BY series_id""", "Imbalance of buys over ten buckets of equal volume; a row that passes a bucket's end is split between the buckets it fills.")
measure("percolation_risk", ", c AS (" + " UNION ALL ".join(f"SELECT abs(corr(a{i}, a{j})) AS c FROM panel" for i in range(1, 6) for j in range(i + 1, 6)) + f"), k AS (SELECT @rows(1, 9)) AS k), g AS (SELECT k / 10.0 AS cut FROM k) SELECT round(cut, 2) AS threshold, cast(count_if(c > cut) AS bigint) AS edges, {r('count_if(c > cut) / 10', 'density')} FROM c CROSS JOIN g GROUP BY cut", "Edges of the correlation graph of five assets by threshold.", PANEL)
measure("semi_markov", codes(4) + f", g AS (SELECT series_id, t, s, t - row_number() OVER (PARTITION BY series_id, s ORDER BY t) AS run FROM s), u AS (SELECT series_id, s, run, count(*) AS len FROM g GROUP BY series_id, s, run) SELECT series_id, s AS state, count(*) AS runs, {r('avg(len)', 'expected_duration')} FROM u GROUP BY series_id, s", "Runs and mean dwell of four quantile states.")
measure("higher_order_markov", codes(4) + f" SELECT series_id, q2, q, s AS next, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY series_id, q2, q)', 'p')} FROM p WHERE q2 IS NOT NULL GROUP BY series_id, q2, q, s", "Transition table of order 2 on four quantile states.")
measure("markov_chain", codes(3) + f", g AS (SELECT series_id, q, s, count(*) AS n FROM p WHERE q IS NOT NULL GROUP BY series_id, q, s) SELECT series_id, q AS state, s AS next, {r('(n + 1) / (sum(n) OVER (PARTITION BY series_id, q) + 3)', 'p')} FROM g", "Transitions seen between three quantile states, with one count added.")
measure("dynamic_bayesian_network", codes(4) + ", l AS (SELECT series_id, max_by(s, t) AS s FROM s GROUP BY series_id), g AS (SELECT p.series_id, p.s, count(*) AS n FROM p JOIN l ON p.series_id = l.series_id AND p.q = l.s GROUP BY p.series_id, p.s) SELECT series_id, min_by(s, -n * 10 + s) AS next_state, max(n) AS seen FROM g GROUP BY series_id", "The state that most often followed the last one.")
measure("fuzzy_ts", f""", m AS (SELECT series_id, min(x0) - 0.1 * (max(x0) - min(x0)) AS lo, 1.2 * (max(x0) - min(x0)) AS w, least(30, greatest(5, round(sqrt(count(*))))) AS k FROM obs GROUP BY series_id), c AS (SELECT o.series_id, t, floor((x0 - lo) / (w / k + 1e-300)) AS c, lo, w / k AS step FROM obs o JOIN m ON o.series_id = m.series_id), n AS (SELECT series_id, t, c, lo, step, lead(c) OVER (PARTITION BY series_id ORDER BY t) AS f FROM c), l AS (SELECT series_id, max_by(c, t) AS c FROM c GROUP BY series_id), g AS (SELECT DISTINCT n.series_id, n.f, n.lo, n.step FROM n JOIN l ON n.series_id = l.series_id AND n.c = l.c WHERE n.f IS NOT NULL) SELECT series_id, {r('avg(lo + (f + 0.5) * step)', 'estimate')} FROM g GROUP BY series_id""", "Mean midpoint of the sets that followed the last value's set.")
measure("fft_dominant", f""", c AS (SELECT series_id, t, x0 - avg(x0) OVER (PARTITION BY series_id) AS x, count(*) OVER (PARTITION BY series_id) AS n FROM obs), k AS (SELECT c.*, @rows(1, cast(floor(n / 2) AS int))) AS k FROM c), s AS (SELECT series_id, k, max(n) AS n, power(sum(x * cos(2 * pi() * k * t / n)), 2) + power(sum(x * sin(2 * pi() * k * t / n)), 2) AS e FROM k GROUP BY series_id, k) SELECT series_id, {r('max_by(k / n, e)', 'dominant_freq')}, {r('max(e) / sum(e)', 'confidence')}, {r('-sum(e * ln(e)) / sum(e) + ln(sum(e))', 'spectral_entropy', 4)} FROM s WHERE e > 1e-9 GROUP BY series_id""", "Discrete Fourier transform by sums: the strongest frequency, its share of the energy, and the entropy of all.")
