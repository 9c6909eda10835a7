"""Anomaly detectors: a score and a 0/1 flag for each row."""

from __future__ import annotations

from ..catalog import sql_query
from ..sources.tables import OBS_DAY, OBS_DIFF, OBS_EVENTS


def detector(name: str, body: str, doc: str, source: str = OBS_EVENTS, spark_source: str | None = None) -> None:
    """body: a query over obs with columns series_id, t, score, flag (a condition). spark_source: the same tables by another plan."""

    def both(name: str, doc: str, select: str, group: str = "") -> None:
        sql = [f"WITH {tables}, scored AS ({body}) SELECT series_id, {select} FROM scored{group}" for tables in (source, spark_source or source)]
        sql_query(name, sql[0], doc, spark_sql=sql[1], layer="noise")

    both(name, doc, "t, round(score + 0.0, 6) AS score, CASE WHEN flag THEN 1 ELSE 0 END AS flag")
    both(f"{name}_belief", doc + " As one belief a series.", "cast(sum(CASE WHEN flag THEN 1 ELSE 0 END) AS bigint) AS n_anomalies, round(avg(CASE WHEN flag THEN 1.0 ELSE 0.0 END), 6) AS fraction, round(least(1.0, 3 * avg(CASE WHEN flag THEN 1.0 ELSE 0.0 END)), 6) AS confidence", " GROUP BY series_id")


detector("zscore_anomaly", "SELECT series_id, t, z AS score, z > 3 AS flag FROM (SELECT series_id, t, abs(x0 - avg(x0) OVER (PARTITION BY series_id)) / (stddev_pop(x0) OVER (PARTITION BY series_id) + 1e-9) AS z FROM obs) q", "More than three deviations from the mean.")
detector("mad_anomaly", "SELECT o.series_id, o.t, 0.6745 * abs(o.x0 - m.med) / (d.mad + 1e-9) AS score, 0.6745 * abs(o.x0 - m.med) / (d.mad + 1e-9) > 3.5 AS flag FROM obs o JOIN (SELECT series_id, median(x0) AS med FROM obs GROUP BY series_id) m ON o.series_id = m.series_id JOIN (SELECT o2.series_id, median(abs(o2.x0 - m2.med)) AS mad FROM obs o2 JOIN (SELECT series_id, median(x0) AS med FROM obs GROUP BY series_id) m2 ON o2.series_id = m2.series_id GROUP BY o2.series_id) d ON o.series_id = d.series_id", "Robust z score from the median and the median absolute deviation over 3.5.")
detector("iqr_anomaly", "SELECT o.series_id, t, greatest(0, greatest(q1 - 1.5 * iqr - x0, x0 - q3 - 1.5 * iqr) / iqr) AS score, x0 < q1 - 1.5 * iqr OR x0 > q3 + 1.5 * iqr AS flag FROM obs o JOIN (SELECT series_id, @pct(x0, 0.25) AS q1, @pct(x0, 0.75) AS q3, @pct(x0, 0.75) - @pct(x0, 0.25) + 1e-9 AS iqr FROM obs GROUP BY series_id) f ON o.series_id = f.series_id", "Beyond the quartiles by 1.5 times their distance.")
detector("histogram_anomaly", "SELECT h.series_id, h.t, h.s AS score, h.s > q.cut AS flag FROM hist h JOIN (SELECT series_id, @pct(s, 0.95) AS cut FROM hist GROUP BY series_id) q ON h.series_id = q.series_id", "Low density in a histogram of 10 bins: over the 0.95 quantile of minus log density.", OBS_EVENTS + """, lim AS (SELECT series_id, min(x0) AS lo, max(x0) AS hi, count(*) AS n FROM obs GROUP BY series_id),
bins AS (SELECT o.series_id, o.t, lo, hi, n, least(9, floor((x0 - lo) / ((hi - lo) / 10 + 1e-300))) AS b FROM obs o JOIN lim l ON o.series_id = l.series_id),
hist AS (SELECT series_id, t, -ln(count(*) OVER (PARTITION BY series_id, b) / (n * ((hi - lo) / 10 + 1e-300)) + 1e-9) AS s FROM bins)""")
detector("jump_detector", "SELECT d.series_id, d.t, abs(coalesce(dx, 0) - m) / (s + 1e-9) AS score, abs(coalesce(dx, 0) - m) > 4 * (s + 1e-9) AS flag FROM d JOIN (SELECT series_id, avg(dx) AS m, stddev_pop(dx) AS s FROM d GROUP BY series_id) g ON d.series_id = g.series_id", "Changes more than four deviations from the mean change.", OBS_DIFF)
detector("mahalanobis_anomaly", "SELECT s.series_id, s.t, s.m AS score, s.m > c.cut AS flag FROM maha s JOIN (SELECT series_id, @pct(m, 0.975) AS cut FROM maha GROUP BY series_id) c ON s.series_id = c.series_id", "Distance by the inverse covariance of two columns, over its own 0.975 quantile.", OBS_DAY + """, mom AS (SELECT series_id, avg(x0) AS m0, avg(x1) AS m1, var_samp(x0) AS a, var_samp(x1) AS b, covar_samp(x0, x1) AS c FROM obs GROUP BY series_id),
maha AS (SELECT o.series_id, o.t, sqrt((b * (x0 - m0) * (x0 - m0) - 2 * c * (x0 - m0) * (x1 - m1) + a * (x1 - m1) * (x1 - m1)) / (a * b - c * c)) AS m FROM obs o JOIN mom ON o.series_id = mom.series_id)""")
detector("pca_residual_anomaly", "SELECT p.series_id, p.t, p.r AS score, p.r > c.cut AS flag FROM pca p JOIN (SELECT series_id, @pct(r, 0.95) AS cut FROM pca GROUP BY series_id) c ON p.series_id = c.series_id", "Mean absolute residual of the first principal component of two standardised columns, over its 0.95 quantile.", OBS_DAY + """, mom AS (SELECT series_id, avg(x0) AS m0, avg(x1) AS m1, stddev_pop(x0) AS s0, stddev_pop(x1) AS s1 FROM obs GROUP BY series_id),
pca AS (SELECT o.series_id, o.t, abs((x0 - m0) / s0 - (x1 - m1) / s1) / 2 AS r FROM obs o JOIN mom ON o.series_id = mom.series_id)""")
# Spark adds the kernels of a row in order of t, whatever the plan: equal values have equal densities, and the quantile sees the numbers that the rows have.
detector("kde_anomaly", "SELECT k.series_id, k.t, -ln(k.p) AS score, k.p < c.cut AS flag FROM kde k JOIN (SELECT series_id, @pct(p, 0.05) AS cut FROM kde GROUP BY series_id) c ON k.series_id = c.series_id", "Gaussian kernel density (Scott's width) below its 0.05 quantile; pairs stay inside a series.", OBS_EVENTS + """, bw AS (SELECT series_id, stddev_samp(x0) * power(count(*), -0.2) AS h, count(*) AS n FROM obs GROUP BY series_id),
kde AS (SELECT a.series_id, a.t, sum(exp(-0.5 * (a.x0 - b.x0) * (a.x0 - b.x0) / (h * h))) / (max(n) * max(h) * sqrt(2 * pi())) AS p FROM obs a JOIN obs b ON a.series_id = b.series_id JOIN bw ON a.series_id = bw.series_id GROUP BY a.series_id, a.t)""", OBS_EVENTS + """, bw AS (SELECT series_id, stddev_samp(x0) * power(count(*), -0.2) AS h, count(*) AS n, array_sort(collect_list(struct(t, x0))) AS of_ FROM obs GROUP BY series_id),
kde AS (SELECT series_id, k.t AS t, k.p AS p FROM (SELECT series_id, explode(transform(of_, a -> struct(a.t AS t, CASE WHEN h = 0 THEN double('NaN') ELSE aggregate(of_, 0D, (s, b) -> s + exp(-0.5 * (a.x0 - b.x0) * (a.x0 - b.x0) / (h * h))) / (n * h * sqrt(2 * pi())) END AS p))) AS k FROM bw) q)""")
detector("knn_distance_anomaly", "SELECT k.series_id, k.t, k.m AS score, k.m > c.cut AS flag FROM near k JOIN (SELECT series_id, @pct(m, 0.95) AS cut FROM near GROUP BY series_id) c ON k.series_id = c.series_id", "Mean distance to the 5 nearest rows of the series, over its 0.95 quantile.", OBS_EVENTS + """, pairs AS (SELECT a.series_id, a.t, abs(a.x0 - b.x0) AS dist, row_number() OVER (PARTITION BY a.series_id, a.t ORDER BY abs(a.x0 - b.x0), b.t) AS k FROM obs a JOIN obs b ON a.series_id = b.series_id AND a.t != b.t),
near AS (SELECT series_id, t, avg(dist) AS m FROM pairs WHERE k <= 5 GROUP BY series_id, t)""")
detector("local_outlier_factor", "SELECT l.series_id, l.t, l.f AS score, l.f > 1.5 AS flag FROM lof l", "Local outlier factor of 10 neighbours, over 1.5.", OBS_EVENTS + """, pairs AS (SELECT a.series_id, a.t, b.t AS o, abs(a.x0 - b.x0) AS dist, row_number() OVER (PARTITION BY a.series_id, a.t ORDER BY abs(a.x0 - b.x0), b.t) AS k FROM obs a JOIN obs b ON a.series_id = b.series_id AND a.t != b.t),
near AS (SELECT * FROM pairs WHERE k <= 10), kd AS (SELECT series_id, t, max(dist) AS r FROM near GROUP BY series_id, t),
lrd AS (SELECT n.series_id, n.t, 1 / (avg(greatest(n.dist, kd.r)) + 1e-10) AS d FROM near n JOIN kd ON n.series_id = kd.series_id AND n.o = kd.t GROUP BY n.series_id, n.t),
lof AS (SELECT n.series_id, n.t, avg(o.d) / max(s.d) AS f FROM near n JOIN lrd o ON n.series_id = o.series_id AND n.o = o.t JOIN lrd s ON n.series_id = s.series_id AND n.t = s.t GROUP BY n.series_id, n.t)""")
