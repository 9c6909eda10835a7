"""Operators that rewrite a sequence, row by row."""

from __future__ import annotations

from ..catalog import sql_query
from ..sources.tables import OBS_DAY, OBS_DIFF, OBS_EVENTS

W = "PARTITION BY series_id ORDER BY t"


def rewrite(name: str, value: str, doc: str, source: str = OBS_EVENTS, table: str = "obs", more: str = "") -> None:
    sql_query(name, f"WITH {source}{more} SELECT series_id, t, round({value} + 0.0, 6) AS y FROM {table}", doc, layer="signal", transformer=True)


rewrite("difference", "coalesce(dx, 0)", "First difference, 0 in the first row.", OBS_DIFF, "d")
rewrite("cumsum", f"sum(x0) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "Running sum.")
rewrite("zscore_normalize", "(x0 - avg(x0) OVER (PARTITION BY series_id)) / (stddev_pop(x0) OVER (PARTITION BY series_id) + 1e-9)", "Standard scores over the series.")
rewrite("moving_average", f"sum(x0) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5", "Centred mean of 5 with zeros beyond the ends, so it looks ahead and shrinks at the ends.")
rewrite("trailing_mean", f"avg(x0) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "Causal mean of up to 5 rows.")
rewrite("rolling_sum", f"sum(x0) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "Trailing sum of up to 20 rows.")
rewrite("rolling_std", f"stddev_pop(x0) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)", "Trailing population deviation of up to 10 rows.")
rewrite("realized_vol", "stddev_pop(coalesce(dx, 0)) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)", "Trailing deviation of 12 changes.", OBS_DIFF, "d")
rewrite("bs_pricing_vol", "stddev_pop(coalesce(dx, 0)) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "Trailing deviation of 20 changes, the volatility that option prices are made from.", OBS_DIFF, "d")
rewrite("shift_features", "coalesce(lag(x0, 3) OVER (PARTITION BY series_id ORDER BY t), first_value(x0) OVER (PARTITION BY series_id ORDER BY t))", "The value three rows before; the first value where there is none.")
rewrite("kinematic_next_step", f"3 * x0 - 3 * coalesce(lag(x0, 1) OVER ({W}), x0) + coalesce(lag(x0, 2) OVER ({W}), lag(x0, 1) OVER ({W}), x0)", "Next value under constant acceleration of the last three.")
rewrite("momentum_10", f"x0 - coalesce(lag(x0, 10) OVER ({W}), first_value(x0) OVER ({W}))", "Change over ten rows.")
rewrite("drawdown", "max(c) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c", "Distance of the running sum of changes from its peak.", OBS_DIFF, "c", ", c AS (SELECT series_id, t, sum(coalesce(dx, 0)) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM d)")

sql_query("detrend", f"""WITH {OBS_EVENTS}, f AS (SELECT series_id, regr_slope(x0, t) AS b, regr_intercept(x0, t) AS a FROM obs GROUP BY series_id)
SELECT o.series_id, o.t, round(x0 - coalesce(a + b * t, 0) + 0.0, 6) AS y FROM obs o JOIN f ON o.series_id = f.series_id""", "Residuals of the least-squares line.", layer="signal", transformer=True)

sql_query("wiener_denoise", f"""WITH {OBS_EVENTS}, l AS (SELECT *, sum(x0) OVER v / 5 AS m, sum(x0 * x0) OVER v / 5 AS m2 FROM obs WINDOW v AS ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
s AS (SELECT *, m2 - m * m AS lv, avg(m2 - m * m) OVER (PARTITION BY series_id) AS noise FROM l)
SELECT series_id, t, round(CASE WHEN lv < noise THEN m ELSE m + (1 - noise / lv) * (x0 - m) END + 0.0, 6) AS y FROM s""", "Local Wiener filter of width 5 with zeros beyond the ends; the noise is the mean local variance.", layer="noise", transformer=True)

sql_query("median_filter", f"""WITH {OBS_EVENTS}, n AS (SELECT series_id, max(t) AS last FROM obs GROUP BY series_id),
k AS (SELECT o.series_id, o.t, @rows(-2, 2)) AS k FROM obs o),
i AS (SELECT k.series_id, k.t, k.k, CASE WHEN k.t + k.k < 0 THEN -(k.t + k.k) - 1 WHEN k.t + k.k > last THEN 2 * last + 1 - (k.t + k.k) ELSE k.t + k.k END AS j FROM k JOIN n ON k.series_id = n.series_id)
SELECT i.series_id, i.t, round(median(x0) + 0.0, 6) AS y FROM i JOIN obs o ON i.series_id = o.series_id AND i.j = o.t GROUP BY i.series_id, i.t""", "Median of 5 with the ends reflected.", layer="noise", transformer=True)

#: Weight and value of the rows from 8 before to 8 after, the ends held: windows of one sort, where the join's side would go to the driver.
_NEAR = [(f"exp(-0.5 * {k * k} / 4.0)", f"CASE WHEN t >= {-k} THEN lag(x0, {-k}) OVER w ELSE first END" if k < 0 else f"CASE WHEN t + {k} <= last THEN lead(x0, {k}) OVER w ELSE final END" if k else "x0") for k in range(-8, 9)]
_SMOOTH = f"""WITH {OBS_EVENTS}, e AS (SELECT *, count(*) OVER v - 1 AS last, first_value(x0) OVER v AS first, last_value(x0) OVER v AS final FROM obs WINDOW v AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
n AS (SELECT series_id, t, {", ".join(f"{x} AS n{i}" for i, (_, x) in enumerate(_NEAR))} FROM e WINDOW w AS ({W}))
SELECT series_id, t, round(CASE WHEN coalesce({", ".join(f"n{i}" for i in range(17))}) IS NOT NULL THEN ({" + ".join(f"coalesce({w} * n{i}, 0D)" for i, (w, _) in enumerate(_NEAR))}) / ({" + ".join(w for w, _ in _NEAR)}) END + 0.0, 6) AS y FROM n"""
sql_query("gaussian_smooth", f"""WITH {OBS_EVENTS}, n AS (SELECT series_id, max(t) AS last FROM obs GROUP BY series_id),
k AS (SELECT o.series_id, o.t, @rows(-8, 8)) AS k FROM obs o),
i AS (SELECT k.series_id, k.t, exp(-0.5 * k.k * k.k / 4.0) AS w, least(greatest(k.t + k.k, 0), last) AS j FROM k JOIN n ON k.series_id = n.series_id)
SELECT i.series_id, i.t, round(sum(w * x0) / sum(w) + 0.0, 6) AS y FROM i JOIN obs o ON i.series_id = o.series_id AND i.j = o.t GROUP BY i.series_id, i.t""", "Gaussian kernel of deviation 2 and radius 8; ends are held.", spark_sql=_SMOOTH, layer="signal", transformer=True)

sql_query("savgol_interior", f"""WITH {OBS_EVENTS}, f AS (SELECT series_id, t, (-2 * lag(x0, 3) OVER w + 3 * lag(x0, 2) OVER w + 6 * lag(x0, 1) OVER w + 7 * x0 + 6 * lead(x0, 1) OVER w + 3 * lead(x0, 2) OVER w - 2 * lead(x0, 3) OVER w) / 21 AS y FROM obs WINDOW w AS ({W}))
SELECT series_id, t, round(y + 0.0, 6) AS y FROM f WHERE y IS NOT NULL""", "Quadratic smoothing over 7 rows, where the whole window is inside.", layer="noise", transformer=True)

sql_query("ofi", f"""WITH flow AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value * (CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS sv, value FROM events)
SELECT series_id, t, round(sum(sv) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) + 0.0, 6) AS y FROM flow""", "Order-flow imbalance: trailing sum of 20 signed volumes.", layer="signal", transformer=True)

sql_query("delay_embed", f"""WITH {OBS_EVENTS}, e AS (SELECT series_id, t, x0, lead(x0, 1) OVER w AS x1, lead(x0, 2) OVER w AS x2 FROM obs WINDOW w AS ({W}))
SELECT series_id, t, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM e WHERE x2 IS NOT NULL""", "Rows with the two that follow.", layer="signal", transformer=True)

sql_query("causal_fill", f"""WITH {OBS_EVENTS}, g AS (SELECT series_id, t, CASE WHEN x0 > 100 THEN NULL ELSE x0 END AS x FROM obs), m AS (SELECT *, sum(CASE WHEN x IS NULL THEN 0 ELSE 1 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)
SELECT series_id, t, round(coalesce(max(x) OVER (PARTITION BY series_id, run), 0) + 0.0, 6) AS y FROM m""", "Missing values (here those over 100) take the last one present, or 0.", layer="signal", transformer=True)

sql_query("tabular_encoder", f"""WITH {OBS_DAY}, s AS (SELECT avg(x0) AS m0, stddev_pop(x0) AS s0, avg(x1) AS m1, stddev_pop(x1) AS s1 FROM obs)
SELECT series_id, t, round((x0 - m0) / (s0 + 1e-9) + 0.0, 6) AS z0, round((x1 - m1) / (s1 + 1e-9) + 0.0, 6) AS z1 FROM obs CROSS JOIN s""", "Columns standardised; one row of moments goes to all.", layer="encoder", transformer=True)

sql_query("haar_wavelet", f"""WITH {OBS_EVENTS}, a1 AS (SELECT series_id, floor(t / 2) AS k, sum(x0) / sqrt(2) AS a, (max(CASE WHEN t % 2 = 0 THEN x0 END) - max(CASE WHEN t % 2 = 1 THEN x0 END)) / sqrt(2) AS d, count(*) AS c FROM obs GROUP BY series_id, floor(t / 2)),
a2 AS (SELECT series_id, floor(k / 2) AS k, sum(a) / sqrt(2) AS a, (max(CASE WHEN k % 2 = 0 THEN a END) - max(CASE WHEN k % 2 = 1 THEN a END)) / sqrt(2) AS d, count(*) AS c FROM a1 WHERE c = 2 GROUP BY series_id, floor(k / 2)),
a3 AS (SELECT series_id, floor(k / 2) AS k, sum(a) / sqrt(2) AS a, (max(CASE WHEN k % 2 = 0 THEN a END) - max(CASE WHEN k % 2 = 1 THEN a END)) / sqrt(2) AS d, count(*) AS c FROM a2 WHERE c = 2 GROUP BY series_id, floor(k / 2)),
u AS (SELECT series_id, 1 AS level, d FROM a1 WHERE c = 2 UNION ALL SELECT series_id, 2 AS level, d FROM a2 WHERE c = 2 UNION ALL SELECT series_id, 3 AS level, d FROM a3 WHERE c = 2)
SELECT series_id, cast(level AS bigint) AS level, count(*) AS n, round(ln(1 + sum(d * d)), 6) AS log_energy FROM u GROUP BY series_id, level""", "Log energy of the Haar details of three levels, over whole pairs.", layer="signal")
