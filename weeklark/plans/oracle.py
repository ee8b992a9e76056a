"""DuckDB SQL of the registered queries: closed forms where the library folds, joins where it has arrays.

What several parts read is materialised, so that no version of the database computes it once for each of them.
"""

from __future__ import annotations

from ..functions.registry import FITTED, ROUTES, STATISTICAL, TOURNAMENT
from .queries import LONGER_THAN_ALL, NATIVE, SHORT_TRAIN

ORDER = {name: i for i, name in enumerate(TOURNAMENT)}


def weeks(key: str, name: str = "w") -> str:
    return f"""
    raw_{name} AS MATERIALIZED (SELECT {key} AS id, CAST(CAST(date_trunc('week', l_shipdate) AS DATE) + 6 AS DATE) AS date, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY 1, 2),
    grid_{name} AS (
        SELECT id, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS date
        FROM (SELECT id, min(date) AS lo FROM raw_{name} GROUP BY id), (SELECT max(date) AS hi FROM raw_{name})),
    {name} AS MATERIALIZED (SELECT g.id, g.date, coalesce(r.q, 0.0) AS y FROM grid_{name} g LEFT JOIN raw_{name} r ON g.id = r.id AND g.date = r.date)"""


def series(holdout: int = 52, least: int = 0) -> str:
    """From w(id, date, y): s (indexed), t (training), a (test), g, p, x."""
    return f"""
    s0 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY id) AS n, week(date) AS wk, year(date) AS yr FROM w),
    s AS MATERIALIZED (SELECT * FROM s0 WHERE n >= {least}),
    t AS MATERIALIZED (SELECT *, n - {holdout} AS m FROM s WHERE i < n - {holdout}),
    a AS MATERIALIZED (SELECT *, i - (n - {holdout}) + 1 AS st FROM s WHERE i >= n - {holdout}),
    g AS MATERIALIZED (SELECT id, avg(y) AS gm, median(y) AS gmed, max(date) AS last, count(*) AS m FROM t GROUP BY id),
    x AS MATERIALIZED (SELECT *, week(fdate) AS fw FROM (
        SELECT id, st, CAST(last + 7 + CAST((7 - isodow(last + 7)) % 7 AS INTEGER) + CAST(7 * (st - 1) AS INTEGER) AS DATE) AS fdate FROM g, range(1, 53) r(st))),
    ranked AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY yr) AS yrank FROM t),
    p AS MATERIALIZED (SELECT id, wk, avg(y) AS mean, median(y) AS med, sum(y * pow(0.8, -yrank)) / sum(pow(0.8, -yrank)) AS wm FROM ranked GROUP BY id, wk),
    ov AS MATERIALIZED (SELECT id, avg(mean) AS ov FROM p GROUP BY id),
    px AS MATERIALIZED (
        SELECT x.id, st, fdate, fw, gm, gmed, m, mean, med, wm, CASE WHEN ov > 0 THEN coalesce(mean / ov, 1.0) ELSE 1.0 END AS idx
        FROM x JOIN g ON g.id = x.id JOIN ov ON ov.id = x.id LEFT JOIN p ON p.id = x.id AND p.wk = x.fw)"""


def _blocks(size: int) -> str:
    """(id, st, f) of a smoothed and dealt-back block sum."""
    return f"""
        SELECT px.id, px.st, CASE WHEN ws > 0 THEN idx / ws * greatest(level, 0.0) ELSE greatest(level, 0.0) / {size} END AS f
        FROM (SELECT *, sum(idx) OVER (PARTITION BY id, (st - 1) // {size}) AS ws FROM px) px
        JOIN (
            SELECT id, sum(CASE WHEN b = 0 THEN pow(0.8, k - 1) ELSE 0.2 * pow(0.8, k - 1 - b) END * v) AS level
            FROM (SELECT id, b, sum(y) AS v, any_value(m // {size}) AS k FROM (SELECT *, (i - m % {size}) // {size} AS b FROM t WHERE i >= m % {size}) GROUP BY id, b)
            GROUP BY id) lv ON lv.id = px.id"""


MODELS = {
    "seasonal_naive": "SELECT px.id, px.st, t.y AS f FROM px JOIN t ON t.id = px.id AND t.i = (px.m * (52 // px.m + 1) - 52 + (px.st - 1) % 52) % px.m",
    "weekly_hist_avg": "SELECT id, st, coalesce(mean, gm) AS f FROM px",
    "global_avg": "SELECT id, st, gm AS f FROM px",
    "tsb": """
        SELECT px.id, px.st, greatest(z * p, 0.0) AS f FROM px JOIN (
            SELECT id, pow(0.9, any_value(k)) * coalesce(avg(CASE WHEN y > 0 THEN y END), 0.0) + coalesce(sum(CASE WHEN y > 0 THEN 0.1 * pow(0.9, k - r) * y END), 0.0) AS z,
                pow(0.9, any_value(m)) * any_value(k) / any_value(m) + coalesce(sum(CASE WHEN y > 0 THEN 0.1 * pow(0.9, m - 1 - i) END), 0.0) AS p
            FROM (SELECT *, count(CASE WHEN y > 0 THEN 1 END) OVER (PARTITION BY id) AS k, count(CASE WHEN y > 0 THEN 1 END) OVER (PARTITION BY id ORDER BY i) AS r FROM t)
            GROUP BY id) q ON q.id = px.id""",
    "temp_agg_ses": _blocks(4),
    "weighted_seasonal_avg": "SELECT id, st, coalesce(wm, gm) AS f FROM px",
    "seasonal_median": "SELECT id, st, coalesce(med, gmed) AS f FROM px",
    "seasonal_naive_blend": """
        SELECT px.id, px.st, 0.5 * t.y + 0.5 * coalesce(mean, gm) AS f
        FROM px JOIN t ON t.id = px.id AND t.i = (px.m * (52 // px.m + 1) - 52 + (px.st - 1) % 52) % px.m""",
    "imapa": "SELECT id, st, avg(f) AS f FROM (" + " UNION ALL ".join(_blocks(size) for size in (1, 2, 4, 8, 13)) + ") GROUP BY id, st",
    "linear_trend_seasonal": """
        SELECT px.id, px.st, greatest(a0 + b0 * (px.m - 1 + px.st) + coalesce(mean - gm, 0.0), 0.0) AS f FROM px JOIN (
            SELECT id, regr_slope(z, i) AS b0, regr_intercept(z, i) AS a0
            FROM (SELECT t.id, t.i, t.y - (p.mean - g.gm) AS z FROM t JOIN p ON p.id = t.id AND p.wk = t.wk JOIN g ON g.id = t.id) GROUP BY id) l ON l.id = px.id""",
    "sba": """
        SELECT px.id, px.st, coalesce(v, 0.0) AS f FROM px LEFT JOIN (
            SELECT id, sum(c * y) / sum(c * gap) * 0.95 AS v FROM (
                SELECT id, y, gap, CASE WHEN j = 0 THEN pow(0.9, k - 1) ELSE 0.1 * pow(0.9, k - 1 - j) END AS c FROM (
                    SELECT id, y, i - coalesce(lag(i) OVER (PARTITION BY id ORDER BY i), -1) AS gap, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY id) AS k
                    FROM t WHERE y > 0)) GROUP BY id) q ON q.id = px.id""",
}


def _all(names) -> str:
    return "f AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT id, '{n}' AS model, {ORDER.get(n, 99)} AS ord, st, f FROM ({MODELS[n]})" for n in names) + ")"


SUPPLIERS, PARTS = weeks("l_suppkey"), weeks("l_partkey")

EVAL = """
    naive AS (SELECT id, avg(abs(y - y52)) AS nv FROM (SELECT id, y, lag(y, 52) OVER (PARTITION BY id ORDER BY i) AS y52 FROM t) WHERE y52 IS NOT NULL GROUP BY id),
    e AS MATERIALIZED (
        SELECT a.id, model, any_value(ord) AS ord, sum(abs(y - f.f)) / nullif(sum(abs(y)), 0) AS wape, avg(abs(y - f.f)) / nullif(any_value(nv), 0) AS mase,
            sum(y) AS total_actual, sum(f.f) AS total_forecast
        FROM a JOIN f ON f.id = a.id AND f.st = a.st LEFT JOIN naive ON naive.id = a.id GROUP BY a.id, model)"""

BEST = """
    r AS (SELECT *, round(wape, 10) AS p1, round(mase, 10) AS s1 FROM e WHERE wape IS NOT NULL AND mase IS NOT NULL),
    sc AS (
        SELECT *, round(0.7 * CASE WHEN maxp > minp THEN (p1 - minp) / (maxp - minp) ELSE 0 END + 0.3 * CASE WHEN maxs > mins THEN (s1 - mins) / (maxs - mins) ELSE 0 END, 10) AS score
        FROM (SELECT *, min(p1) OVER o AS minp, max(p1) OVER o AS maxp, min(s1) OVER o AS mins, max(s1) OVER o AS maxs FROM r WINDOW o AS (PARTITION BY id))),
    ranked_best AS (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, p1, ord) AS rn, count(*) FILTER (score = best) OVER (PARTITION BY id) AS ties
        FROM (SELECT *, min(score) OVER (PARTITION BY id) AS best FROM sc)),
    best AS MATERIALIZED (SELECT *, CASE WHEN ties > 1 THEN 'tiebreak' ELSE 'tournament' END AS method FROM ranked_best WHERE rn = 1)"""

EVALUATED = f"WITH {SUPPLIERS}, {series(52, 104)}, {_all(NATIVE)}, {EVAL}"

CLASSES = """
    cls AS MATERIALIZED (
        SELECT id, adi, cv2, CASE WHEN k = 0 THEN 'lumpy' WHEN adi <= 1.32 THEN CASE WHEN coalesce(cv2, 0) > 0.49 THEN 'erratic' ELSE 'smooth' END
            ELSE CASE WHEN coalesce(cv2, 0) > 0.49 THEN 'lumpy' ELSE 'intermittent' END END AS category
        FROM (
            SELECT id, count(*) FILTER (y > 0) AS k, pow(stddev_pop(y) FILTER (y > 0) / avg(y) FILTER (y > 0), 2) AS cv2,
                CASE WHEN count(*) FILTER (y > 0) > 1 THEN (max(i) FILTER (y > 0) - min(i) FILTER (y > 0)) / (count(*) FILTER (y > 0) - 1.0) ELSE CAST(count(*) AS DOUBLE) END AS adi
            FROM t GROUP BY id))"""

_ROUTE_ROWS = ", ".join(f"('{c}', '{m}')" for c, names in ROUTES.items() for m in names)
_NATIVE_ROUTES = ", ".join(f"('{c}', '{m}')" for c, names in ROUTES.items() for m in names if m not in FITTED)
_ROUTED_NAMES = sorted({m for names in ROUTES.values() for m in names if m not in FITTED})

ACTIVITY = """
    mx AS (SELECT max(date) AS mx FROM w),
    act AS MATERIALIZED (
        SELECT id, sum(CASE WHEN date > mx - 182 THEN y ELSE 0 END) AS recent_sum, max(date) FILTER (y > 0) AS last_nonzero_date, count(*) AS total_history_weeks,
            sum(y) AS lifetime_total_qty, any_value(mx) AS mx FROM w, mx GROUP BY id)"""

DAYS = "SELECT user_id AS item, CAST(ts AS DATE) AS d, round(sum(value), 6) AS q FROM events GROUP BY 1, 2"

SHORT = f"""
    pw AS MATERIALIZED (SELECT w.*, p_brand, p_type FROM w JOIN part ON p_partkey = id),
    short AS (SELECT id FROM pw GROUP BY id HAVING count(*) < {SHORT_TRAIN + 52})"""

SHARES = f"""
    cal AS (
        SELECT grp, max(date) FILTER (rk > 52 OR nd <= 52) AS last_train, bool_or(nd > 52) AS long FROM (
            SELECT grp, date, row_number() OVER (PARTITION BY grp ORDER BY date DESC) AS rk, count(*) OVER (PARTITION BY grp) AS nd FROM (SELECT DISTINCT grp, date FROM rows_)) GROUP BY grp),
    rec AS (
        SELECT r.grp, r.id, sum(CASE WHEN r.date <= last_train AND r.date >= last_train - 182 THEN y ELSE 0 END) AS recent
        FROM rows_ r JOIN cal USING (grp) WHERE r.id IN (SELECT id FROM short) GROUP BY r.grp, r.id),
    shares AS MATERIALIZED (
        SELECT rec.grp, id, recent, CASE WHEN recent > 0 THEN recent / sm * CASE WHEN zeros > 0 THEN 0.9 ELSE 1.0 END
            WHEN recent = 0 THEN CASE WHEN sm > 0 THEN 0.1 ELSE 1.0 END / zeros ELSE 1.0 / alls END AS share
        FROM rec JOIN (SELECT grp, sum(CASE WHEN recent > 0 THEN recent ELSE 0 END) AS sm, count(*) FILTER (recent = 0) AS zeros, count(*) AS alls FROM rec GROUP BY grp) q ON q.grp = rec.grp)"""


def _model_sql(name: str, source: str = SUPPLIERS) -> str:
    return f"WITH {source}, {series()} SELECT id AS item_id, CAST(st AS INTEGER) AS step, round(f, 4) AS forecast FROM ({MODELS[name]})"


ORACLE_SQL: dict[str, str] = {
    "weekly_densify": f"WITH {SUPPLIERS} SELECT id AS item_id, date, y AS demand FROM w",
    "inactive_items": f"""WITH {PARTS}, {ACTIVITY} SELECT id AS item_id, 'inactive' AS status, last_nonzero_date,
        CAST((mx - last_nonzero_date) // 7 AS INTEGER) AS weeks_since_demand, total_history_weeks, lifetime_total_qty FROM act WHERE recent_sum = 0""",
    "active_items": f"WITH {PARTS}, {ACTIVITY} SELECT id AS item_id, total_history_weeks AS weeks, lifetime_total_qty AS demand FROM act WHERE recent_sum > 0",
    "classify_demand": f"WITH {PARTS}, {series()}, {CLASSES} SELECT id AS item_id, round(adi, 6) AS adi, round(cv2, 6) AS cv2, category FROM cls",
    "route_models": f"""WITH {PARTS}, {series()}, {CLASSES} SELECT id AS item_id, cls.category, model
        FROM cls JOIN (VALUES {_ROUTE_ROWS}) AS routes(category, model) ON routes.category = cls.category""",
    "diagnostics_pattern": f"""WITH d AS ({DAYS}), m AS (
            SELECT item, count(*) AS n, count(*) FILTER (q IS NULL OR q <> 0) AS k, pow(stddev_samp(q) FILTER (q > 0) / avg(q) FILTER (q > 0), 2) AS cv2 FROM d GROUP BY item)
        SELECT item AS item_field, CASE WHEN k = 0 THEN -1.0 ELSE round(n / k, 6) END AS "ADI", coalesce(round(cv2, 6), -1.0) AS "CV2",
            CASE WHEN k = 0 THEN 'No Demand' WHEN n / k < 1.32 AND cv2 < 0.49 THEN 'Smooth' WHEN n / k >= 1.32 AND cv2 < 0.49 THEN 'Intermittent'
                WHEN n / k < 1.32 AND cv2 >= 0.49 THEN 'Erratic' ELSE 'Lumpy' END AS pattern FROM m""",
    "diagnostics_outliers": f"""WITH d AS ({DAYS}), q AS (SELECT item, quantile_cont(q, 0.25) AS q1, quantile_cont(q, 0.75) AS q3 FROM d GROUP BY item)
        SELECT d.item AS item_field, coalesce(string_agg(strftime(d.d, '%Y-%m-%d'), ', ' ORDER BY d.d) FILTER (d.q < q1 - 1.5 * (q3 - q1) OR d.q > q3 + 1.5 * (q3 - q1)), '') AS outliers
        FROM d JOIN q ON q.item = d.item GROUP BY d.item""",
    **{name: _model_sql(name) for name in (*NATIVE, "sba")},
    "tsb_parts": _model_sql("tsb", PARTS), "sba_parts": _model_sql("sba", PARTS),
    "seasonal_index_profile": f"""WITH {SUPPLIERS}, {series()} SELECT p.id AS item_id, CAST(wk AS INTEGER) AS iso_week, round(mean, 4) AS mean, round(med, 4) AS median,
        round(wm, 4) AS weighted, round(mean / ov, 6) AS seasonal_index FROM p JOIN ov ON ov.id = p.id""",
    "horizon_calendar": f"WITH {SUPPLIERS}, {series(0)} SELECT id AS item_id, CAST(st AS INTEGER) AS step, fdate AS date, CAST(fw AS INTEGER) AS iso_week FROM x",
    "wape_mase": f"""{EVALUATED} SELECT id AS item_id, model, round(wape, 6) AS wape, round(mase, 6) AS mase, round(total_actual, 4) AS total_actual,
        round(total_forecast, 4) AS total_forecast, CAST(1 AS INTEGER) AS n_folds, CAST(0 AS DOUBLE) AS wape_std FROM e""",
    "tournament": f"""{EVALUATED}, {BEST} SELECT id AS item_id, model AS best_model, round(score, 6) AS composite_score, round(wape, 6) AS wape, round(mase, 6) AS mase,
        method AS selection_method FROM best""",
    "summary_by_model": f"""{EVALUATED}, {BEST},
        wins AS (SELECT model, count(*) AS wins FROM best GROUP BY model),
        per AS (SELECT model, median(wape) AS mw, median(mase) AS mm, sum(wape * total_actual) / sum(total_actual) AS dw FROM e GROUP BY model)
        SELECT wins.model, wins, round(wins * 100.0 / (SELECT count(*) FROM best), 1)::DOUBLE AS win_pct, round(mw, 6) AS median_wape, round(mm, 6) AS median_mase,
            round(dw, 6) AS demand_weighted_wape, CAST(0 AS DOUBLE) AS median_wape_std FROM wins JOIN per ON per.model = wins.model""",
    "fold_details_pipeline": f"""{EVALUATED} SELECT a.id AS item_id, model, CAST(1 AS INTEGER) AS fold, a.date, a.y AS actual, round(f.f, 4) AS forecast
        FROM a JOIN f ON f.id = a.id AND f.st = a.st""",
    "fold_details_routed": f"""WITH {SUPPLIERS}, {series(52, 104)}, {CLASSES}, {_all(_ROUTED_NAMES)}
        SELECT a.id AS item_id, f.model, cls.category, a.date, a.y AS actual, round(f.f, 4) AS forecast, 'direct' AS method
        FROM a JOIN cls ON cls.id = a.id JOIN (VALUES {_NATIVE_ROUTES}) AS routes(category, model) ON routes.category = cls.category
        JOIN f ON f.id = a.id AND f.st = a.st AND f.model = routes.model""",
    "aggregate_series": f"WITH {PARTS}, {SHORT} SELECT p_brand, date, sum(y) AS demand FROM pw GROUP BY 1, 2",
    "item_shares": f"WITH {PARTS}, {SHORT}, rows_ AS (SELECT p_type AS grp, id, date, y FROM pw), {SHARES} SELECT grp AS p_type, id AS item_id, recent, round(share, 6) AS share FROM shares",
    "aggregate_fallback": f"""WITH {weeks("l_partkey", "parts")}, pw AS MATERIALIZED (SELECT parts.*, p_brand, p_type FROM parts JOIN part ON p_partkey = id),
        short AS (SELECT id FROM pw GROUP BY id HAVING count(*) < {SHORT_TRAIN + 52}),
        rows_ AS (SELECT p_brand AS grp, id, date, y FROM pw), {SHARES},
        w AS (SELECT p_brand AS id, date, sum(y) AS y FROM pw GROUP BY 1, 2), {series(52, SHORT_TRAIN + 52)}, {CLASSES}, {_all(_ROUTED_NAMES)},
        test AS (SELECT id, date, y, i - (n - 52) + 1 AS st FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM pw WHERE id IN (SELECT id FROM short)) WHERE i >= n - 52 AND n >= 52)
        SELECT test.id AS item_id, f.model, cls.category, test.date, test.y AS actual, round(greatest(f.f * share, 0.0), 4) AS forecast
        FROM test JOIN shares ON shares.id = test.id JOIN cls ON cls.id = shares.grp
        JOIN (VALUES {_NATIVE_ROUTES}) AS routes(category, model) ON routes.category = cls.category
        JOIN f ON f.id = shares.grp AND f.st = test.st AND f.model = routes.model""",
    "global_avg_fallback": f"""WITH {PARTS}, {SHORT},
        ix AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM pw WHERE id IN (SELECT id FROM short)),
        mean AS (SELECT id, greatest(coalesce(avg(y) FILTER (i < n - 52), avg(y)), 0.0) AS f FROM ix WHERE n >= 52 GROUP BY id)
        SELECT ix.id AS item_id, 'global_avg' AS model, 'insufficient_history' AS category, date, y AS actual, round(f, 4) AS forecast FROM ix JOIN mean ON mean.id = ix.id WHERE i >= n - 52""",
    "composite_group_key": f"""WITH {PARTS}, {SHORT} SELECT coalesce(p_brand, 'None') || '||' || coalesce(p_type, 'None') AS grp, count(DISTINCT id) AS items, sum(y) AS demand FROM pw GROUP BY 1""",
    "adhoc_mae_topk": f"""{EVALUATED} SELECT a.id AS item_id, round(avg(abs(y - f.f)), 4) AS mae FROM a JOIN f ON f.id = a.id AND f.st = a.st WHERE model = 'global_avg'
        GROUP BY a.id ORDER BY mae DESC, item_id LIMIT 10""",
    "adhoc_rmse": f"{EVALUATED} SELECT model, round(sqrt(avg(pow(y - f.f, 2))), 4) AS rmse FROM a JOIN f ON f.id = a.id AND f.st = a.st GROUP BY model",
    "adhoc_bias": f"""{EVALUATED} SELECT * FROM (SELECT a.id AS item_id, model, round(avg(f.f - y), 4) AS bias FROM a JOIN f ON f.id = a.id AND f.st = a.st GROUP BY a.id, model) WHERE abs(bias) > 5""",
    "model_counts": f"{EVALUATED}, {BEST} SELECT model AS best_model, count(*) AS series FROM best GROUP BY model",
}

_FINAL = f"""{EVALUATED}, {BEST}"""


def _final_sql() -> str:
    """Winners over the holdout, then of each model only the series that it won, over whole histories."""
    models = " UNION ALL ".join(f"SELECT q.id, '{n}' AS model, st, f FROM ({MODELS[n]}) q JOIN won ON won.id = q.id AND won.model = '{n}'" for n in NATIVE)
    return f"""WITH won AS MATERIALIZED (SELECT id, model FROM ({_FINAL} SELECT id, model FROM best)), {SUPPLIERS}, {series(0)}, f AS MATERIALIZED ({models})
        SELECT x.id AS item_id, f.model, x.fdate AS date, round(f.f, 4) AS forecast, CAST(x.st AS INTEGER) AS step FROM x JOIN f ON f.id = x.id AND f.st = x.st"""


ORACLE_SQL["final_forecast"] = _final_sql()
ORACLE_SQL["fold_wapes"] = f"""{EVALUATED} SELECT id AS item_id, model, CASE WHEN wape IS NULL THEN 'inf' ELSE printf('%.4f', wape) END AS fold_wapes FROM e"""
ORACLE_SQL["pipeline_parts"] = f"""WITH {weeks("l_partkey", "all_w")}, {ACTIVITY.replace("FROM w", "FROM all_w")},
    w AS MATERIALIZED (SELECT q.* FROM all_w q JOIN act ON act.id = q.id WHERE recent_sum > 0), {series(52, 104)}, {_all(NATIVE)}, {EVAL}, {BEST}
    SELECT id AS item_id, model AS best_model, method AS selection_method FROM best
    UNION ALL SELECT DISTINCT id, 'seasonal_naive', 'fallback' FROM e WHERE id NOT IN (SELECT id FROM best)"""
_STATISTICAL_ROWS = ", ".join(f"('{c}', '{m}')" for c, names in STATISTICAL.items() for m in names)
ORACLE_SQL["route_models_statistical"] = ORACLE_SQL["route_models"].replace(_ROUTE_ROWS, _STATISTICAL_ROWS)
ORACLE_SQL["item_shares_signed"] = ORACLE_SQL["item_shares"].replace("id, date, y FROM pw", "id, date, y - 1.0 AS y FROM pw")
ORACLE_SQL["aggregate_too_short"] = ORACLE_SQL["global_avg_fallback"].replace(f"< {SHORT_TRAIN + 52}", f"< {LONGER_THAN_ALL + 52}").replace(
    "round(f, 4) AS forecast", "round(f, 4) AS forecast, 'global_avg_fallback' AS method")

_FEATURES = """
    fx AS (
        SELECT *, coalesce(lag(y, 1) OVER o, 0.0) AS lag_1, coalesce(lag(y, 4) OVER o, 0.0) AS lag_4, coalesce(lag(y, 13) OVER o, 0.0) AS lag_13,
            coalesce(lag(y, 26) OVER o, 0.0) AS lag_26, coalesce(lag(y, 52) OVER o, 0.0) AS lag_52,
            avg(y) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rolling_mean_4,
            avg(y) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) AS rolling_mean_13,
            stddev_pop(y) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rolling_std_4
        FROM t WINDOW o AS (PARTITION BY id ORDER BY i)),
    st AS (
        SELECT c.id, c.anchor, avg(y) AS historical_mean,
            CASE WHEN count(*) FILTER (y > 0) > 1 THEN stddev_pop(y) FILTER (y > 0) / avg(y) FILTER (y > 0) ELSE 0.0 END AS historical_cv,
            CASE WHEN count(*) FILTER (y > 0) > 1 THEN (max(i) FILTER (y > 0) - min(i) FILTER (y > 0)) / (count(*) FILTER (y > 0) - 1.0) ELSE CAST(c.anchor AS DOUBLE) END AS adi,
            count(*) FILTER (y > 0) / CAST(c.anchor AS DOUBLE) AS demand_ratio
        FROM (SELECT DISTINCT id, i - i % 26 AS anchor FROM t WHERE i >= 52) c JOIN t ON t.id = c.id AND t.i < c.anchor GROUP BY c.id, c.anchor)"""

ORACLE_SQL["gbt_features"] = f"""WITH {SUPPLIERS}, {series()}, {_FEATURES}
    SELECT fx.id AS item_id, date, y AS demand, round(lag_1, 4) AS lag_1, round(lag_4, 4) AS lag_4, round(lag_13, 4) AS lag_13, round(lag_26, 4) AS lag_26, round(lag_52, 4) AS lag_52,
        round(rolling_mean_4, 4) AS rolling_mean_4, round(rolling_mean_13, 4) AS rolling_mean_13, round(rolling_std_4, 4) AS rolling_std_4,
        CAST(wk AS DOUBLE) AS week_of_year, CAST(month(date) AS DOUBLE) AS month, round(historical_mean, 4) AS historical_mean, round(historical_cv, 4) AS historical_cv,
        round(adi, 4) AS adi, round(demand_ratio, 4) AS demand_ratio
    FROM fx JOIN st ON st.id = fx.id AND st.anchor = fx.i - fx.i % 26 WHERE fx.i >= 52"""
