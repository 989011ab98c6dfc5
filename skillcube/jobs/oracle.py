"""The registered queries in plain SQL, one chain of named steps, as an independent statement of them."""

from __future__ import annotations

import re

import numpy as np

P = "'total_precipitation_24hr'"
LEADS = range(1, 7)
SERIES = "split, variable, cell_id, lat, lon"
VALUE = f"CASE WHEN variable = {P} THEN ln(1 + value) ELSE value END"
BOX = "lat BETWEEN -35 AND 10 AND lon BETWEEN 0 AND 360"
W = "cos(radians(lat))"


def _lags(n, value="value", step=1, order="week"):
    return ", ".join(f"lag({value}, {step * k}) OVER w AS m{k}" for k in range(n))


STEPS = {
    "days": "SELECT CAST(s_nationkey % {cells} AS INTEGER) AS cell_id, CAST(l_shipdate AS DATE) AS time, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "daily": f"SELECT variable, cell_id, CAST(cell_id * 5.0 - 60.0 AS DOUBLE) AS lat, CAST((cell_id * 37) % 360 AS DOUBLE) AS lon, time, value FROM (SELECT 'quantity' AS variable, cell_id, time, q AS value FROM days UNION ALL SELECT {P}, cell_id, time, d FROM days)",
    "split_all": "SELECT *, CASE WHEN time BETWEEN DATE '1995-01-01' AND DATE '1998-12-03' THEN 'train' WHEN time BETWEEN DATE '1999-01-01' AND DATE '1999-12-03' THEN 'val' WHEN time BETWEEN DATE '2000-01-01' AND DATE '2001-12-31' THEN 'test' END AS split FROM daily",
    "tagged": "SELECT * FROM split_all WHERE split IS NOT NULL",
    "doym": f"SELECT variable, cell_id, CAST(dayofyear(time) AS INTEGER) AS doy, avg({VALUE}) AS raw FROM tagged WHERE split = 'train' GROUP BY 1, 2, 3",
    "ring": "SELECT *, row_number() OVER (PARTITION BY variable, cell_id ORDER BY doy) AS pos, count(*) OVER (PARTITION BY variable, cell_id) AS n FROM doym",
    "padded": "SELECT *, pos AS place FROM ring UNION ALL SELECT *, pos - n FROM ring WHERE pos > n - 11 UNION ALL SELECT *, pos + n FROM ring WHERE pos <= 11",
    "clim": "SELECT variable, cell_id, doy, clim FROM (SELECT *, avg(raw) OVER (PARTITION BY variable, cell_id ORDER BY place ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS clim FROM padded) WHERE place BETWEEN 1 AND n",
    "last_doy": "SELECT max(doy) AS last_doy FROM clim",
    "anom": f"SELECT variable, cell_id, lat, lon, time, split, {VALUE} - clim AS value FROM (SELECT *, least(dayofyear(time), last_doy) AS doy FROM tagged, last_doy) LEFT JOIN clim USING (variable, cell_id, doy)",
    "norm": "SELECT variable, avg(value) AS mean, stddev_pop(value) AS std FROM anom WHERE split = 'train' GROUP BY 1",
    "z": "SELECT variable, cell_id, lat, lon, time, split, (value - mean) / CASE WHEN std > 0 THEN std ELSE 1 END AS value FROM anom JOIN norm USING (variable)",
    "weekly": f"SELECT {SERIES}, CAST(date_trunc('week', time) AS DATE) AS week, avg(value) AS value FROM anom GROUP BY ALL",
    "ends": "SELECT split, min(week) AS lo, max(week) AS hi FROM weekly GROUP BY 1",
    "series": f"SELECT DISTINCT {SERIES} FROM weekly",
    "slots": f"SELECT {SERIES}, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week FROM series JOIN ends USING (split)",
    "spine": f"SELECT {SERIES}, week, value FROM slots LEFT JOIN weekly USING ({SERIES}, week)",
    "ahead": f"SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY {SERIES}) AS n, {_lags(5)}, " + ", ".join(f"lead(value, {k}) OVER w AS t{k}" for k in LEADS) + f" FROM spine WINDOW w AS (PARTITION BY {SERIES} ORDER BY week)",
    "points": " UNION ALL ".join(f"SELECT {SERIES}, week AS init, value AS current, {k} AS lead, t{k} AS truth, m0, m1, m2, m3, m4 FROM ahead" for k in LEADS),
    "test": f"SELECT * FROM points WHERE split = 'test' AND {BOX}",
    "whole": "SELECT * FROM test WHERE truth IS NOT NULL AND m0 + m1 + m2 + m3 + m4 IS NOT NULL",
    "scored": "SELECT *, near - pairs / 25 AS biased, near - pairs / 20 AS fair, (m0 + m1 + m2 + m3 + m4) / 5 AS f FROM (SELECT *, (" + " + ".join(f"abs(m{i} - truth)" for i in range(5)) + ") / 5 AS near, " + " + ".join(f"abs(m{i} - m{j})" for i in range(5) for j in range(i)) + " AS pairs FROM whole)",
    "pool": f"SELECT variable, cell_id, t.woy AS target_woy, value AS x FROM (SELECT * FROM spine WHERE split = 'train' AND value IS NOT NULL AND {BOX}) JOIN (SELECT unnest(range(1, 54)) AS woy) AS t ON least(abs(weekofyear(week) - t.woy), 52 - abs(weekofyear(week) - t.woy)) <= 3",
    "pool_m": "SELECT variable, cell_id, target_woy, list(x ORDER BY x) AS xs FROM pool GROUP BY 1, 2, 3",
    "pool_c": "SELECT variable, lead, init, lat, list_sum(list_transform(xs, lambda x: abs(x - truth))) / len(xs) AS near, CASE WHEN len(xs) = 1 THEN 0 ELSE list_sum(list_transform(xs, lambda x, k: (2 * (k - 1) - (len(xs) - 1)) * x)) / (len(xs) * (len(xs) - 1)) END AS apart FROM test JOIN pool_m ON pool_m.variable = test.variable AND pool_m.cell_id = test.cell_id AND target_woy = weekofyear(init + 7 * lead) WHERE truth IS NOT NULL".replace("SELECT variable", "SELECT test.variable"),
    "pool_i": f"SELECT variable, lead, init, sum(c * {W}) / sum({W}) AS c FROM (SELECT variable, lead, init, lat, avg(near - apart) AS c FROM pool_c GROUP BY ALL) GROUP BY ALL",
    "pool_s": "SELECT variable, lead, avg(c) AS crps_clim_prob FROM pool_i GROUP BY ALL",
    "base_lat": f"SELECT variable, lead, lat, {W} AS w, avg(CASE WHEN ok THEN abs(truth) END) AS pos, avg(CASE WHEN ok THEN abs(current - truth) END) AS ap, count(*) FILTER (ok) AS n, " + ", ".join(f"sum(CASE WHEN ok THEN {e} END) AS {k}" for k, e in (("tt", "truth * truth"), ("pp", "current * current"), ("pt", "current * truth"), ("ee", "(current - truth) ** 2"))) + " FROM (SELECT *, truth IS NOT NULL AND current IS NOT NULL AS ok FROM test) GROUP BY ALL",
    "base": "SELECT variable, lead AS lead_week, sum(pos * w) / sum(w) AS crps_climatology, sum(ap * w) / sum(w) AS crps_persistence, sqrt(sum(tt * w) / avg(w) / nullif(sum(n), 0)) AS rmse_climatology, sqrt(sum(ee * w) / avg(w) / nullif(sum(n), 0)) AS rmse_persistence, sum(pt * w) / nullif(sqrt(sum(pp * w) * sum(tt * w)), 0) AS acc_persistence FROM base_lat GROUP BY ALL",
    "means": "SELECT variable, lead, lat, avg(fair) AS c FROM (SELECT test.*, scored.fair FROM test LEFT JOIN scored USING (variable, cell_id, init, lead)) GROUP BY ALL",
    "det": f"SELECT variable, lead, sum(c * {W}) / sum({W}) AS crps_clim_det FROM (SELECT variable, lead, lat, avg(abs(truth)) AS c FROM test GROUP BY ALL) GROUP BY ALL",
    "model": f"SELECT variable, lead, sum(c * {W}) / sum({W}) AS crps_model FROM means GROUP BY ALL",
    "pairs": f"SELECT variable, lead, sum(f * truth * {W}) / nullif(sqrt(sum(f * f * {W}) * sum(truth * truth * {W})), 0) AS acc_mean, sqrt(avg((f - truth) ** 2 * {W})) AS rmse_mean FROM scored GROUP BY ALL",
    "spread": "SELECT variable, lead, sqrt(6.0 / 5 * avg(v)) / nullif(sqrt(avg((f - truth) ** 2)), 0) AS spread_error_ratio FROM (SELECT *, (" + " + ".join(f"(m{i} - f) ** 2" for i in range(5)) + ") / 4 AS v FROM scored) GROUP BY ALL",
    "evaluated": "SELECT variable, lead, crps_model, crps_clim_det, crps_clim_prob, 1 - crps_model / nullif(crps_clim_det, 0) AS crpss_vs_det, 1 - crps_model / nullif(crps_clim_prob, 0) AS crpss_vs_prob, acc_mean, rmse_mean, spread_error_ratio FROM model JOIN det USING (variable, lead) LEFT JOIN pool_s USING (variable, lead) LEFT JOIN pairs USING (variable, lead) LEFT JOIN spread USING (variable, lead)",
    "day_slots": "SELECT split, variable, cell_id, lat, lon, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS time FROM (SELECT DISTINCT split, variable, cell_id, lat, lon FROM tagged) JOIN (SELECT split, min(time) AS lo, max(time) AS hi FROM tagged GROUP BY 1) USING (split)",
    "rolled": f"SELECT *, CASE WHEN count(value) OVER w = 7 THEN avg(value) OVER w END AS rolled, row_number() OVER (PARTITION BY {SERIES} ORDER BY time) - 1 AS pos, count(*) OVER (PARTITION BY {SERIES}) AS n FROM day_slots LEFT JOIN tagged USING ({SERIES}, time) WINDOW w AS (PARTITION BY {SERIES} ORDER BY time ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
    "events6": "SELECT event_type AS variable, time_bucket(INTERVAL 6 HOUR, ts) AS time, avg(value) AS value FROM events GROUP BY 1, 2",
    "cells": "SELECT cell_id AS id, lon, lat, avg(value) AS value FROM daily WHERE variable = 'quantity' GROUP BY ALL",
    "mesh": "SELECT CAST(i AS INTEGER) AS id, CAST(-75.0 + 30.0 * (i // 12) AS DOUBLE) AS lat, CAST(30.0 * (i % 12) AS DOUBLE) AS lon FROM (SELECT unnest(range(72)) AS i)",
    "knn": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY dist, from_id) AS rank FROM (SELECT mesh.id AS to_id, cells.id AS from_id, cells.value, 2 * asin(least(1.0, sqrt(sin(radians(mesh.lat - cells.lat) / 2) ** 2 + cos(radians(cells.lat)) * cos(radians(mesh.lat)) * sin(radians(mesh.lon - cells.lon) / 2) ** 2))) AS dist FROM mesh, cells)) WHERE rank <= 3",
}


def _mesh_sql(nside: int) -> str:
    """HEALPix pixel centres: id, lon, lat."""
    bits = range(nside.bit_length() - 1)
    x, y = (" + ".join(f"((q >> {2 * b + odd}) & 1) * {1 << b}" for b in bits) for odd in (0, 1))
    return f"""SELECT id, degrees(phi) AS lon, 90 - degrees(acos(z)) AS lat FROM (
      SELECT *, (j - (shift + 1) * 0.5) * (pi() / 2) / per AS phi FROM (
        SELECT * REPLACE (CASE WHEN j > 4 * per THEN j - 4 * per WHEN j < 1 THEN j + 4 * per ELSE j END AS j) FROM (
          SELECT *, (off * per + x - y + 1 + shift) / 2 AS j,
            CASE WHEN i < {nside} THEN 1 - per * per / (3.0 * {nside * nside}) WHEN i > {3 * nside} THEN per * per / (3.0 * {nside * nside}) - 1 ELSE ({2 * nside} - i) * (2.0 / (3.0 * {nside})) END::DOUBLE AS z FROM (
            SELECT *, CASE WHEN i < {nside} THEN i WHEN i > {3 * nside} THEN {4 * nside} - i ELSE {nside} END AS per, CASE WHEN i < {nside} OR i > {3 * nside} THEN 0 ELSE (i - {nside}) % 2 END AS shift FROM (
              SELECT *, CASE WHEN face < 4 THEN 2 WHEN face < 8 THEN 3 ELSE 4 END * {nside} - x - y - 1 AS i, CASE WHEN face // 4 = 1 THEN 2 * (face % 4) ELSE 2 * (face % 4) + 1 END AS off FROM (
                SELECT id, id // {nside * nside} AS face, {x} AS x, {y} AS y FROM (SELECT id, id % {nside * nside} AS q FROM (SELECT unnest(range({12 * nside * nside})) AS id)))))))) """


def _near_sql(source: str, to: str, k: int) -> str:
    """The k nearest of source for each of to: to_id, from_id, rank, dist."""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY dist, from_id) AS rank FROM (
      SELECT {to}.id AS to_id, {source}.id AS from_id, 2 * asin(least(1.0, sqrt(sin(radians({to}.lat - {source}.lat) / 2) ** 2 + cos(radians({source}.lat)) * cos(radians({to}.lat)) * sin(radians({to}.lon - {source}.lon) / 2) ** 2))) AS dist FROM {to}, {source})) WHERE rank <= {k}"""


_IDW = "sum(value / (dist ** 2 + 1e-12)) / sum(1 / (dist ** 2 + 1e-12))"
for _n in (2, 4):
    STEPS[f"hp{_n}"] = _mesh_sql(_n)
    STEPS[f"fine{_n}"] = _near_sql("cells", f"hp{_n}", 4)
    STEPS[f"coarse{_n}"] = _near_sql(f"hp{_n}", "cells", 4)
STEPS["there8"], STEPS["back8"] = _near_sql("cells", "hp4", 8), _near_sql("hp4", "cells", 8)
STEPS["onmesh"] = f"SELECT to_id AS from_id, {_IDW} AS value FROM there8 JOIN (SELECT id AS from_id, value FROM cells) USING (from_id) GROUP BY ALL"
STEPS["returned"] = f"SELECT to_id AS id, {_IDW} AS f FROM back8 JOIN onmesh USING (from_id) GROUP BY ALL"
STEPS["waving"] = "SELECT id, lat, lon, name, CASE WHEN name = 'wave_k3' THEN cos(3 * radians(lon)) * cos(radians(lat)) ELSE cos(6 * radians(lon)) * cos(radians(lat)) END AS value FROM cells, (SELECT unnest(['wave_k3', 'wave_k6']) AS name)"
for _n in (2, 4):
    STEPS[f"lifted{_n}"] = f"SELECT to_id AS from_id, name, {_IDW} AS value FROM fine{_n} JOIN (SELECT id AS from_id, name, value FROM waving) USING (from_id) GROUP BY ALL"
    STEPS[f"landed{_n}"] = f"SELECT to_id AS id, name, {_IDW} AS f FROM coarse{_n} JOIN lifted{_n} USING (from_id) GROUP BY ALL"
STEPS["phys"] = "SELECT * FROM (SELECT *, least(dayofyear(init + 7 * lead), last_doy) AS doy FROM test, last_doy) LEFT JOIN clim USING (variable, cell_id, doy)"
STEPS["zrolled"] = STEPS["rolled"].replace("LEFT JOIN tagged", "LEFT JOIN z")
STEPS["zwindows"] = "SELECT split, variable, cell_id, time AS init, pos, n, lag(rolled, 7) OVER w AS h0, rolled AS h1, " + ", ".join(f"lead(rolled, {7 * k + 6}) OVER w AS t{k}" for k in LEADS) + f" FROM zrolled WINDOW w AS (PARTITION BY {SERIES} ORDER BY time)"


def _back(x: str) -> str:
    return f"(CASE WHEN variable = {P} THEN exp({x} + clim) - 1 ELSE {x} + clim END)"


def _event_sql(name: str, variable: str, space: str, op: str, bar: float) -> str:
    value = _back if space == "physical" else str
    hits = " + ".join(f"coalesce(CAST({value(f'm{i}')} {op} {bar} AS INT), 0)" for i in range(5))
    return f"SELECT '{name}' AS event, ({hits}) / CAST(5 AS DOUBLE) AS p, CAST({value('truth')} {op} {bar} AS INT) AS y FROM {'phys' if space == 'physical' else 'test'} WHERE variable = {variable} AND {value('truth')} IS NOT NULL"


STEPS["happened"] = " UNION ALL ".join(_event_sql(*e) for e in (("quantity_above_season", "'quantity'", "anomaly", ">", 0.0), ("rain_below_season", P, "anomaly", "<", -0.005), ("high_quantity", "'quantity'", "physical", ">", 26.0), ("little_rain", P, "physical", "<", 0.049)))


def _needs(text: str, upto: int | None = None) -> set[str]:
    """Steps that a text names, with what they need in turn; a step builds on earlier ones only."""
    words, out = set(re.findall(r"\w+", text)), set()
    for i, (name, step) in enumerate(list(STEPS.items())[:upto]):
        if name in words:
            out |= {name} | _needs(step, i)
    return out


def sql(body: str, cells: int = 25) -> str:
    need = _needs(body)
    return "WITH " + ",\n".join(f"{n} AS ({s.replace('{cells}', str(cells))})" for n, s in STEPS.items() if n in need) + "\n" + body


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n.split('.')[-1]}" for n in names)


_T, _H = [f"t{k}" for k in LEADS], ["h0", "h1"]
_EDGES = [repr(x) for x in np.linspace(0.0, 1.0, 11)[1:-1].tolist()]
_CENTERS = [repr(x) for x in (0.5 * (np.linspace(0, 1, 11)[:-1] + np.linspace(0, 1, 11)[1:])).tolist()]
_BELOW, _TIES = " + ".join(f"CAST(m{i} < truth AS INT)" for i in range(5)), " + ".join(f"CAST(m{i} = truth AS INT)" for i in range(5))
_GT, _LT = (" + ".join(f"coalesce(CAST(m{i} {o} 0 AS INT), 0)" for i in range(5)) for o in "><")

ORACLE_SQL = {
    "daily_mean": sql(f"SELECT variable, cell_id, time, {r('value')} FROM daily"),
    "six_hour_resample": sql(f"SELECT variable, CAST(time AS DATE) AS time, round(avg(value), 6) + 0.0 AS value FROM events6 GROUP BY ALL"),
    "time_gap_check": sql("SELECT step_seconds, count(*) AS n FROM (SELECT CAST(epoch(lead(time) OVER (ORDER BY time)) - epoch(time) AS BIGINT) AS step_seconds FROM (SELECT DISTINCT time FROM events6)) WHERE step_seconds IS NOT NULL GROUP BY 1"),
    "cube_summary": sql("SELECT variable, count(*) AS n, count(*) FILTER (value IS NULL) AS n_missing, count(DISTINCT cell_id) AS cells, min(time) AS first, max(time) AS last, round(min(value), 6) + 0.0 AS least, round(max(value), 6) + 0.0 AS largest FROM daily GROUP BY 1"),
    "weekly_mean": sql("SELECT variable, cell_id, CAST(date_trunc('week', time) AS DATE) AS week, round(avg(value), 6) + 0.0 AS value FROM daily GROUP BY ALL"),
    "weekly_spine": sql(f"SELECT split, variable, cell_id, week, {r('value')} FROM spine").replace("avg(value) AS value FROM anom GROUP BY ALL", "avg(value) AS value FROM tagged GROUP BY ALL"),
    "split_census": sql("SELECT split, count(DISTINCT time) AS days, count(*) AS n FROM split_all GROUP BY 1"),
    "box_filter": sql(f"SELECT variable, cell_id, CAST(lat AS DOUBLE) AS lat, lon, count(value) AS n, round(avg(value), 6) + 0.0 AS mean FROM daily WHERE {BOX} GROUP BY ALL"),
    "season_month_mean": sql(f"SELECT split, variable, round(avg(value), 6) + 0.0 AS mean FROM tagged WHERE {BOX} AND month(time) BETWEEN 6 AND 9 GROUP BY ALL"),
    "doy_climatology": sql(f"SELECT variable, cell_id, doy, {r('raw')} FROM doym"),
    "smoothed_climatology": sql(f"SELECT variable, cell_id, doy, {r('clim')} FROM clim"),
    "anomaly": sql(f"SELECT variable, cell_id, time, split, {r('value')} FROM anom"),
    "normalizer": sql(f"SELECT variable, {r('mean', 'std')} FROM norm"),
    "standardized": sql(f"SELECT variable, cell_id, time, split, {r('value')} FROM z"),
    "physical_reconstruction": sql(f"SELECT variable, cell_id, time, split, round(CASE WHEN variable = {P} THEN exp(value + clim) - 1 ELSE value + clim END, 6) + 0.0 AS physical FROM (SELECT *, least(dayofyear(time), last_doy) AS doy FROM anom, last_doy) LEFT JOIN clim USING (variable, cell_id, doy)"),
    "rolling7": sql(f"SELECT split, variable, cell_id, time, {r('value', 'rolled')} FROM rolled", 5),
    "lead_targets": sql(f"SELECT split, variable, cell_id, init, {r('current')}, lead, {r('truth')} FROM points"),
    "valid_init_weeks": sql("SELECT split, variable, cell_id, count(*) AS n, min(week) AS first, max(week) AS last FROM ahead WHERE pos < n - 6 GROUP BY ALL"),
    "history_windows": sql(f"SELECT split, variable, cell_id, week AS init, round(m1, 6) + 0.0 AS h0, round(m0, 6) + 0.0 AS h1, {r(*_T)} FROM ahead WHERE pos >= 1 AND pos < n - 6"),
    "daily_init_windows": sql(f"SELECT split, variable, cell_id, init, {r(*_H, *_T)} FROM (SELECT split, variable, cell_id, time AS init, pos, n, lag(rolled, 7) OVER w AS h0, rolled AS h1, " + ", ".join(f"lead(rolled, {7 * k + 6}) OVER w AS t{k}" for k in LEADS) + " FROM rolled WHERE split <> 'test' WINDOW w AS (PARTITION BY split, variable, cell_id ORDER BY time)) WHERE pos >= 13 AND pos <= n - 49", 5),
    "season_channel": sql("SELECT time, round(CAST(CAST(cos(2 * pi() * dayofyear(time) / 365.25) AS FLOAT) AS DOUBLE), 5) + 0.0 AS season FROM (SELECT DISTINCT time FROM tagged)"),
    "climatology_forecast": sql("SELECT variable, lead, count(*) AS n, 0.0::DOUBLE AS total FROM weekly, (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS lead) WHERE split = 'test' GROUP BY ALL"),
    "persistence_forecast": sql(f"SELECT variable, cell_id, week AS init, lead, {r('value')} FROM weekly, (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS lead) WHERE split = 'test'"),
    "baseline_scores": sql(f"SELECT variable, lead_week, {r('crps_climatology', 'crps_persistence', 'rmse_climatology', 'rmse_persistence', 'acc_persistence')} FROM base"),
    "woy_pool": sql("SELECT variable, cell_id, CAST(t.woy AS INTEGER) AS target_woy, CAST(count(*) AS INTEGER) AS n, round(min(value), 6) + 0.0 AS least, CASE WHEN count(value) = count(*) THEN round(max(value), 6) + 0.0 END AS largest FROM (SELECT * FROM weekly WHERE split = 'train') JOIN (SELECT unnest(range(1, 54)) AS woy) AS t ON least(abs(weekofyear(week) - t.woy), 52 - abs(weekofyear(week) - t.woy)) <= 3 GROUP BY ALL"),
    "crps_biased": sql("SELECT variable, cell_id, init, lead, round(biased, 6) + 0.0 AS crps FROM scored"),
    "crps_fair": sql("SELECT variable, cell_id, init, lead, round(fair, 6) + 0.0 AS crps FROM scored"),
    "crps_woy_climatology": sql(f"SELECT variable, lead, {r('crps_clim_prob')} FROM pool_s"),
    "crpss": sql("SELECT variable, lead_week, round(1 - crps_persistence / nullif(crps_climatology, 0), 6) + 0.0 AS crpss FROM base"),
    "fair_crps_loss": sql(f"SELECT variable, lead, round(sum(s * {W}) / avg({W}) / nullif(sum(n), 0), 6) + 0.0 AS fair_crps FROM (SELECT variable, lead, lat, sum(fair) AS s, count(fair) AS n FROM (SELECT test.*, scored.fair FROM test LEFT JOIN scored USING (variable, cell_id, init, lead)) GROUP BY ALL) GROUP BY ALL"),
    "weighted_mse": sql(f"SELECT variable, lead, round(sum(e * {W}) / avg({W}) / nullif(sum(n), 0), 6) + 0.0 AS mse FROM (SELECT variable, lead, lat, sum((f - test.truth) ** 2) AS e, count(f) AS n FROM test LEFT JOIN (SELECT variable, cell_id, init, lead, f FROM scored) USING (variable, cell_id, init, lead) GROUP BY ALL) GROUP BY ALL"),
    "rank_histogram": sql(f"SELECT variable, lead, CAST(rank AS INTEGER) AS rank, round(coalesce(sum(1.0 / (ties + 1)) FILTER (rank BETWEEN below AND below + ties), 0), 6) + 0.0 AS count FROM (SELECT variable, lead, {_BELOW} AS below, {_TIES} AS ties FROM whole), (SELECT unnest(range(6)) AS rank) GROUP BY ALL"),
    "spread_error_ratio": sql(f"SELECT variable, lead, {r('spread_error_ratio')} FROM spread"),
    "event_probability": sql(f"SELECT variable, cell_id, init, lead, round(({_GT}) / 5.0, 6) + 0.0 AS p_gt, round(({_LT}) / 5.0, 6) + 0.0 AS p_lt FROM test WHERE truth IS NOT NULL"),
    "reliability_curve": sql(f"SELECT variable, lead, CAST(b AS INTEGER) AS bin, round(CAST([{', '.join(_CENTERS)}] AS DOUBLE[])[b + 1], 6) + 0.0 AS center, round(avg(y) FILTER (pos = b), 6) + 0.0 AS observed, count(*) FILTER (pos = b) AS n FROM (SELECT variable, lead, y, " + " + ".join(f"CAST(p >= CAST({e} AS DOUBLE) AS INT)" for e in _EDGES) + f" AS pos FROM (SELECT variable, lead, ({_GT}) / CAST(5 AS DOUBLE) AS p, CAST(truth > 0 AS INT) AS y FROM test WHERE truth IS NOT NULL)), (SELECT unnest(range(10)) AS b) GROUP BY ALL"),
    "reliability_ranks": sql("SELECT variable, lead, (i + 0.5) / 10 AS nominal, round(avg(CAST(truth <= list_sort([m0, m1, m2, m3, m4])[least(CAST(floor((i + 0.5) / 10 * 5) AS INT), 4) + 1] AS INT)), 6) + 0.0 AS observed FROM whole, (SELECT CAST(unnest(range(10)) AS DOUBLE) AS i) GROUP BY ALL"),
    "evaluation_scores": sql(f"SELECT variable, lead, {r('crps_model', 'crps_clim_det', 'crps_clim_prob', 'crpss_vs_det', 'crpss_vs_prob', 'acc_mean', 'rmse_mean', 'spread_error_ratio')} FROM evaluated"),
    "decision_gate": sql("SELECT coalesce(bool_and(coalesce(crpss_vs_prob > 0, false)), false) AS passed FROM evaluated WHERE lead IN (3, 4)"),
    "haversine_knn": sql(f"SELECT to_id, CAST(rank AS INTEGER) AS rank, {r('dist')} FROM knn"),
    "idw_interp": sql("SELECT to_id AS id, round(sum(value / (dist ** 2 + 1e-12)) / sum(1 / (dist ** 2 + 1e-12)), 6) + 0.0 AS value FROM knn GROUP BY ALL"),
    "idw_roundtrip_rmse": sql(f"SELECT round(sqrt(sum({W} * (f - value) ** 2) / sum({W})), 6) + 0.0 AS rmse FROM returned JOIN cells USING (id)"),
    "packed_samples": sql("SELECT init, CAST(2 * count(*) + count(*) // 2 AS INTEGER) AS n_input, CAST(6 * count(*) AS INTEGER) AS n_target, round(sum(coalesce(CAST(CAST(h0 AS FLOAT) AS DOUBLE), 0) + coalesce(CAST(CAST(h1 AS FLOAT) AS DOUBLE), 0)) + count(*) // 2 * CAST(CAST(cos(2 * pi() * dayofyear(init) / 365.25) AS FLOAT) AS DOUBLE), 3) + 0.0 AS input_sum, round(sum(" + " + ".join(f"coalesce(CAST(CAST({t} AS FLOAT) AS DOUBLE), 0)" for t in _T) + "), 3) + 0.0 AS target_sum FROM zwindows WHERE split = 'train' AND pos >= 13 AND pos <= n - 49 GROUP BY init", 5),
    "drawn_members": sql("SELECT CAST(m AS INTEGER) AS member, variable AS channel, count(*) AS n, round(avg(value * (1 + m / 10)), 5) + 0.0 AS mean FROM weekly, (SELECT CAST(unnest(range(3)) AS DOUBLE) AS m) WHERE split = 'test' AND value IS NOT NULL GROUP BY ALL"),
    "forecast_join": sql("SELECT variable, cell_id, init, lead, 5 AS n, round((m0 + m1 + m2 + m3 + m4) / 5, 6) + 0.0 AS mean, round(truth, 6) + 0.0 AS truth FROM test"),
    "forecast_scores": sql(f"SELECT variable, lead, {r('crps_model', 'crps_clim_det', 'crps_clim_prob', 'crpss_vs_det', 'crpss_vs_prob', 'acc_mean', 'rmse_mean', 'spread_error_ratio')} FROM evaluated"),
    "event_reliability": sql(f"SELECT event, CAST(b AS INTEGER) AS bin, round(CAST([{', '.join(_CENTERS)}] AS DOUBLE[])[b + 1], 6) + 0.0 AS center, round(avg(y) FILTER (pos = b), 6) + 0.0 AS observed, count(*) FILTER (pos = b) AS n FROM (SELECT event, y, " + " + ".join(f"CAST(p >= CAST({e} AS DOUBLE) AS INT)" for e in _EDGES) + " AS pos FROM happened), (SELECT unnest(range(10)) AS b) GROUP BY ALL"),
    "level_flattening": "SELECT 'l_quantity_' || l_linenumber AS variable, count(*) AS n, round(avg(l_quantity), 4) + 0.0 AS mean FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY ALL UNION ALL SELECT 'l_extendedprice_3', count(*), round(avg(l_extendedprice), 4) + 0.0 FROM lineitem WHERE l_linenumber = 3 HAVING count(*) > 0",
    "year_range": sql("SELECT variable, count(*) AS n, min(time) AS first, max(time) AS last, round(avg(value), 6) + 0.0 AS mean FROM daily WHERE year(time) BETWEEN 1996 AND 1997 GROUP BY 1"),
    "stored_cube": sql("SELECT split, variable, count(*) AS n, count(DISTINCT cell_id) AS cells, round(avg(value), 6) + 0.0 AS mean FROM tagged WHERE split <> 'val' GROUP BY ALL"),
    "sample_batches": sql("SELECT CAST(place // 16 AS INTEGER) AS batch, count(*) AS n, CAST(min(place) AS INTEGER) AS first, CAST(max(place) AS INTEGER) AS last FROM (SELECT row_number() OVER (ORDER BY init) - 1 AS place FROM (SELECT DISTINCT init FROM zwindows WHERE split = 'val' AND pos >= 13 AND pos <= n - 49)) GROUP BY ALL", 5),
    "healpix_pixels": sql(f"SELECT to_id AS id, from_id AS pix, CAST(from_id // 4 AS BIGINT) AS parent, {r('lon', 'lat', 'dist')} FROM (SELECT * FROM coarse4 WHERE rank = 1) JOIN hp4 ON hp4.id = from_id"),
    "wave_fields": sql(f"SELECT id, name, {r('value')} FROM waving"),
    "loss_by_resolution": sql(" UNION ALL ".join(f"SELECT {n} AS nside, name, round(sqrt(sum({W} * (f - value) ** 2) / sum({W})), 6) + 0.0 AS rmse, round(sqrt(sum({W} * (f - value) ** 2) / sum({W})) / any_value(span), 6) + 0.0 AS relative FROM landed{n} JOIN waving USING (id, name) JOIN (SELECT name, max(value) - min(value) AS span FROM waving GROUP BY 1) USING (name) WHERE {BOX} GROUP BY ALL" for n in (2, 4))),
    "spherical_twins": sql("SELECT id, round(cos(radians(lat)) * cos(radians(lon)), 6) + 0.0 AS x, round(cos(radians(lat)) * sin(radians(lon)), 6) + 0.0 AS y, round(sin(radians(lat)), 6) + 0.0 AS z FROM cells"),
}
