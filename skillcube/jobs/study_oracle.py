"""The queries of study in plain SQL. A fit of several epochs and its forecasts have none."""

from __future__ import annotations

from skillcube.jobs.oracle import BOX, LEADS, P, STEPS, VALUE, r, sql  # noqa: F401
from skillcube.jobs.study import BLOCK, LEVELS, PIXELS, RIDGE, TO_KV, TO_O, TO_Q


def _times(matrix, x: str) -> str:
    """matrix times a list."""
    return "[" + ", ".join(f"list_dot_product({[float(v) for v in row]}::DOUBLE[], {x})" for row in matrix) + "]"


def _unit(t: str) -> str:
    return f"[cos(radians({t}.lat)) * cos(radians({t}.lon)), cos(radians({t}.lat)) * sin(radians({t}.lon)), sin(radians({t}.lat))]"


def _minus(a: str, b: str) -> str:
    return f"[{', '.join(f'({a})[{i}] - ({b})[{i}]' for i in (1, 2, 3))}]"


_ATTENTION = f"""
SELECT id, {', '.join(f'round(({_times(TO_O, "x")})[{i + 1}], 6) + 0.0 AS x{i}' for i in range(4))} FROM (
  SELECT id, [{', '.join(f'sum(exp(s{h}) * kv[{5 + 2 * h + c}]) / sum(exp(s{h}))' for h in (0, 1) for c in (0, 1))}] AS x FROM (
    SELECT id, kv, {', '.join(f'(q[{1 + 2 * h}] * kv[{1 + 2 * h}] + q[{2 + 2 * h}] * kv[{2 + 2 * h}]) / sqrt(2.0) AS s{h}' for h in (0, 1))} FROM (
      SELECT id, {_times(TO_KV, 'xn')} AS kv, {_times(TO_Q, 'rel')} AS q FROM (
        SELECT id, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x) / 4 + 1.1920929e-07)) AS xn, list_transform(d, lambda v: v / greatest(sqrt(list_dot_product(d, d)), 1e-12)) AS rel FROM (
          SELECT to_id AS id, [cells.value, cells.value * cells.value / 100, cells.lat / 90, cells.lon / 360]::DOUBLE[] AS x, {_minus(_unit('mesh'), _unit('cells'))}::DOUBLE[] AS d
          FROM knn JOIN cells ON cells.id = from_id JOIN mesh ON mesh.id = to_id))))
  GROUP BY id)"""

_PIXELS = f"SELECT l_partkey % {PIXELS} AS pix, avg(l_quantity) / 50 AS a, avg(l_discount) * 10 AS b, avg(l_tax) * 10 AS c, avg(l_extendedprice) / 50000 AS d FROM lineitem GROUP BY 1"
_TURN = "{0} * cos(radians(lon)) - {1} * sin(radians(lon)) AS {t}0, {1} * cos(radians(lon)) + {0} * sin(radians(lon)) AS {t}1, {2} * cos(radians(lat)) - {3} * sin(radians(lat)) AS {t}2, {3} * cos(radians(lat)) + {2} * sin(radians(lat)) AS {t}3"
_BLOCKS = f"""
, pixels AS ({_PIXELS}), turned AS (SELECT pix, {_TURN.format(*"abcd", t="q")}, {_TURN.format(*"bcda", t="k")}, d AS v0, a AS v1, b AS v2, c AS v3 FROM pixels JOIN hp4 ON hp4.id = pix)
SELECT pix, {', '.join(f'round(sum(w * v{i}) / sum(w), 6) + 0.0 AS x{i}' for i in range(4))}
FROM (SELECT i.pix, exp((i.q0 * j.k0 + i.q1 * j.k1 + i.q2 * j.k2 + i.q3 * j.k3) / 2) AS w, j.v0, j.v1, j.v2, j.v3 FROM turned i JOIN turned j ON i.pix // {BLOCK} = j.pix // {BLOCK}) GROUP BY pix"""

_MEANS = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS level, CAST(l_partkey % {4 * PIXELS} // {4**k} AS BIGINT) AS pix, avg(l_quantity) AS mean, count(*) AS n FROM lineitem GROUP BY 2" for k in range(LEVELS + 1))
_WAVES = ", ".join(f"{f}({n} * radians({{0}}.lon)) * cos(radians({{0}}.lat))" for n in (1, 2) for f in ("cos", "sin"))
_FITTED = f"""
, pair AS (
  SELECT a.to_id AS id, a.value AS u1, b.value AS u2, 1 / (a.dist ** 2 + 1e-12) AS i1, 1 / (b.dist ** 2 + 1e-12) AS i2, unnest([{_WAVES.format('c1')}]) AS x1, unnest([{_WAVES.format('c2')}]) AS x2, unnest([{_WAVES.format('mesh')}]) AS y
  FROM knn a JOIN knn b ON a.to_id = b.to_id AND a.rank = 1 AND b.rank = 2 JOIN cells c1 ON c1.id = a.from_id JOIN cells c2 ON c2.id = b.from_id JOIN mesh ON mesh.id = a.to_id
), res AS (SELECT *, i1 / (i1 + i2) AS p1, i2 / (i1 + i2) AS p2, y - (x1 * i1 + x2 * i2) / (i1 + i2) AS r FROM pair),
eq AS (SELECT id, p1, p2, u1, u2, sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22, sum(x1 * r) AS b1, sum(x2 * r) AS b2 FROM res GROUP BY ALL),
soft AS (SELECT *, a11 + e AS s11, a22 + e AS s22 FROM (SELECT *, {RIDGE} * (a11 + a22) / 2 + 1e-12 AS e FROM eq)),
w AS (SELECT id, u1, u2, p1 + (b1 * s22 - b2 * a12) / (s11 * s22 - a12 * a12) AS w1, p2 + (b2 * s11 - b1 * a12) / (s11 * s22 - a12 * a12) AS w2 FROM soft)
SELECT id, {r('w1', 'w2')}, round(w1 * u1 + w2 * u2, 6) + 0.0 AS value FROM w"""

_FOLDS = f"""
, trained AS (SELECT variable, cell_id, year(time) AS year, CAST(dayofyear(time) AS INTEGER) AS doy, {VALUE} AS v FROM tagged WHERE split = 'train'),
folds AS (SELECT DISTINCT CAST(year AS INTEGER) AS fold FROM trained),
fraw AS (SELECT fold, variable, cell_id, doy, avg(v) AS raw FROM trained JOIN folds ON year <> fold GROUP BY ALL),
fring AS (SELECT *, row_number() OVER (PARTITION BY fold, variable, cell_id ORDER BY doy) AS pos, count(*) OVER (PARTITION BY fold, variable, cell_id) AS n FROM fraw),
fpadded AS (SELECT *, pos AS place FROM fring UNION ALL SELECT *, pos - n FROM fring WHERE pos > n - 11 UNION ALL SELECT *, pos + n FROM fring WHERE pos <= 11),
fclim AS (SELECT fold, variable, cell_id, doy, clim FROM (SELECT *, avg(raw) OVER (PARTITION BY fold, variable, cell_id ORDER BY place ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS clim FROM fpadded) WHERE place BETWEEN 1 AND n),
fnorm AS (SELECT fold, variable, avg(v - clim) AS mean, stddev_pop(v - clim) AS std FROM trained JOIN fclim USING (variable, cell_id, doy) WHERE year <> fold GROUP BY ALL),
fout AS (SELECT fold, variable, count(*) AS n, sqrt(avg((v - clim) ** 2)) AS rmse FROM trained JOIN fclim USING (variable, cell_id, doy) WHERE year = fold GROUP BY ALL)
"""

_X = " UNION ALL ".join(f"SELECT init, cell_id, {h * 2} + CAST(variable = {P} AS INTEGER) AS input, coalesce(CAST(CAST(h{h} AS FLOAT) AS DOUBLE), 0) AS x FROM zs" for h in (0, 1))
_Y = " UNION ALL ".join(f"SELECT init, cell_id, lat, {(k - 1) * 2} + CAST(variable = {P} AS INTEGER) AS output, CAST(CAST(t{k} AS FLOAT) AS DOUBLE) AS y FROM zs WHERE t{k} IS NOT NULL" for k in LEADS)
_GRADIENTS = f"""
, zs AS (SELECT zwindows.*, c.lat FROM zwindows JOIN (SELECT DISTINCT cell_id, lat FROM tagged) AS c USING (cell_id) WHERE split = 'train' AND pos >= 13 AND pos <= n - 49),
xs AS ({_X} UNION ALL SELECT DISTINCT init, cell_id, 4, CAST(CAST(cos(2 * pi() * dayofyear(init) / 365.25) AS FLOAT) AS DOUBLE) FROM zs UNION ALL SELECT DISTINCT init, cell_id, NULL, 1.0 FROM zs),
ws AS (SELECT lat, cos(radians(lat)) / avg(cos(radians(lat))) OVER () AS w FROM (SELECT DISTINCT lat FROM zs)),
ys AS (SELECT * FROM ({_Y}) JOIN ws USING (lat)),
tot AS (SELECT sum(w * y * y) / count(*) AS loss, count(*) AS n FROM ys)
SELECT CAST(output AS INTEGER) AS output, CAST(input AS INTEGER) AS input, round(-2 * sum(w * x * y) / n, 5) + 0.0 AS gradient, round(loss, 5) + 0.0 AS loss, n FROM ys JOIN xs USING (init, cell_id), tot GROUP BY output, input, loss, n"""


def _with(body: str, steps: str, cells: int = 25) -> str:
    """sql() of a body that brings steps of its own."""
    return sql(body, cells).replace("\n\n, ", ",\n").replace("\n, ", ",\n", 1) if steps else sql(body, cells)


ORACLE_SQL = {
    "zarr_cube": sql("SELECT variable, lat, lon, time, round(value, 6) + 0.0 AS value FROM daily WHERE value IS NOT NULL"),
    "zarr_years": sql(f"SELECT variable, lat, lon, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM daily WHERE variable = {P} AND value IS NOT NULL AND year(time) BETWEEN 1996 AND 1997 GROUP BY ALL"),
    "attention_interp": sql(_ATTENTION),
    "block_attention": _with(_BLOCKS, "pixels"),
    "mesh_pyramid": f"SELECT level, pix, {r('mean')}, n FROM ({_MEANS})",
    "mesh_skips": f"SELECT a.pix, round(a.mean - b.mean, 6) + 0.0 AS skip, round(a.mean, 6) + 0.0 AS value FROM ({_MEANS}) a JOIN ({_MEANS}) b ON a.level = 0 AND b.level = 1 AND a.pix // 4 = b.pix",
    "fitted_interp": _with(_FITTED, "pair"),
    "fold_climatology": _with(_FOLDS + f"SELECT fold, variable, cell_id, doy, {r('clim')} FROM fclim", "folds"),
    "fold_scores": _with(_FOLDS + f"SELECT fold, variable, fout.n, {r('rmse', 'mean', 'std')} FROM fout JOIN fnorm USING (fold, variable)", "folds"),
    "streamed_weekly_mean": "SELECT event_type AS variable, CAST(date_trunc('week', ts) AS DATE) AS week, count(value) AS n, round(avg(value), 6) + 0.0 AS value FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL",
    "fit_gradients": _with(_GRADIENTS, "zs", 5),
}
