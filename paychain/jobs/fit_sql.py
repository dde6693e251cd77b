"""The fits as SQL for DuckDB: whitening, landmarks, k-means and the L1 softmax, so that their classes and clusters can be held against Spark's.

Each function returns further tables for a WITH RECURSIVE list, over a table of scaled features.
"""

from __future__ import annotations

from paychain.sources.tables import FEATURES

D = len(FEATURES)
SWEEPS, CLUSTERS, STARTS, LANDMARKS = 60, 7, 20, 1000
LEVELS = "[" + ", ".join(repr(k / (LANDMARKS - 1)) for k in range(LANDMARKS)) + "]"
PCS = [f"pc{k + 1}" for k in range(D)]


def whitening(source: str) -> str:
    """Table ``comps``: means m, and ws, the weights of each component; by Jacobi rotations of the covariances."""
    cells = ", ".join(f"covar_samp({a}, {b})" for a in FEATURES for b in FEATURES)
    unit = ", ".join("1.0::DOUBLE" if i == j else "0.0::DOUBLE" for i in range(D) for j in range(D))
    pairs = [(i, j) for i in range(D) for j in range(i + 1, D)]
    p, q = ("[" + ", ".join(str(x[k]) for x in pairs) + f"][1 + n % {len(pairs)}]" for k in (0, 1))
    turn = "CASE WHEN e // 4 = e % 4 THEN (CASE WHEN e % 4 = p OR e % 4 = q THEN co ELSE 1.0::DOUBLE END) WHEN e // 4 = p AND e % 4 = q THEN si WHEN e // 4 = q AND e % 4 = p THEN -si ELSE 0.0::DOUBLE END"
    return f""", cov AS (SELECT [{', '.join(f'avg({c})' for c in FEATURES)}] AS m, [{cells}] AS a FROM {source}),
jac(n, a, v) AS (
  SELECT 0, a, [{unit}] FROM cov
  UNION ALL
  SELECT n + 1, list_transform(range(16), lambda e: list_sum(list_transform(range(16), lambda k: j[1 + 4 * (k // 4) + e // 4] * a[1 + k] * j[1 + 4 * (k % 4) + e % 4]))),
    list_transform(range(16), lambda e: list_sum(list_transform(range(4), lambda k: v[1 + 4 * (e // 4) + k] * j[1 + 4 * k + e % 4])))
  FROM (SELECT *, list_transform(range(16), lambda e: {turn}) AS j
    FROM (SELECT *, t / sqrt(t * t + 1) AS si, 1 / sqrt(t * t + 1) AS co
      FROM (SELECT *, CASE WHEN off = 0 THEN 0.0 ELSE (CASE WHEN th < 0 THEN -1 ELSE 1 END) / (abs(th) + sqrt(th * th + 1)) END AS t
        FROM (SELECT *, a[1 + 4 * p + q] AS off, (a[1 + 5 * q] - a[1 + 5 * p]) / (2 * CASE WHEN a[1 + 4 * p + q] = 0 THEN 1 ELSE a[1 + 4 * p + q] END) AS th
          FROM (SELECT *, {p} AS p, {q} AS q FROM jac WHERE n < {SWEEPS})))))),
eig AS (SELECT k, a[1 + 5 * k] AS value, list_transform(range(4), lambda i: v[1 + 4 * i + k]) AS w FROM jac, range(4) AS r(k) WHERE n = {SWEEPS}),
signed AS (SELECT value, list_transform(w, lambda x: x * sign(w[list_position(list_transform(w, lambda y: abs(y)), list_max(list_transform(w, lambda y: abs(y))))]) / sqrt(value)) AS w FROM eig),
comps AS (SELECT any_value(m) AS m, list(w ORDER BY value DESC) AS ws FROM signed, cov)"""


def components(name: str, source: str) -> str:
    """Table ``name``: key, features and components of the rows of ``source``."""
    lines = [" + ".join(f"ws[{k + 1}][{j + 1}] * ({c} - m[{j + 1}])" for j, c in enumerate(FEATURES)) + f" AS {pc}" for k, pc in enumerate(PCS)]
    return f", {name} AS MATERIALIZED (SELECT key, {', '.join(FEATURES)}, {', '.join(lines)} FROM {source}, comps)"


def landmarks(name: str, source: str) -> str:
    """Tables {name}_pc1 ..: the landmarks of each component over ``source``, equal ones as one with the first and last level."""
    sql = ""
    for c in PCS:
        sql += (
            f", {name}_{c} AS MATERIALIZED (SELECT q, min(r) AS r0, max(r) AS r1, lead(q) OVER (ORDER BY q) AS nq, lead(min(r)) OVER (ORDER BY q) AS nr"
            f" FROM (SELECT unnest(quantile_cont({c}, {LEVELS})) AS q, (generate_subscripts({LEVELS}, 1) - 1) / {LANDMARKS - 1}.0 AS r FROM {source}) GROUP BY q)"
        )
    return sql


def uniform(name: str, source: str, marks: str) -> str:
    """Table ``name``: key, features and the level u1 .. of each component of ``source`` by the landmarks ``marks``."""
    level = lambda i, c: (
        f"CASE WHEN g{i}.q IS NULL THEN 0.0 WHEN g{i}.q = s.{c} THEN (g{i}.r0 + g{i}.r1) / 2 WHEN g{i}.nq IS NULL THEN 1.0"
        f" ELSE g{i}.r1 + (s.{c} - g{i}.q) / (g{i}.nq - g{i}.q) * (g{i}.nr - g{i}.r1) END::DOUBLE AS u{i + 1}"
    )
    joins = " ".join(f"ASOF LEFT JOIN {marks}_{c} g{i} ON s.{c} >= g{i}.q" for i, c in enumerate(PCS))
    return f", {name} AS MATERIALIZED (SELECT s.key, {', '.join(f's.{c}' for c in FEATURES)}, {', '.join(level(i, c) for i, c in enumerate(PCS))} FROM {source} s {joins})"


def _distance(a: str, b: str) -> str:
    return "(" + " + ".join(f"({a}.u{k + 1} - {b}.u{k + 1}) * ({a}.u{k + 1} - {b}.u{k + 1})" for k in range(D)) + ")"


def kmeans(source: str, seed: int = 0, tol: float = 1e-4) -> str:
    """Table ``centres`` (c, u1 ..): the best of the k-means++ starts over the levels in ``source``, as ``fit_kmeans`` finds it."""
    us = [f"u{k + 1}" for k in range(D)]
    digest = f"md5('{seed}|' || key)"
    sql = f", pts AS MATERIALIZED (SELECT key, {', '.join(us)}, ('0x' || substr({digest}, 1, 13))::BIGINT AS h1, ('0x' || substr({digest}, 14, 13))::BIGINT AS h2 FROM {source})"
    sql += f", f0 AS (SELECT key, i, 1.0::DOUBLE AS far FROM pts, range({STARTS}) AS r(i))"
    for s in range(CLUSTERS):
        time = f"-ln((((h1 + (i * {CLUSTERS} + {s}) * h2) & {(1 << 52) - 1}) + 0.5::DOUBLE) / {1 << 52}::DOUBLE) / far"
        sql += f", c{s} AS MATERIALIZED (SELECT i, {s} AS c, {', '.join(f'arg_min({u}, {time}) AS {u}' for u in us)} FROM f{s} JOIN pts USING (key) WHERE far > 0 GROUP BY i)"
        gap = _distance("p", "c")
        sql += f", f{s + 1} AS MATERIALIZED (SELECT f.key, i, {f'least(far, {gap})' if s else gap} AS far FROM f{s} f JOIN c{s} c USING (i) JOIN pts p ON p.key = f.key)"
    sql += f", still AS (SELECT {tol} * ({' + '.join(f'var_pop({u})' for u in us)}) / {D} AS s FROM pts)"
    sql += f""", lloyd(t, i, c, {', '.join(us)}, done) AS (
  SELECT 0, i, c, {', '.join(us)}, FALSE FROM ({' UNION ALL '.join(f'SELECT * FROM c{s}' for s in range(CLUSTERS))})
  UNION ALL
  SELECT t + 1, i, c, {', '.join(f'n{u}' for u in us)}, sum({' + '.join(f'(n{u} - {u}) * (n{u} - {u})' for u in us)}) OVER (PARTITION BY i) <= (SELECT s FROM still)
  FROM (SELECT l.*, {', '.join(f'coalesce(m.{u}, l.{u}) AS n{u}' for u in us)} FROM lloyd l LEFT JOIN (
      SELECT i, c, {', '.join(f'avg({u}) AS {u}' for u in us)} FROM (SELECT p.*, l.i, arg_min(l.c, ({_distance('p', 'l')}, l.c)) AS c FROM pts p, lloyd l WHERE NOT l.done GROUP BY ALL) GROUP BY i, c) m USING (i, c)
    WHERE NOT l.done AND l.t < 300))
, costs AS (SELECT i, sum(d) AS cost FROM (SELECT p.key, l.i, min({_distance('p', 'l')}) AS d FROM pts p, lloyd l WHERE l.done GROUP BY ALL) GROUP BY i)
, chosen AS (SELECT min(i) AS i FROM costs WHERE cost <= (SELECT min(cost) FROM costs) * (1 + 1e-9))
, centres AS MATERIALIZED (SELECT c, {', '.join(us)} FROM lloyd JOIN chosen USING (i) WHERE done)"""
    return sql


def clustered(source: str) -> str:
    """Table ``told``: key, features and predict_index of the levels in ``source``."""
    near = f"arg_min(c.c, ({_distance('s', 'c')}, c.c))"
    return f", told AS (SELECT s.key, {', '.join(f's.{c}' for c in FEATURES)}, {near}::INT AS predict_index FROM {source} s, centres c GROUP BY ALL)"


CLASSES, STEPS = 3, 1200


def softmax(source: str, label: str, C: float = 3.0) -> str:
    """Table ``linear`` (w: for each class the weights and the intercept): the L1 softmax over ``source`` by accelerated proximal gradients with restarts."""
    n = D + 1
    z = [" + ".join([*(f"v[{n * k + j + 1}] * {c}" for j, c in enumerate(FEATURES)), f"v[{n * k + n}]"]) for k in range(CLASSES)]
    slopes = ", ".join(f"avg((e{k} / (e0 + e1 + e2) - ({label} = {k + 1})::INT) * {x})" for k in range(CLASSES) for x in [*FEATURES, "1"])
    return f""", size AS (SELECT 1.0::DOUBLE / ({C} * count(*)) AS reg, 0.5 * (avg({' + '.join(f'{c} * {c}' for c in FEATURES)}) + 1) AS steep FROM {source}),
fista(n, v, w, t) AS (
  SELECT 0, list_transform(range({n * CLASSES}), lambda i: 0.0::DOUBLE), list_transform(range({n * CLASSES}), lambda i: 0.0::DOUBLE), 1.0::DOUBLE
  UNION ALL
  SELECT n + 1, list_transform(range({n * CLASSES}), lambda i: x[i + 1] + (s - 1) / ((1 + sqrt(1 + 4 * s * s)) / 2) * (x[i + 1] - w[i + 1])), x, (1 + sqrt(1 + 4 * s * s)) / 2
  FROM (SELECT n, w, x, CASE WHEN list_sum(list_transform(range({n * CLASSES}), lambda i: (v[i + 1] - x[i + 1]) * (x[i + 1] - w[i + 1]))) > 0 THEN 1.0::DOUBLE ELSE t END AS s
    FROM (SELECT n, v, w, t, list_transform(range({n * CLASSES}), lambda i: CASE WHEN i % {n} = {D} THEN v[i + 1] - g[i + 1] / steep
        ELSE sign(v[i + 1] - g[i + 1] / steep) * greatest(0, abs(v[i + 1] - g[i + 1] / steep) - reg / steep) END) AS x
      FROM (SELECT n, any_value(v) AS v, any_value(w) AS w, any_value(t) AS t, [{slopes}] AS g
        FROM (SELECT *, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1, exp(z2 - greatest(z0, z1, z2)) AS e2
          FROM (SELECT n, v, w, t, {', '.join(FEATURES)}, {label}, {', '.join(f'{x} AS z{k}' for k, x in enumerate(z))} FROM fista, {source} WHERE n < {STEPS})) GROUP BY n), size))),
linear AS MATERIALIZED (SELECT w FROM fista WHERE n = {STEPS})"""


def classified(source: str, rest: str = "") -> str:
    """Table ``told``: key, features, ``rest`` and predict_index of the scaled rows in ``source``."""
    n = D + 1
    z = ", ".join(" + ".join([*(f"w[{n * k + j + 1}] * {c}" for j, c in enumerate(FEATURES)), f"w[{n * k + n}]"]) for k in range(CLASSES))
    return f", told AS (SELECT key, {', '.join(FEATURES)}{rest}, list_position(z, list_max(z))::INT AS predict_index FROM (SELECT *, [{z}] AS z FROM {source}, linear))"
