"""One query for each operation, over frames derived from the given tables, and the same in SQL.

Doubles are rounded to six places, and 0.0 is added so that there is no negative zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paychain.functions import curves, metrics
from paychain.jobs import classify_job, cluster_job, fit_sql, score_job
from paychain.operators import cluster as C
from paychain.operators import prep, scale, sketch
from paychain.operators.classify import LinearModel, kkt_residual, ovr_residuals, predict_linear
from paychain.sources import fixtures, tables
from paychain.sources.scratch import scratch_path, settled
from paychain.sources.tables import COUNT, FEATURES, KEY, LABEL
from paychain.streaming import refit
from paychain.streaming import score as stream

CLASSES = classify_job.CLASSES
#: A given linear model and given centres on scaled features: they test scoring apart from fitting.
PINNED = LinearModel(
    tuple(FEATURES), (1, 2, 3), ((-1.2, 0.1, -0.3, 0.2), (0.2, 0.1, 0.3, -0.1), (1.0, -0.2, 0.1, 0.3)), (-0.1, 0.5, -0.2)
)
CENTRES = [(-1.0, -0.5, -1.0, -0.5), (-0.3, 0.4, -0.2, 0.1), (0.0, 0.0, 0.0, 0.0), (0.2, -0.4, 0.6, 0.5), (0.6, 0.3, 0.1, -0.6), (0.9, 0.9, 0.9, 0.9), (1.5, -0.2, 0.3, 1.2)]
ATTRS, STEPS = ["p_brand", "p_type", "p_size"], 16

RECURSIVE = fixtures.PRELUDE.replace("WITH", "WITH RECURSIVE", 1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Register a query under its name, and its SQL after the common tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (RECURSIVE if recursive else fixtures.PRELUDE) + sql
        return f

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0
    return out.alias(name or c) if name or isinstance(c, str) else out


def s6(c: str, name: str | None = None) -> str:
    return f"round({c}, 6) + 0.0 AS {name or c}"


ROUNDED = ", ".join(s6(c) for c in FEATURES)


def _index(spark, d) -> DataFrame:
    return fixtures.chain_index(spark, d)


def _aligned(spark, d) -> DataFrame:
    return prep.align_labels(_index(spark, d), fixtures.chain_labels(spark, d), KEY, check=False)


def _model(spark, d) -> DataFrame:
    return prep.model_input(prep.active_rows(_aligned(spark, d), COUNT), KEY, FEATURES, LABEL)


def _scaled(spark, d) -> DataFrame:
    model = settled(_model(spark, d))
    return scale.apply_robust(model, scale.fit_robust(model, FEATURES))


def _params_sql(name: str, source: str) -> str:
    cols = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1.0 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s_{c}" for c in FEATURES)
    return f", {name} AS (SELECT {cols} FROM {source})"


def _scaled_sql(name: str, params: str, source: str, rest: str = ", dis_index") -> str:
    return f", {name} AS (SELECT key, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in FEATURES)}{rest} FROM {source}, {params})"


SCALED_SQL = _params_sql("params", "model") + _scaled_sql("scaled", "params", "model")
_margins = ", ".join(f"({' + '.join(f'({w}) * {c}' for w, c in zip(row, FEATURES))} + ({b})) AS m{i + 1}" for i, (row, b) in enumerate(zip(PINNED.weights, PINNED.intercepts)))
SCORED_SQL = SCALED_SQL + f", margins AS (SELECT *, {_margins} FROM scaled), scored AS (SELECT *, CASE WHEN m1 >= m2 AND m1 >= m3 THEN 1 WHEN m2 >= m3 THEN 2 ELSE 3 END AS predict_index FROM margins)"


def _scored(spark, d) -> DataFrame:
    return predict_linear(_scaled(spark, d), PINNED, margins=True)


def _labelled(spark, d) -> DataFrame:
    return _scored(spark, d).na.drop(subset=[LABEL])


# preparation


@query(f"SELECT key, chain_num_pay_day, {ROUNDED}, dis_index FROM aligned")
def align_labels(spark: SparkSession, d: str) -> DataFrame:
    joined = prep.align_labels(_index(spark, d), fixtures.chain_labels(spark, d), KEY)
    return joined.select(KEY, COUNT, *(r6(c) for c in FEATURES), LABEL)


@query(
    "SELECT c AS \"column\", nan_num, nan_num / n AS nan_pct FROM (SELECT count(*) AS n FROM aligned), ("
    + " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) FILTER ({c} IS NULL) AS nan_num FROM aligned" for c in [COUNT, *FEATURES, LABEL])
    + ") WHERE nan_num > 0"
)
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    return prep.null_profile(_aligned(spark, d), [COUNT, *FEATURES, LABEL])


@query("SELECT key, chain_num_pay_day, dis_index FROM active")
def active_chains(spark: SparkSession, d: str) -> DataFrame:
    return prep.active_rows(_aligned(spark, d), COUNT).select(KEY, COUNT, LABEL)


@query(f"SELECT key, {ROUNDED}, dis_index FROM model")
def model_input(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).select(KEY, *(r6(c) for c in FEATURES), LABEL)


@query("SELECT key, dis_index, dis_index IS NOT NULL AS labelled FROM model")
def labelled_split(spark: SparkSession, d: str) -> DataFrame:
    a, b = prep.split_labelled(_model(spark, d), LABEL)
    return a.select(KEY, LABEL, F.lit(True).alias("labelled")).unionByName(b.select(KEY, LABEL, F.lit(False).alias("labelled")))


SPLIT_SQL = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY dis_index ORDER BY md5(key || '|0'), key) AS r, count(*) OVER (PARTITION BY dis_index) AS n
  FROM model WHERE dis_index IS NOT NULL), split AS (SELECT *, r <= (2 * n + 5) // 10 AS is_test FROM ranked), train AS (SELECT * FROM split WHERE NOT is_test)"""


@query(SPLIT_SQL + " SELECT key, dis_index, is_test FROM split")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return prep.stratified_split(_model(spark, d).na.drop(subset=[LABEL]), KEY, LABEL).select(KEY, LABEL, "is_test")


@query(f" SELECT key, ('0x' || substr(md5(key || '|0'), 1, 8))::BIGINT < {int(0.2 * (1 << 32))} AS is_test FROM model WHERE dis_index IS NOT NULL")
def random_split(spark: SparkSession, d: str) -> DataFrame:
    return prep.random_split(_model(spark, d).na.drop(subset=[LABEL]), KEY).select(KEY, "is_test")


# scaling and quantiles


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, {s6(f'quantile_cont({c}, 0.25)', 'low')}, {s6(f'quantile_cont({c}, 0.5)', 'median')}, {s6(f'quantile_cont({c}, 0.75)', 'high')} FROM model" for c in FEATURES))
def robust_params(spark: SparkSession, d: str) -> DataFrame:
    p = scale.fit_robust(_model(spark, d), FEATURES)
    rows = [(c, p.low[i], p.median[i], p.high[i]) for i, c in enumerate(p.columns)]
    return spark.createDataFrame(rows, "feature string, low double, median double, high double").select("feature", r6("low"), r6("median"), r6("high"))


@query(SCALED_SQL + f" SELECT key, {ROUNDED}, dis_index FROM scaled")
def robust_scaled(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d).select(KEY, *(r6(c) for c in FEATURES), LABEL)


LANDMARKS = 1000
_levels = "[" + ", ".join(repr(k / (LANDMARKS - 1)) for k in range(LANDMARKS)) + "]"


@query(", l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, unnest(quantile_cont({c}, {_levels})) AS value, generate_subscripts({_levels}, 1) - 1 AS place FROM model" for c in FEATURES) + f") SELECT feature, place::INT AS place, {s6('value')} FROM l")
def quantile_landmarks(spark: SparkSession, d: str) -> DataFrame:
    m = scale.fit_quantiles(_model(spark, d), FEATURES, LANDMARKS)
    rows = [(c, k, v) for c, q in zip(m.columns, m.landmarks) for k, v in enumerate(q)]
    return spark.createDataFrame(rows, "feature string, place int, value double").select("feature", "place", r6("value"))


DAY_COLUMNS, DAY_LEVELS, DAY_K = ["l_quantity", "l_extendedprice"], [0.05, 0.25, 0.5, 0.75, 0.95], 1024


@query(
    ", m AS (SELECT count(DISTINCT date_trunc('month', l_shipdate)) AS days, count(l_quantity) AS n0, count(l_extendedprice) AS n1 FROM lineitem)"
    " SELECT c AS \"column\", level, days, n, TRUE AS within FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, n{i} AS n, days FROM m" for i, c in enumerate(DAY_COLUMNS)) + f"), (SELECT unnest({DAY_LEVELS})::DOUBLE AS level)"
)
def quantile_days(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles from stored sketches of each month, merged: the values they hold, and whether their exact ranks are within the stated error."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.date_trunc("month", "l_shipdate").cast("date").alias("month"), *(F.col(c).cast("double").alias(c) for c in DAY_COLUMNS))
    path = scratch_path(spark, "days")
    sketch.write_days(sketch.day_sketches(rows, "month", DAY_COLUMNS, DAY_K), path)
    stored = spark.read.parquet(path)
    found = sketch.sketch_quantiles(sketch.merge_sketches(stored, k=DAY_K), DAY_COLUMNS, DAY_LEVELS)
    held = stored.groupBy("column").agg(F.count_distinct("day").alias("days"), F.sum("n").alias("n"))
    told = []
    for c, q in zip(DAY_COLUMNS, found):
        for level, x in zip(DAY_LEVELS, q):
            far = F.greatest(F.avg((F.col(c) < x).cast("double")) - level, level - F.avg((F.col(c) <= x).cast("double")))
            told.append(F.struct(F.lit(c).alias("column"), F.lit(level).alias("level"), (far <= sketch.rank_error(DAY_K)).alias("within")))
    return rows.agg(F.array(*told).alias("r")).select(F.inline("r")).join(held, "column").select("column", "level", "days", "n", "within")


def _uniform_sql() -> str:
    parts = []
    for c in FEATURES:
        parts.append(
            f", l_{c} AS (SELECT unnest(quantile_cont({c}, {_levels})) AS q, (generate_subscripts({_levels}, 1) - 1) / {LANDMARKS - 1}.0 AS r FROM scaled)"
            f", g_{c} AS (SELECT q, min(r) AS r0, max(r) AS r1, lead(q) OVER (ORDER BY q) AS nq, lead(min(r)) OVER (ORDER BY q) AS nr FROM l_{c} GROUP BY q)"
            f", u_{c} AS (SELECT s.key, CASE WHEN g.q = s.{c} OR g.nq IS NULL THEN (g.r0 + g.r1) / 2 ELSE g.r1 + (s.{c} - g.q) / (g.nq - g.q) * (g.nr - g.r1) END AS {c} FROM scaled s ASOF JOIN g_{c} g ON s.{c} >= g.q)"
        )
    return "".join(parts) + " SELECT key, " + ROUNDED + " FROM " + " JOIN ".join(f"u_{c}" + (" USING (key)" if i else "") for i, c in enumerate(FEATURES))


@query(SCALED_SQL + _uniform_sql())
def quantile_uniform(spark: SparkSession, d: str) -> DataFrame:
    scaled = settled(_scaled(spark, d))
    return scale.apply_quantiles(scaled, scale.fit_quantiles(scaled, FEATURES, LANDMARKS)).select(KEY, *(r6(c) for c in FEATURES))


@query(" SELECT i, j, (i = j)::INT::DOUBLE AS cov FROM range(1, 5) a(i), range(1, 5) b(j) WHERE i <= j")
def pca_whitened_cov(spark: SparkSession, d: str) -> DataFrame:
    """The covariance of the whitened components: identity."""
    scaled = _scaled(spark, d)
    white = scale.apply_whiten(scaled, scale.fit_whiten(scaled, FEATURES, cluster_job.COMPONENTS))
    cells = [(i, j) for i in range(1, 5) for j in range(i, 5)]
    return white.agg(F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), r6(F.covar_samp(f"pc{i}", f"pc{j}"), "cov")) for i, j in cells)).alias("x")).select(F.inline("x"))


@query(SCALED_SQL + " SELECT 4::BIGINT AS components, " + s6(" + ".join(f"var_samp({c})" for c in FEATURES), "variance") + " FROM scaled")
def pca_total_variance(spark: SparkSession, d: str) -> DataFrame:
    w = scale.fit_whiten(_scaled(spark, d), FEATURES, cluster_job.COMPONENTS)
    return spark.createDataFrame([(len(w.rows), sum(w.variances))], "components long, variance double").select("components", r6("variance"))


# files


@query(" SELECT concat(c_name, '链') AS key, chain_num_pay_day, max_pay_day, cv_pay_day IS NULL AS no_cv FROM idx JOIN customer ON key = c_custkey")
def csv_gbk_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    names = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat("c_name", F.lit("链")).alias("name"))
    rows = _index(spark, d).join(names, F.col(KEY) == F.col("c_custkey")).select(F.col("name").alias(KEY), COUNT, *FEATURES)
    path = scratch_path(spark, "gbk")
    tables.write_keyed_csv(rows, path, "GBK")
    back = tables.read_keyed_csv(spark, path, tables.INDEX_SCHEMA, "GBK")
    return back.select(KEY, COUNT, "max_pay_day", F.col("cv_pay_day").isNull().alias("no_cv"))


@query(" SELECT symbol, market_cap, sector, country FROM stocks_")
def raw_csv_typed(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "raw")
    fixtures.stocks(spark, d).select("symbol", F.col("market_cap").cast("string"), "sector", "country").write.csv(path)
    return tables.read_raw_csv(spark, path, "symbol", ["market_cap"], ["sector", "country"])


# scoring with given weights and centres


@query(SCORED_SQL + f" SELECT key, {s6('m1')}, {s6('m2')}, {s6('m3')}, predict_index FROM scored")
def predict_pinned_linear(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select(KEY, r6("m1"), r6("m2"), r6("m3"), "predict_index")


_dist = "[" + ", ".join(" + ".join(f"({c} - ({x})) * ({c} - ({x}))" for c, x in zip(FEATURES, centre)) for centre in CENTRES) + "]"


@query(SCALED_SQL + f", dd AS (SELECT key, {_dist} AS d FROM scaled) SELECT key, (list_position(d, list_min(d)) - 1)::INT AS predict_index, {s6('list_min(d)', 'distance')} FROM dd")
def kmeans_assign_pinned(spark: SparkSession, d: str) -> DataFrame:
    least = F.array_min(F.array(*C.squared_distances(FEATURES, CENTRES)))
    return C.assign_nearest(_scaled(spark, d), FEATURES, CENTRES).select(KEY, "predict_index", r6(least, "distance"))


# evaluation of those predictions

COUNTS_SQL = SCORED_SQL + """, lab AS (SELECT * FROM scored WHERE dis_index IS NOT NULL),
cm AS (SELECT e.c AS expected, p.c AS predicted, (SELECT count(*) FROM lab WHERE dis_index = e.c AND predict_index = p.c) AS n FROM (VALUES (1), (2), (3)) e(c), (VALUES (1), (2), (3)) p(c)),
rep AS (SELECT c AS class, (SELECT sum(n) FROM cm WHERE expected = c) AS s, (SELECT sum(n) FROM cm WHERE predicted = c) AS p, (SELECT sum(n) FROM cm WHERE expected = c AND predicted = c) AS t FROM (VALUES (1), (2), (3)) x(c)),
report AS (SELECT class, s, p, t, CASE WHEN p = 0 THEN 0 ELSE t / p END AS precision, CASE WHEN s = 0 THEN 0 ELSE t / s END AS recall, CASE WHEN p + s = 0 THEN 0 ELSE 2 * t / (p + s) END AS f1,
  CASE WHEN s + p - t = 0 THEN 0 ELSE t / (s + p - t) END AS jaccard FROM rep)"""


@query(COUNTS_SQL + " SELECT expected, predicted, n FROM cm")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_labelled(spark, d), LABEL, "predict_index", CLASSES)


@query(COUNTS_SQL + f" SELECT class, {s6('precision')}, {s6('recall')}, {s6('f1')}, s::BIGINT AS support FROM report")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    report = metrics.class_report(metrics.confusion(_labelled(spark, d), LABEL, "predict_index", CLASSES))
    return report.select("class", r6("precision"), r6("recall"), r6("f1"), F.col("support").cast("long").alias("support"))


_SUMMARY = ["accuracy", *(f"{m}_{k}" for m in ("f1", "precision", "recall", "jaccard") for k in ("macro", "weighted")), "zero_one_loss", "hamming_loss"]


@query(
    COUNTS_SQL + " SELECT " + ", ".join([s6("sum(t) / sum(s)", "accuracy"), *(x for m in ("f1", "precision", "recall", "jaccard") for x in (s6(f"avg({m})", f"{m}_macro"), s6(f"sum({m} * s) / sum(s)", f"{m}_weighted"))),
    s6("1 - sum(t) / sum(s)", "zero_one_loss"), s6("1 - sum(t) / sum(s)", "hamming_loss")]) + " FROM report"
)
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.score_summary(metrics.confusion(_labelled(spark, d), LABEL, "predict_index", CLASSES)).select(*(r6(c) for c in _SUMMARY))


_own = "CASE dis_index WHEN 1 THEN m1 WHEN 2 THEN m2 ELSE m3 END"


@query(
    COUNTS_SQL + f" SELECT {s6(f'avg(-ln(greatest(exp({_own} - greatest(m1, m2, m3)) / (exp(m1 - greatest(m1, m2, m3)) + exp(m2 - greatest(m1, m2, m3)) + exp(m3 - greatest(m1, m2, m3))), 1e-15)))', 'log_loss')}, "
    + s6(f"avg(greatest(0, 1 - ({_own} - CASE dis_index WHEN 1 THEN greatest(m2, m3) WHEN 2 THEN greatest(m1, m3) ELSE greatest(m1, m2) END)))", "hinge_loss") + " FROM lab"
)
def log_hinge_loss(spark: SparkSession, d: str) -> DataFrame:
    return metrics.losses(_labelled(spark, d), LABEL, ["m1", "m2", "m3"], CLASSES).select(r6("log_loss"), r6("hinge_loss"))


@query(" SELECT key, " + ", ".join(f"(dis_index = {c})::INT AS is_{c}" for c in CLASSES) + " FROM model WHERE dis_index IS NOT NULL")
def label_indicators(spark: SparkSession, d: str) -> DataFrame:
    return metrics.indicators(_model(spark, d).na.drop(subset=[LABEL]), LABEL, CLASSES).select(KEY, *(f"is_{c}" for c in CLASSES))


@query(
    COUNTS_SQL + ", bits AS (SELECT " + ", ".join(f"(dis_index = {c})::INT AS t{c}, (m{c} > 0)::INT AS p{c}" for c in CLASSES) + " FROM lab)"
    + f" SELECT {s6('avg((t1 = p1 AND t2 = p2 AND t3 = p3)::INT)', 'subset_accuracy')}, {s6('avg((t1 * p1 + t2 * p2 + t3 * p3) / (greatest(t1, p1) + greatest(t2, p2) + greatest(t3, p3)))', 'jaccard_samples')}, "
    + s6("avg(((t1 <> p1)::INT + (t2 <> p2)::INT + (t3 <> p3)::INT) / 3)", "bit_error") + " FROM bits"
)
def multilabel_scores(spark: SparkSession, d: str) -> DataFrame:
    """A class is called where its raw score is positive."""
    truth, called = [(F.col(LABEL) == c).cast("int") for c in CLASSES], [(F.col(f"m{c}") > 0).cast("int") for c in CLASSES]
    return metrics.multilabel_scores(_labelled(spark, d), truth, called).select(r6("subset_accuracy"), r6("jaccard_samples"), r6("bit_error"))


# curves


def _roc_sql(by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    c = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return (
        COUNTS_SQL + ", long AS (" + " UNION ALL ".join(f"SELECT {k} AS class, (dis_index = {k})::INT AS truth, m{k} AS score FROM lab" for k in CLASSES) + ")"
        + f", counts AS (SELECT {c}score, sum(truth) AS p, sum(1 - truth) AS n FROM long GROUP BY {c}score)"
        + f", points AS (SELECT {c}score, sum(n) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) / sum(n) OVER ({part}) AS fpr, sum(p) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) / sum(p) OVER ({part}) AS tpr FROM counts"
        + f" UNION ALL SELECT {c}NULL, 0, 0" + (f" FROM counts {group})" if by else ")")
        + f", steps AS (SELECT {c}(fpr - lag(fpr) OVER ({part}ORDER BY fpr, tpr)) * (tpr + lag(tpr) OVER ({part}ORDER BY fpr, tpr)) / 2 AS a FROM points)"
    )


def _points(spark, d, by: list[str]) -> DataFrame:
    return curves.roc_points(curves.long_scores(_labelled(spark, d), LABEL, ["m1", "m2", "m3"], CLASSES), by)


@query(_roc_sql("class") + f" SELECT class, {s6('score')}, {s6('fpr')}, {s6('tpr')} FROM points")
def roc_points(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d, ["class"]).select("class", r6("score"), r6("fpr"), r6("tpr"))


@query(_roc_sql("class") + f" SELECT class, {s6('sum(a)', 'auc')} FROM steps GROUP BY class")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return curves.auc(_points(spark, d, ["class"]), ["class"]).select("class", r6("auc"))


@query(_roc_sql("") + f" SELECT count(*) AS points, {s6('sum(a)', 'auc')} FROM steps")
def roc_micro(spark: SparkSession, d: str) -> DataFrame:
    points = settled(_points(spark, d, []))
    return curves.auc(points, []).crossJoin(points.agg(F.count("*").alias("points"))).select("points", r6("auc"))  # one row each


@query(
    _roc_sql("class") + ", ends AS (SELECT class, fpr, min(tpr) AS low, max(tpr) AS tpr FROM points GROUP BY ALL)"
    ", nxt AS (SELECT *, lead(fpr) OVER (PARTITION BY class ORDER BY fpr) AS nf, lead(low) OVER (PARTITION BY class ORDER BY fpr) AS nl FROM ends)"
    ", grid AS (SELECT DISTINCT x.class, p.fpr AS f FROM points p, (SELECT DISTINCT class FROM points) x)"
    ", hit AS (SELECT grid.f, CASE WHEN nf IS NULL THEN tpr ELSE tpr + (f - fpr) * (nl - tpr) / (nf - fpr) END AS t FROM grid ASOF JOIN nxt ON grid.class = nxt.class AND grid.f >= nxt.fpr)"
    f" SELECT {s6('f', 'fpr')}, {s6('avg(t)', 'tpr')} FROM hit GROUP BY f"
)
def roc_macro(spark: SparkSession, d: str) -> DataFrame:
    return curves.roc_macro(_points(spark, d, ["class"]), "class").select(r6("fpr"), r6("tpr"))


# k-modes and k-prototypes


def _differ(cats: list[str], a: str, b: str) -> str:
    return " + ".join(f"({a}.{c} <> {b}.{c})::INT" for c in cats)


def _cao_sql(source: str, cats: list[str], nums: list[str]) -> str:
    """Table p0 of the Cao start."""
    cols = [*nums, *cats]
    sql = ", b AS (SELECT s.*, " + " + ".join(f"(SELECT count(*) FROM {source} t WHERE t.{c} = s.{c})" for c in cats) + f" AS density FROM {source} s)"
    for k in range(4):
        far = "1" if not k else ("least(" + ", ".join(_differ(cats, "b", f"z{j}") for j in range(k)) + ")" if k > 1 else "(" + _differ(cats, "b", "z0") + ")")
        sql += f", z{k} AS MATERIALIZED (SELECT {', '.join(f'b.{c}' for c in cols)} FROM b" + "".join(f", z{j}" for j in range(k)) + f" ORDER BY {far} * b.density DESC, b.key LIMIT 1)"
    return sql + ", p0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS cluster, * FROM z{k}" for k in range(4)) + ")"


def _huang_sql(source: str, cats: list[str], seed: int, tag: str) -> str:
    """Table {tag}p0 of a Huang start: values drawn by the least digest, drafts moved to the nearest row not taken."""
    sql = ""
    for k in range(4):
        draws = ", ".join(f"(SELECT {c} FROM {source} ORDER BY md5('{seed} {k} {c}|' || key), {c} LIMIT 1) AS {c}" for c in cats)
        free = "".join(f" AND s.key <> (SELECT key FROM {tag}z{j})" for j in range(k))
        sql += f", {tag}d{k} AS MATERIALIZED (SELECT {draws}), {tag}z{k} AS MATERIALIZED (SELECT s.key, {', '.join(f's.{c}' for c in cats)} FROM {source} s, {tag}d{k} d WHERE TRUE{free} ORDER BY {_differ(cats, 's', 'd')}, s.key LIMIT 1)"
    return sql + f", {tag}p0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS cluster, {', '.join(cats)} FROM {tag}z{k}" for k in range(4)) + ")"


def _modes_sql(source: str, cats: list[str], nums: list[str], gamma: str | None, tag: str = "", steps: int = STEPS) -> str:
    """Batch iterations from {tag}p0, unrolled; ``stop`` has the one at which the cost no longer falls (none if it still does)."""
    sql, weight = "", gamma or "1"
    near = (" + ".join(f"(s.{c} - p.{c}) * (s.{c} - p.{c})" for c in nums) + f" + {weight} * (" if nums else "(") + _differ(cats, "s", "p") + ")"
    for t in range(steps + 1):
        a, j, p = f"{tag}a{t}", f"{tag}j{t}", f"{tag}p{t}"
        sql += f", {a} AS MATERIALIZED (SELECT key, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT s.key, p.cluster, {near} AS d FROM {source} s, {p} p) GROUP BY key)"
        if t < steps:
            sql += f", {j} AS MATERIALIZED (SELECT s.*, a.cluster FROM {source} s JOIN {a} a USING (key))"
            modes = [f"(SELECT cluster, arg_min(v, (-n, v)) AS {c} FROM (SELECT cluster, {c} AS v, count(*) AS n FROM {j} GROUP BY ALL) GROUP BY cluster) x{i}" for i, c in enumerate(cats)]
            means = [f"(SELECT cluster, {', '.join(f'avg({c}) AS {c}' for c in nums)} FROM {j} GROUP BY cluster) y"] if nums else []
            sql += f", {tag}p{t + 1} AS MATERIALIZED (SELECT p.cluster, {', '.join([*(f'coalesce(y.{c}, p.{c}) AS {c}' for c in nums), *(f'coalesce(x{i}.{c}, p.{c}) AS {c}' for i, c in enumerate(cats))])} FROM {p} p " + " ".join(f"LEFT JOIN {m} USING (cluster)" for m in [*means, *modes]) + ")"
    sql += f", {tag}paid AS (" + " UNION ALL ".join(f"SELECT {t} AS t, sum(d)::DOUBLE AS cost FROM {tag}a{t}" for t in range(steps + 1)) + ")"
    return sql + f", {tag}stop AS (SELECT min(t) AS t, min_by(last, t) AS cost FROM (SELECT t, cost, lag(cost) OVER (ORDER BY t) AS last FROM {tag}paid) WHERE cost >= last - 1e-9 * abs(last))"


def _at_stop(columns: str, source: str) -> str:
    """The rows of the unrolled steps' tables at the step that ``stop`` has."""
    return "(" + " UNION ALL ".join(f"SELECT {t} AS t, {columns} FROM {source}{t}" for t in range(1, STEPS + 1)) + ") JOIN stop USING (t)"


_PARTS = ", parts_ AS (SELECT p_partkey AS key, p_brand, p_type, p_size::VARCHAR AS p_size FROM part)"
KMODES_SQL = _PARTS + _cao_sql("parts_", ATTRS, []) + _modes_sql("parts_", ATTRS, [], None)
PROTO_SQL = ", gamma_ AS (SELECT 0.5 * stddev_pop(market_cap) AS g FROM stocks_)" + _cao_sql("stocks_", ["sector", "country"], ["market_cap"]) + _modes_sql("stocks_", ["sector", "country"], ["market_cap"], "(SELECT g FROM gamma_)")


def _kmodes(spark, d) -> tuple[DataFrame, C.Prototypes]:
    rows = settled(fixtures.categories(spark, d))
    return rows, C.fit_kmodes(rows, "key", ATTRS, 4, "cao")


def _kprototypes(spark, d) -> tuple[DataFrame, C.Prototypes]:
    rows, cats = settled(fixtures.stocks(spark, d)), ["sector", "country"]
    return rows, C.fit_prototypes(rows, cats, C.cao_init(rows, "key", cats, 4, ["market_cap"]), ["market_cap"])


@query(_PARTS + _cao_sql("parts_", ATTRS, []) + " SELECT cluster, p_brand, p_type, p_size FROM p0")
def cao_init(spark: SparkSession, d: str) -> DataFrame:
    centres = C.cao_init(fixtures.categories(spark, d), "key", ATTRS, 4)
    return spark.createDataFrame([(i, *c) for i, c in enumerate(centres)], "cluster int, p_brand string, p_type string, p_size string")


@query(KMODES_SQL + f" SELECT key, cluster FROM {_at_stop('key, cluster', 'a')}")
def kmodes(spark: SparkSession, d: str) -> DataFrame:
    return C.assign_prototypes(*_kmodes(spark, d)).select("key", "cluster")


@query(KMODES_SQL + f", last_ AS (SELECT * FROM {_at_stop('cluster, ' + ', '.join(ATTRS), 'p')}) SELECT cluster, attr, value FROM (" + " UNION ALL ".join(f"SELECT cluster, '{c}' AS attr, {c} AS value FROM last_" for c in ATTRS) + ")")
def kmodes_modes(spark: SparkSession, d: str) -> DataFrame:
    return C.centre_table(spark, _kmodes(spark, d)[1])


@query(PROTO_SQL + f" SELECT symbol, cluster FROM {_at_stop('key, cluster', 'a')} JOIN stocks_ USING (key)")
def kprototypes(spark: SparkSession, d: str) -> DataFrame:
    return C.assign_prototypes(*_kprototypes(spark, d)).select("symbol", "cluster")


@query(PROTO_SQL + " SELECT paid.t::INT AS iteration, round(paid.cost, 2) AS cost FROM paid, stop WHERE paid.t < stop.t")
def kprototypes_cost(spark: SparkSession, d: str) -> DataFrame:
    costs = _kprototypes(spark, d)[1].costs
    return spark.createDataFrame(list(enumerate(costs)), "iteration int, cost double").select("iteration", F.round("cost", 2).alias("cost"))


HUANG_STARTS, HUANG_STEPS = 5, 10


def _huang_best_sql() -> str:
    """``won`` has the clusters of the Huang start that costs least, the first of equal ones."""
    sql = _PARTS
    for i in range(HUANG_STARTS):
        sql += _huang_sql("parts_", ATTRS, i, f"h{i}_") + _modes_sql("parts_", ATTRS, [], None, f"h{i}_", HUANG_STEPS)
    stops = " UNION ALL ".join(f"SELECT {i} AS i, t, cost FROM h{i}_stop" for i in range(HUANG_STARTS))
    steps = " UNION ALL ".join(f"SELECT {i} AS i, {t} AS t, key, cluster FROM h{i}_a{t}" for i in range(HUANG_STARTS) for t in range(1, HUANG_STEPS + 1))
    return sql + f", least AS MATERIALIZED (SELECT i, t FROM ({stops}) ORDER BY cost, i LIMIT 1), won AS (SELECT key, cluster FROM ({steps}) JOIN least USING (i, t))"


@query(_huang_best_sql() + " SELECT key, cluster FROM won")
def kmodes_huang(spark: SparkSession, d: str) -> DataFrame:
    """k-modes from the best of five Huang starts: the cluster of each row."""
    rows = settled(fixtures.categories(spark, d))
    return C.assign_prototypes(rows, C.fit_kmodes(rows, "key", ATTRS, 4, "huang", HUANG_STARTS)).select("key", "cluster")


# fits


@query(SPLIT_SQL + " SELECT count(*) AS train_rows, TRUE AS optimal FROM train")
def classify_kkt(spark: SparkSession, d: str) -> DataFrame:
    """Rows trained on, and whether the fit meets the optimality conditions within a thousandth of the regularisation."""
    model = settled(_model(spark, d))
    state = classify_job.fit(model, **CLOSE)
    train = prep.stratified_split(model.na.drop(subset=[LABEL]), KEY, LABEL).where("NOT is_test")
    worst = kkt_residual(scale.apply_robust(train, state.scaler), state.model, LABEL, state.regularisation)
    return spark.createDataFrame([(state.train_rows, worst < 0.001)], "train_rows long, optimal boolean")


TRAIN_SQL = SPLIT_SQL + _params_sql("params", "train")


#: The classifier's fit over the training part, and how closely the queries' fits approach the optimum.
CLASSIFY_SQL = TRAIN_SQL + _scaled_sql("train_scaled", "params", "train") + fit_sql.softmax("train_scaled", "dis_index")
CLOSE = {"steps": 20}
_PROJECT = ", project AS (SELECT key, coalesce(max_pay_day, 0) AS max_pay_day, coalesce(cv_pay_day, 0) AS cv_pay_day, coalesce(std_pay_day, 0) AS std_pay_day, coalesce(quarter_avg_std, 0) AS quarter_avg_std FROM idx WHERE chain_num_pay_day >= 1)"
_TOLD = f" SELECT key, {ROUNDED}, predict_index FROM told"


def _told(df: DataFrame, *more: str) -> DataFrame:
    return df.select(KEY, *(r6(c) for c in FEATURES), *more, "predict_index")


@query(CLASSIFY_SQL + _scaled_sql("scaled_m", "params", "model") + fit_sql.classified("scaled_m", ", dis_index") + f" SELECT key, {ROUNDED}, dis_index, predict_index FROM told", recursive=True)
def classify_scored(spark: SparkSession, d: str) -> DataFrame:
    model = settled(_model(spark, d))
    return _told(classify_job.score(model, classify_job.fit(model, **CLOSE)), LABEL)


@query(CLASSIFY_SQL + _PROJECT + _scaled_sql("scaled_p", "params", "project", "") + fit_sql.classified("scaled_p") + _TOLD, recursive=True)
def same_project_classify(spark: SparkSession, d: str) -> DataFrame:
    return _told(classify_job.score_project(_index(spark, d), classify_job.fit(settled(_model(spark, d)), **CLOSE)))


@query(CLASSIFY_SQL + _PROJECT + _params_sql("params_p", "project") + _scaled_sql("scaled_p", "params_p", "project", "") + fit_sql.classified("scaled_p") + _TOLD, recursive=True)
def new_project_classify(spark: SparkSession, d: str) -> DataFrame:
    return _told(classify_job.score_project(_index(spark, d), classify_job.fit(settled(_model(spark, d)), **CLOSE), refit=True))



@query()
def ovr_scores(spark: SparkSession, d: str) -> DataFrame:
    """One-vs-rest decision values and classes of the rows held out."""
    return classify_job.one_vs_rest(_model(spark, d)).select(KEY, LABEL, "m1", "m2", "m3", "predict_index")


@query(
    ", drawn AS (SELECT key, dis_index FROM model WHERE dis_index IS NOT NULL AND ('0x' || substr(md5(key || '|0'), 1, 8))::BIGINT >= 858993459)"
    " SELECT class::INT AS class, (SELECT count(*) FROM drawn) AS rows, TRUE AS optimal FROM range(1, 4) c(class)"
)
def ovr_kkt(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each class is fitted on against the rest, and whether the fit meets its optimality conditions within a thousandth of the regularisation."""
    fitted, train, _ = classify_job.fit_one_vs_rest(_model(spark, d))
    return ovr_residuals(train, fitted, LABEL).select("class", "rows", (F.col("residual") <= 0.05).alias("optimal"))


#: The fit over the model's rows: components, landmarks, levels and centres.
CLUSTER_SQL = SCALED_SQL + fit_sql.whitening("scaled") + fit_sql.components("white", "scaled") + fit_sql.landmarks("marks", "white") + fit_sql.uniform("levels_", "white", "marks") + fit_sql.kmeans("levels_")


@query(" SELECT count(*) AS rows, 7::BIGINT AS clusters, 0::BIGINT AS misplaced FROM model")
def kmeans_fit_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Rows, clusters used, and rows that are nearer to another cluster's mean than to their centre by more than rounding."""
    rows = settled(_model(spark, d).select(KEY, *FEATURES))
    state = cluster_job.fit(rows)
    reduced = cluster_job.reduce(scale.apply_robust(rows, state.scaler), state.whitening, state.quantiles)
    placed = C.assign_nearest(reduced, list(state.kmeans.columns), state.kmeans.centres)
    d2 = F.array(*C.squared_distances(list(state.kmeans.columns), state.kmeans.centres))
    far = (F.get(d2, F.col("predict_index")) > F.array_min(d2) + 1e-12).cast("int")
    return placed.agg(F.count("*").alias("rows"), F.count_distinct("predict_index").alias("clusters"), F.sum(far).alias("misplaced"))


@query(CLUSTER_SQL + fit_sql.clustered("levels_") + _TOLD, recursive=True)
def cluster_scored(spark: SparkSession, d: str) -> DataFrame:
    rows = settled(_model(spark, d).select(KEY, *FEATURES))
    return _told(cluster_job.assign(rows, cluster_job.fit(rows)))


@query(
    CLUSTER_SQL + _PROJECT + _scaled_sql("scaled_p", "params", "project", "") + fit_sql.components("white_p", "scaled_p") + fit_sql.uniform("levels_p", "white_p", "marks") + fit_sql.clustered("levels_p") + _TOLD,
    recursive=True,
)
def same_project_cluster(spark: SparkSession, d: str) -> DataFrame:
    rows = settled(_model(spark, d).select(KEY, *FEATURES))
    return _told(cluster_job.assign_project(_index(spark, d), cluster_job.fit(rows)))


@query(
    CLUSTER_SQL + _PROJECT + _params_sql("params_p", "project") + _scaled_sql("scaled_p", "params_p", "project", "") + fit_sql.components("white_p", "scaled_p") + fit_sql.landmarks("marks_p", "white_p")
    + fit_sql.uniform("levels_p", "white_p", "marks_p") + fit_sql.clustered("levels_p") + _TOLD,
    recursive=True,
)
def new_project_cluster(spark: SparkSession, d: str) -> DataFrame:
    rows = settled(_model(spark, d).select(KEY, *FEATURES))
    return _told(cluster_job.assign_project(_index(spark, d), cluster_job.fit(rows), refit=True))


def _stored(spark: SparkSession, state: score_job.State) -> score_job.State:
    """The state as it comes back from its table."""
    path = scratch_path(spark, "state")
    return score_job.load_state(spark, path, score_job.store_state(spark, path, state))


@query(ORACLE_SQL["same_project_classify"].removeprefix(RECURSIVE), recursive=True)
def stored_state_classify(spark: SparkSession, d: str) -> DataFrame:
    """The same project, scored with the state read from its table."""
    return _told(score_job.score(_index(spark, d), _stored(spark, classify_job.fit(settled(_model(spark, d)), **CLOSE))))


@query(ORACLE_SQL["new_project_cluster"].removeprefix(RECURSIVE), recursive=True)
def stored_state_cluster(spark: SparkSession, d: str) -> DataFrame:
    """A new project, scored with the state read from its table and refitted, stored and read again."""
    state, index = _stored(spark, cluster_job.fit(settled(_model(spark, d).select(KEY, *FEATURES)))), _index(spark, d)
    return _told(score_job.score(index, _stored(spark, score_job.refitted(index, state))))


# streams


def _arrivals(spark: SparkSession, d: str, parts: int = 3) -> tuple[str, list[Callable[[], None]]]:
    """A folder that a stream reads, and what writes the feature table's parts there, one after the other, with a project for each row.

    The table is written first and a part by as many tasks as read it: one file would be one task's, with all that leads to it.
    """
    path = scratch_path(spark, "arrivals")
    rows = settled(_index(spark, d).select(F.col(KEY).cast("string").alias(KEY), COUNT, *FEATURES, F.when(F.col(KEY) % 5 > 0, F.concat(F.lit("p"), F.col(KEY) % 5)).alias("project")))
    return path, [lambda part=part: rows.where(F.col(KEY).cast("long") % parts == part).write.mode("append").parquet(path) for part in range(parts)]


_QUARTILES = ", ".join(f"{s6(f'quantile_cont({c}, {q})', f'{n}_{c}')}" for c in FEATURES for n, q in (("low", 0.25), ("median", 0.5), ("high", 0.75)))


@query(_PROJECT + f" SELECT CASE WHEN key % 5 > 0 THEN 'p' || (key % 5) END AS project, count(*) AS n, 0.0::DOUBLE AS rank_error, {_QUARTILES} FROM project GROUP BY ALL")
def refit_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The scaler of each project as its rows arrive part by part, after the last of them."""
    out = scratch_path(spark, "refits")
    path, parts = _arrivals(spark, d)
    for write in parts:
        write()
        writer = refit.write_exact_refits(refit.read_project_arrivals(spark, path), f"{out}/rows", f"{out}/kept", f"{out}/log")
        writer.trigger(availableNow=True).start().awaitTermination()
    told = [F.get(item, F.lit(j)).alias(f"{item}_{c}") for j, c in enumerate(FEATURES) for item in ("low", "median", "high")]
    found = refit.latest_refits(spark, f"{out}/rows").select("project", "n", "rank_error", *told)
    return found.select("project", "n", "rank_error", *(r6(c) for c in found.columns[3:]))


_margins_p = ", ".join(f"({' + '.join(f'({w}) * {c}' for w, c in zip(row, FEATURES))} + ({b})) AS m{i + 1}" for i, (row, b) in enumerate(zip(PINNED.weights, PINNED.intercepts)))


@query(
    _params_sql("params", "model") + _PROJECT + _scaled_sql("scaled_p", "params", "project", "") + f", margins AS (SELECT *, {_margins_p} FROM scaled_p)"
    f" SELECT key::VARCHAR AS key, {ROUNDED}, CASE WHEN m1 >= m2 AND m1 >= m3 THEN 1 WHEN m2 >= m3 THEN 2 ELSE 3 END AS predict_index FROM margins"
)
def stream_scored(spark: SparkSession, d: str) -> DataFrame:
    """Arriving rows scored with the model's scaler and the given weights."""
    state = classify_job.ClassifierState(scale.fit_robust(_model(spark, d), FEATURES), PINNED, 0.0, 0)
    out = scratch_path(spark, "scores")
    path, parts = _arrivals(spark, d)
    for write in parts:
        write()
    stream.write_scores(stream.score_stream(stream.read_arrivals(spark, path), state), f"{out}/rows", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return _told(spark.read.parquet(f"{out}/rows"))
