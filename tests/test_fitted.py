"""What fitted models give for whole tables against SQL over their own coefficients and centres."""

import os

import pytest

from paychain.functions.metrics import confusion, score_summary
from paychain.jobs import classify_job, cluster_job, queries
from paychain.operators import scale
from paychain.sources.fixtures import PRELUDE
from paychain.sources.scratch import settled
from paychain.sources.tables import FEATURES, KEY, LABEL

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.fixture(scope="module")
def model(spark):
    return settled(queries._model(spark, SF))


@pytest.fixture(scope="module")
def classifier(model):
    return classify_job.fit(model)


def put_weights(con, fitted):
    con.execute("CREATE OR REPLACE TABLE weights (class INT, attr VARCHAR, w DOUBLE)")
    con.executemany("INSERT INTO weights VALUES (?, ?, ?)", [(c, a, w) for c, row in zip(fitted.classes, fitted.weights) for a, w in zip(fitted.columns, row)])
    con.execute("CREATE OR REPLACE TABLE intercepts (class INT, b DOUBLE)")
    con.executemany("INSERT INTO intercepts VALUES (?, ?)", list(zip(fitted.classes, fitted.intercepts)))


def margins_sql(source):
    """(key, class, m) of each row of ``source``."""
    return f"(SELECT key, class, b + sum(x * w) AS m FROM (UNPIVOT (SELECT key, {', '.join(FEATURES)} FROM {source}) ON {', '.join(FEATURES)} INTO NAME attr VALUE x) JOIN weights USING (attr) JOIN intercepts USING (class) GROUP BY key, class, b)"


def classes_of(con, ctes, source):
    return dict(con.execute(PRELUDE + ctes + f" SELECT key, arg_min(class, (-m, class)) FROM {margins_sql(source)} GROUP BY key").fetchall())


def predicted(df):
    return {r[KEY]: r["predict_index"] for r in df.select(KEY, "predict_index").collect()}


def test_classes_of_all_rows(con, model, classifier):
    put_weights(con, classifier.model)
    theirs = classes_of(con, queries.TRAIN_SQL + queries._scaled_sql("scored", "params", "model"), "scored")
    assert theirs and predicted(classify_job.score(model, classifier)) == theirs
    assert len(set(theirs.values())) > 1


@pytest.mark.parametrize("refit", [False, True])
def test_classes_of_a_project(spark, con, classifier, refit):
    put_weights(con, classifier.model)
    params = queries._PROJECT + queries._params_sql("params", "project") if refit else queries.TRAIN_SQL + queries._PROJECT
    theirs = classes_of(con, params + queries._scaled_sql("scored", "params", "project", ""), "scored")
    assert theirs and predicted(classify_job.score_project(queries._index(spark, SF), classifier, refit)) == theirs


def test_decision_values_of_rows_held_out(con, model):
    fitted, train, test = classify_job.fit_one_vs_rest(model)
    put_weights(con, fitted)
    scored = queries.predict_linear(test, fitted, margins=True)
    con.register("held", test.toPandas())
    theirs = {(k, c): m for k, c, m in con.execute(f"SELECT * FROM {margins_sql('held')}").fetchall()}
    ours = {(r[KEY], c): r[f"m{i + 1}"] for r in scored.collect() for i, c in enumerate(fitted.classes)}
    assert ours.keys() == theirs.keys() and all(ours[k] == pytest.approx(theirs[k], abs=1e-9) for k in ours)
    assert not {r[KEY] for r in train.select(KEY).collect()} & {k for k, _ in ours}


def test_classes_are_learned(model, classifier):
    """Labels follow the greatest pay day but for a seventh of the rows, so most rows held out must come out right."""
    held = classify_job.stratified_split(model.na.drop(subset=[LABEL]), KEY, LABEL).where("is_test")
    counts = confusion(classify_job.score(held, classifier), LABEL, "predict_index", classify_job.CLASSES)
    assert score_summary(counts).first()["accuracy"] > 0.6


def test_clusters_of_all_rows(spark, con, model):
    rows = model.select(KEY, *FEATURES)
    state = cluster_job.fit(rows, n_init=3)
    columns = list(state.kmeans.columns)
    con.register("reduced", cluster_job.reduce(scale.apply_robust(rows, state.scaler), state.whitening, state.quantiles).select(KEY, *columns).toPandas())
    con.execute(f"CREATE OR REPLACE TABLE centres (cluster INT, {', '.join(f'{c} DOUBLE' for c in columns)})")
    con.executemany(f"INSERT INTO centres VALUES ({', '.join('?' * (1 + len(columns)))})", [(i, *c) for i, c in enumerate(state.kmeans.centres)])
    far = " + ".join(f"(r.{c} - z.{c}) ** 2" for c in columns)
    con.execute(f"CREATE OR REPLACE TABLE placed AS SELECT key, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT r.key, z.cluster, {far} AS d FROM reduced r, centres z) GROUP BY key")
    assert predicted(cluster_job.assign(rows, state)) == dict(con.execute("SELECT key, cluster FROM placed").fetchall())
    assert con.execute("SELECT sum(d) FROM placed").fetchone()[0] == pytest.approx(state.kmeans.cost, rel=1e-6)
    means = con.execute(f"SELECT {', '.join(f'avg({c})' for c in columns)} FROM reduced JOIN placed USING (key) GROUP BY cluster ORDER BY cluster").fetchall()
    assert len(means) == cluster_job.CLUSTERS  # the fit stops where centres hardly move, so they are near the means
    assert all(a == pytest.approx(b, abs=0.02) for a, b in zip(means, state.kmeans.centres))


@pytest.mark.parametrize("refit", [False, True])
def test_clusters_of_a_project(spark, model, refit):
    rows = model.select(KEY, *FEATURES)
    state = cluster_job.fit(rows, n_init=1)
    index = queries._index(spark, SF)
    found = predicted(cluster_job.assign_project(index, state, refit))
    project = cluster_job.project_rows(index)
    scaler = scale.fit_robust(project, FEATURES) if refit else state.scaler
    white = scale.apply_whiten(scale.apply_robust(project, scaler), state.whitening)
    quantiles = scale.fit_quantiles(white, list(state.kmeans.columns)) if refit else state.quantiles
    for r in scale.apply_quantiles(white, quantiles).collect():
        d = [sum((r[c] - z) ** 2 for c, z in zip(state.kmeans.columns, centre)) for centre in state.kmeans.centres]
        assert found[r[KEY]] == d.index(min(d))
    assert len(found) == project.count()
