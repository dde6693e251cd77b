"""Stored states: written whole, never changed, and read by another session."""

import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paychain.jobs import classify_job, cluster_job, score_job
from paychain.operators.classify import LinearModel
from paychain.operators.cluster import KMeansFit
from paychain.operators.scale import QuantileMap, RobustParams, Whitening
from paychain.sources.states import Numbers, save_state, state_table, versions
from paychain.sources.tables import FEATURES, INDEX_SCHEMA, KEY
from test_jobs import index_file

N = len(FEATURES)
SCALER = RobustParams(tuple(FEATURES), (0.1, -0.0, 1 / 3, 5e-324), (1.0, 2.0, 3.0, 1e308), (float("inf"), 2.0, 4.0, 1e308))
CLASSIFIER = classify_job.ClassifierState(SCALER, LinearModel(tuple(FEATURES), (3, 1, 2), ((0.1,) * N, (1 / 7,) * N, (-2.0,) * N), (0.0, 0.5, 1 / 3)), 1 / 2400, 800)
CLUSTER = cluster_job.ClusterState(
    SCALER,
    Whitening(tuple(FEATURES), (1.0, 2.0, 3.0, 4.0), (2.5, 0.1), ((0.1, 0.2, 0.3, 0.4), (1.0, -1.0, 0.0, 0.0))),
    QuantileMap(("pc1", "pc2"), ((0.0, 1 / 3, 2.0), (5.0, 6.0))),
    KMeansFit(("pc1", "pc2"), [(0.1, 0.2), (0.3, 1 / 9)], 12.5),
)


@pytest.mark.parametrize("state", [CLASSIFIER, CLUSTER])
def test_all_numbers_come_back(spark, tmp_path, state):
    path = str(tmp_path / "state")
    assert versions(spark, path) == []
    with pytest.raises(ValueError, match="no state"):
        score_job.load_state(spark, path)
    assert score_job.store_state(spark, path, state) == 1
    assert score_job.load_state(spark, path) == state
    other = CLUSTER if state is CLASSIFIER else CLASSIFIER
    assert score_job.store_state(spark, path, other) == 2 and versions(spark, path) == [1, 2]
    assert score_job.load_state(spark, path) == other and score_job.load_state(spark, path, 1) == state
    with pytest.raises(ValueError, match="no version 3"):
        score_job.load_state(spark, path, 3)


def test_half_a_version_is_not_seen(spark, tmp_path):
    path = tmp_path / "state"
    score_job.store_state(spark, str(path), CLASSIFIER)
    (path / "state-half").mkdir()
    (path / "state-half" / "part-0.parquet").write_bytes(b"not yet")  # a writer that died before its marker
    (path / "versions" / ".state-half").write_text("state-half")
    assert versions(spark, str(path)) == [1] and score_job.load_state(spark, str(path)) == CLASSIFIER


def test_writers_at_once_get_versions_of_their_own(spark, tmp_path):
    path = str(tmp_path / "state")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda k: save_state(spark, path, [("mine", "p", "x", 0, 0, None, k)]), range(8)))
    assert sorted(got) == versions(spark, path) == list(range(1, 9))
    assert {(v, Numbers(state_table(spark, path, v)).vector("p", "x")[0]) for v in got} == {(v, float(k)) for k, v in enumerate(got)}
    with pytest.raises(ValueError, match="known kind"):
        score_job.load_state(spark, path)


def test_another_session_scores_what_the_fit_scored(spark, tmp_path):
    """The mains fit and save; score_job, in a process of its own, writes the scores that the fitting main wrote."""
    model, project, out = index_file(tmp_path / "model.csv"), index_file(tmp_path / "project.csv", 60), str(tmp_path / "out")
    cluster_job.main(model, project, out)
    read = lambda path: spark.read.options(encoding="GBK", header=True, inferSchema=True).csv(path)
    code = f"import sys; sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})\n" + (
        "from pyspark.sql import SparkSession\n"
        f"SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').config('spark.checkpoint.dir', {'file://' + str(tmp_path / 'shared')!r}).getOrCreate()\n"
        "from paychain.jobs import score_job\n"
        f"score_job.main({out + '/state'!r}, {project!r}, {out + '/later'!r})\n"
        f"score_job.main({out + '/state'!r}, {project!r}, {out + '/other'!r}, 'new')\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    for mine, theirs in (("later", "same_project"), ("other", "new_project")):
        a, b = read(f"{out}/{mine}/scores"), read(f"{out}/{theirs}")
        assert a.columns == b.columns == [KEY, *FEATURES, "predict_index"] and a.count() == 57
        assert a.exceptAll(b).count() == 0
    kept, fresh = score_job.load_state(spark, f"{out}/state"), score_job.load_state(spark, f"{out}/other/state")
    assert kept.kmeans == fresh.kmeans and kept.whitening == fresh.whitening and kept.scaler != fresh.scaler


def test_classifier_states_score(spark, tmp_path):
    rows = [(f"k{i}", 1 + i % 2, float(i), float(i % 5), 1.0, None) for i in range(40)] + [("gone", 0, 1.0, 1.0, 1.0, 1.0)]
    index = spark.createDataFrame(rows, INDEX_SCHEMA)
    score_job.store_state(spark, str(tmp_path / "s"), CLASSIFIER)
    state = score_job.load_state(spark, str(tmp_path / "s"))
    for refit in (False, True):
        mine = score_job.score(index, score_job.refitted(index, state) if refit else state)
        theirs = classify_job.score_project(index, CLASSIFIER, refit)
        assert mine.count() == 40 and mine.exceptAll(theirs).count() == 0
    assert score_job.refitted(index.where(F.lit(False)), state).scaler.median == (0.0,) * N
