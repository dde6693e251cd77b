"""A stream is scored as the table is."""

from paychain.jobs.classify_job import ClassifierState, score_project
from paychain.operators.classify import LinearModel
from paychain.operators.scale import RobustParams
from paychain.sources.tables import FEATURES, INDEX_SCHEMA
from paychain.streaming.score import read_arrivals, score_stream, write_scores


def test_stream_equals_table(spark, tmp_path):
    rows = [("a", 1, 1.0, 2.0, None, 4.0), ("b", 0, 1.0, 1.0, 1.0, 1.0), ("c", 3, 9.0, float("nan"), 1.0, 1.0), ("d", None, 1.0, 1.0, 1.0, 1.0)]
    spark.createDataFrame(rows, INDEX_SCHEMA).write.parquet(str(tmp_path / "in"))
    n = len(FEATURES)
    state = ClassifierState(RobustParams(tuple(FEATURES), (0.0,) * n, (1.0,) * n, (2.0,) * n), LinearModel(tuple(FEATURES), (1, 2), ((1.0,) * n, (-1.0,) * n), (0.0, 0.5)), 1.0, 4)
    query = write_scores(score_stream(read_arrivals(spark, str(tmp_path / "in")), state), str(tmp_path / "out"), str(tmp_path / "log")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["key"] for r in got.collect()) == ["a", "c"]
    want = score_project(spark.createDataFrame([(*r[:3], None if r[3] != r[3] else r[3], *r[4:]) for r in rows], INDEX_SCHEMA), state)
    assert got.exceptAll(want).count() == 0
