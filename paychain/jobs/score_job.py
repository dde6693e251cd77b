"""Scoring of a later project with a stored state; a spark-submit main.

    score_job.py STATE PROJECT_INDEX OUT [same|new] [encoding] [exact|sketch] [version]

``same``: the project is scored with all of the state. ``new``: its own rows give the scaler (and the landmarks of clusters), the components,
centres and coefficients stay; what was refitted is saved as the next version of OUT/state. Nothing is fitted
that the state has. The last version is taken unless one is named.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from paychain.jobs import classify_job, cluster_job
from paychain.sources.scratch import settled
from paychain.sources.states import Numbers, save_state, state_table
from paychain.sources.tables import INDEX_SCHEMA, read_keyed_csv, write_keyed_csv

State = classify_job.ClassifierState | cluster_job.ClusterState


def load_state(spark: SparkSession, path: str, version: int | None = None) -> State:
    numbers = Numbers(state_table(spark, path, version))
    for job in (classify_job, cluster_job):
        if numbers.kinds == {job.KIND}:
            return job.state_of(numbers)
    raise ValueError(f"{path} has no state of one known kind but of {sorted(numbers.kinds)}")


def store_state(spark: SparkSession, path: str, state: State) -> int:
    """Save a state as the next version of ``path``."""
    return save_state(spark, path, (cluster_job if isinstance(state, cluster_job.ClusterState) else classify_job).state_rows(state))


def refitted(index: DataFrame, state: State, exact: bool = True) -> State:
    """The state of a new project: its own scaler, and its own landmarks where there are clusters."""
    rows = settled(cluster_job.project_rows(index))
    return (cluster_job if isinstance(state, cluster_job.ClusterState) else classify_job).refit_state(rows, state, exact)


def score(index: DataFrame, state: State) -> DataFrame:
    """Key, scaled features and predict_index of each active row."""
    return cluster_job.assign_project(index, state) if isinstance(state, cluster_job.ClusterState) else classify_job.score_project(index, state)


def main(state_path: str, project_path: str, out: str, project: str = "same", encoding: str = "GBK", quantiles: str = "exact", version: str | None = None) -> None:
    if project not in ("same", "new"):
        raise ValueError(f"a project is same or new, not {project}")
    spark = SparkSession.builder.appName("score chains").getOrCreate()
    state = load_state(spark, state_path, None if version is None else int(version))
    index = read_keyed_csv(spark, project_path, INDEX_SCHEMA, encoding)
    if project == "new":
        state = refitted(index, state, quantiles == "exact")
        store_state(spark, f"{out}/state", state)
    write_keyed_csv(score(index, state), f"{out}/scores", encoding)


if __name__ == "__main__":
    main(*sys.argv[1:])
