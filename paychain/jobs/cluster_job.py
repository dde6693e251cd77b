"""Numeric clustering of chains: robust scale, whiten, uniform quantiles, k-means; also a spark-submit main.

    cluster_job.py MODEL_INDEX PROJECT_INDEX OUT [encoding] [exact|sketch]

The last says how quantiles are found. The fitted state is saved under OUT/state, from which score_job.py scores later projects.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from paychain.operators.cluster import KMeansFit, assign_nearest, fit_kmeans
from paychain.operators.prep import active_rows, fill_missing
from paychain.operators.scale import QuantileMap, RobustParams, Whitening, apply_quantiles, apply_robust, apply_whiten, fit_quantiles, fit_robust, fit_whiten
from paychain.sources.scratch import settled
from paychain.sources.states import Numbers, Row, matrix_rows, save_state, vector_rows
from paychain.sources.tables import COUNT, FEATURES, INDEX_SCHEMA, KEY, read_keyed_csv, write_keyed_csv

#: Components asked for; there are never more than features.
COMPONENTS, CLUSTERS, STARTS = 5, 7, 20


@dataclass(frozen=True)
class ClusterState:
    scaler: RobustParams
    whitening: Whitening
    quantiles: QuantileMap
    kmeans: KMeansFit


KIND = "cluster"


def state_rows(state: ClusterState) -> list[Row]:
    """The state as numbers: scaler, whitening, landmarks and centres."""
    s, w, q, k = state.scaler, state.whitening, state.quantiles, state.kmeans
    rows = [r for item in ("low", "median", "high") for r in vector_rows(KIND, "scaler", item, getattr(s, item), s.columns)]
    rows += vector_rows(KIND, "whitening", "mean", w.mean, w.columns) + vector_rows(KIND, "whitening", "variance", w.variances) + matrix_rows(KIND, "whitening", "weight", w.rows, w.columns)
    rows += [(KIND, "quantiles", "landmark", i, j, c, v) for i, (c, line) in enumerate(zip(q.columns, q.landmarks)) for j, v in enumerate(line)]
    return rows + matrix_rows(KIND, "kmeans", "centre", k.centres, k.columns) + vector_rows(KIND, "kmeans", "cost", [k.cost])


def state_of(numbers: Numbers) -> ClusterState:
    """The state that ``state_rows`` told."""
    scaler = RobustParams(numbers.names("scaler", "median"), *(numbers.vector("scaler", item) for item in ("low", "median", "high")))
    whitening = Whitening(numbers.names("whitening", "mean"), numbers.vector("whitening", "mean"), numbers.vector("whitening", "variance"), numbers.matrix("whitening", "weight"))
    marks: dict[int, str] = {r["i"]: r["name"] for r in numbers.items[("quantiles", "landmark")]}
    quantiles = QuantileMap(tuple(marks[i] for i in sorted(marks)), numbers.matrix("quantiles", "landmark"))
    return ClusterState(scaler, whitening, quantiles, KMeansFit(numbers.names("kmeans", "centre"), list(numbers.matrix("kmeans", "centre")), numbers.vector("kmeans", "cost")[0]))


def _components(w: Whitening) -> list[str]:
    return [f"pc{k + 1}" for k in range(len(w.rows))]


def reduce(scaled: DataFrame, whitening: Whitening, quantiles: QuantileMap) -> DataFrame:
    return apply_quantiles(apply_whiten(scaled, whitening), quantiles)


def fit(rows: DataFrame, n_init: int = STARTS, seed: int = 0, exact: bool = True) -> ClusterState:
    """``rows`` has the filled features; four small fits, each over the frame that the former ones transform."""
    scaler = fit_robust(rows, FEATURES, exact)
    scaled = apply_robust(rows, scaler)
    whitening = fit_whiten(scaled, FEATURES, COMPONENTS)
    quantiles = fit_quantiles(apply_whiten(scaled, whitening), _components(whitening), exact=exact)
    return ClusterState(scaler, whitening, quantiles, fit_kmeans(reduce(scaled, whitening, quantiles), _components(whitening), CLUSTERS, n_init, seed, key=KEY))


def assign(rows: DataFrame, state: ClusterState) -> DataFrame:
    """key, robust-scaled features and predict_index."""
    scaled = apply_robust(rows.select(KEY, *FEATURES), state.scaler)
    return assign_nearest(reduce(scaled, state.whitening, state.quantiles), list(state.kmeans.columns), state.kmeans.centres).select(KEY, *FEATURES, "predict_index")


def project_rows(index: DataFrame) -> DataFrame:
    return fill_missing(active_rows(index, COUNT).select(KEY, *FEATURES), FEATURES)


def refit_state(rows: DataFrame, state: ClusterState, exact: bool = True) -> ClusterState:
    """``state`` with the scaler and landmarks of ``rows``, a written frame of filled features; components and clusters stay."""
    scaler = fit_robust(rows, FEATURES, exact)
    return replace(state, scaler=scaler, quantiles=fit_quantiles(apply_whiten(apply_robust(rows, scaler), state.whitening), _components(state.whitening), exact=exact))


def assign_project(index: DataFrame, state: ClusterState, refit: bool = False, exact: bool = True) -> DataFrame:
    """The same project with all of the fitted state; a new one with its own scaler and landmarks (``refit``), but the fitted components and clusters."""
    rows = project_rows(index)
    if refit:
        rows = settled(rows)
        state = refit_state(rows, state, exact)
    return assign(rows, state)


def main(model_path: str, project_path: str, out: str, encoding: str = "GBK", quantiles: str = "exact") -> None:
    exact = quantiles == "exact"
    spark = SparkSession.builder.appName("cluster chains").getOrCreate()
    rows = fill_missing(read_keyed_csv(spark, model_path, INDEX_SCHEMA, encoding).select(KEY, *FEATURES), FEATURES)
    rows = settled(rows)
    state = fit(rows, exact=exact)
    save_state(spark, f"{out}/state", state_rows(state))
    write_keyed_csv(assign(rows, state), f"{out}/duration_result", encoding)
    project = read_keyed_csv(spark, project_path, INDEX_SCHEMA, encoding)
    write_keyed_csv(assign_project(project, state), f"{out}/same_project", encoding)
    write_keyed_csv(assign_project(project, state, refit=True, exact=exact), f"{out}/new_project", encoding)


if __name__ == "__main__":
    main(*sys.argv[1:])
