"""Classification of chains: train, evaluate, score; also a spark-submit main.

    classify_job.py INDEX LABELS OUT [encoding] [exact|sketch]

The last says how the scaler's quantiles are found. The fitted state is saved under OUT/state, from which score_job.py scores later projects.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paychain.functions.curves import auc, long_scores, roc_macro, roc_points
from paychain.functions.metrics import class_report, confusion, losses, score_summary
from paychain.operators.classify import LinearModel, fit_ovr, fit_softmax_l1, predict_linear
from paychain.operators.prep import active_rows, align_labels, fill_missing, model_input, null_profile, random_split, stratified_split
from paychain.operators.scale import RobustParams, apply_robust, fit_robust
from paychain.sources.scratch import settled
from paychain.sources.states import Numbers, Row, matrix_rows, save_state, vector_rows
from paychain.sources.tables import COUNT, FEATURES, INDEX_SCHEMA, KEY, LABEL, LABEL_SCHEMA, read_keyed_csv, write_keyed_csv

CLASSES = [1, 2, 3]


@dataclass(frozen=True)
class ClassifierState:
    """What later projects are scored with."""

    scaler: RobustParams
    model: LinearModel
    regularisation: float
    train_rows: int


KIND = "classifier"


def state_rows(state: ClassifierState) -> list[Row]:
    """The state as numbers: scaler, classes, coefficients and intercepts, and what the fit was given."""
    s, m = state.scaler, state.model
    rows = [r for item in ("low", "median", "high") for r in vector_rows(KIND, "scaler", item, getattr(s, item), s.columns)]
    rows += vector_rows(KIND, "linear", "class", m.classes) + matrix_rows(KIND, "linear", "weight", m.weights, m.columns) + vector_rows(KIND, "linear", "intercept", m.intercepts)
    return rows + vector_rows(KIND, "fit", "regularisation", [state.regularisation]) + vector_rows(KIND, "fit", "train_rows", [state.train_rows])


def state_of(numbers: Numbers) -> ClassifierState:
    """The state that ``state_rows`` told."""
    scaler = RobustParams(numbers.names("scaler", "median"), *(numbers.vector("scaler", item) for item in ("low", "median", "high")))
    model = LinearModel(numbers.names("linear", "weight"), tuple(map(int, numbers.vector("linear", "class"))), numbers.matrix("linear", "weight"), numbers.vector("linear", "intercept"))
    return ClassifierState(scaler, model, numbers.vector("fit", "regularisation")[0], int(numbers.vector("fit", "train_rows")[0]))


def prepare(index: DataFrame, labels: DataFrame) -> DataFrame:
    return model_input(active_rows(align_labels(index, labels, KEY), COUNT), KEY, FEATURES, LABEL)


def fit(model: DataFrame, C: float = 3.0, exact: bool = True, tol: float = 1e-4, max_iter: int = 100, steps: int = 0) -> ClassifierState:
    """The scaler and the classifier, both from the training part alone."""
    train = settled(stratified_split(model.na.drop(subset=[LABEL]), KEY, LABEL).where("NOT is_test"))
    scaler = fit_robust(train, FEATURES, exact)
    linear, reg, n = fit_softmax_l1(apply_robust(train, scaler), FEATURES, LABEL, C, CLASSES, max_iter, tol, steps)
    return ClassifierState(scaler, linear, reg, n)


def score(rows: DataFrame, state: ClassifierState) -> DataFrame:
    """Labelled and unlabelled rows alike: key, scaled features, label if there, predicted class."""
    return predict_linear(apply_robust(rows, state.scaler), state.model)


def refit_state(rows: DataFrame, state: ClassifierState, exact: bool = True) -> ClassifierState:
    """``state`` with the scaler of ``rows``, which have the filled features; coefficients stay."""
    return replace(state, scaler=fit_robust(rows, FEATURES, exact))


def score_project(index: DataFrame, state: ClassifierState, refit: bool = False, exact: bool = True) -> DataFrame:
    """The same project with the fitted scaler, or a new one with its own (``refit``)."""
    rows = fill_missing(active_rows(index, COUNT).select(KEY, *FEATURES), FEATURES)
    state = refit_state(rows, state, exact) if refit else state
    return predict_linear(apply_robust(rows, state.scaler), state.model)


def fit_one_vs_rest(model: DataFrame, exact: bool = True) -> tuple[LinearModel, DataFrame, DataFrame]:
    """Each class against the rest, and the scaled rows it was fitted on and those held out."""
    rows = settled(random_split(model.na.drop(subset=[LABEL]), KEY))
    train, test = rows.where("NOT is_test").drop("is_test"), rows.where("is_test").drop("is_test")
    scaler = fit_robust(train, FEATURES, exact)
    train = settled(apply_robust(train, scaler))
    return fit_ovr(train, FEATURES, LABEL, classes=CLASSES), train, apply_robust(test, scaler)


def one_vs_rest(model: DataFrame, exact: bool = True) -> DataFrame:
    """Decision values m1 .. mK and class of the rows held out, each class fitted against the rest on the others."""
    fitted, _, test = fit_one_vs_rest(model, exact)
    return predict_linear(test, fitted, margins=True)


def write_curves(scored: DataFrame, out: str) -> None:
    """The curve of each class, of all scores together and of the classes' mean, and the areas."""
    scores = settled(long_scores(scored, LABEL, [f"m{i + 1}" for i in range(len(CLASSES))], CLASSES))
    points, micro = settled(roc_points(scores, ["class"])), settled(roc_points(scores, []))
    found = {"roc_points": points, "roc_micro": micro, "roc_macro": roc_macro(points, "class"), "roc_auc": auc(points, ["class"]), "roc_micro_auc": auc(micro, [])}
    for name, df in found.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def main(index_path: str, labels_path: str, out: str, encoding: str = "GBK", quantiles: str = "exact") -> None:
    exact = quantiles == "exact"
    spark = SparkSession.builder.appName("classify chains").getOrCreate()
    index, labels = read_keyed_csv(spark, index_path, INDEX_SCHEMA, encoding), read_keyed_csv(spark, labels_path, LABEL_SCHEMA)
    joined = align_labels(index, labels, KEY)
    null_profile(joined, [COUNT, *FEATURES, LABEL]).write.mode("overwrite").parquet(f"{out}/null_profile")
    model = model_input(active_rows(joined, COUNT), KEY, FEATURES, LABEL)
    model = settled(model)
    write_keyed_csv(model, f"{out}/model_index", encoding)
    state = fit(model, exact=exact)
    save_state(spark, f"{out}/state", state_rows(state))
    split = stratified_split(model.na.drop(subset=[LABEL]), KEY, LABEL)
    for name, part in (("test", split.where("is_test")), ("train", split.where("NOT is_test"))):
        scored = predict_linear(apply_robust(part, state.scaler), state.model, margins=True)
        counts = confusion(scored, LABEL, "predict_index", CLASSES)
        for kind, df in (("confusion", counts), ("report", class_report(counts)), ("scores", score_summary(counts)), ("losses", losses(scored, LABEL, ["m1", "m2", "m3"], CLASSES))):
            df.withColumn("part", F.lit(name)).write.mode("overwrite").parquet(f"{out}/{kind}_{name}")
    write_curves(settled(one_vs_rest(model, exact)), out)
    write_keyed_csv(score(model, state), f"{out}/results", encoding)
    write_keyed_csv(score_project(index, state), f"{out}/same_project", encoding)
    write_keyed_csv(score_project(index, state, refit=True, exact=exact), f"{out}/new_project", encoding)


if __name__ == "__main__":
    main(*sys.argv[1:])
