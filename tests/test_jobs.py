"""The mains, from files to files."""

import random

from pyspark.sql import functions as F

from paychain.jobs import classify_job, cluster_job, mixed_job, modes_job
from paychain.sources.tables import FEATURES, KEY, read_keyed_csv


def index_file(path, n=150):
    r = random.Random(1)
    rows = ["key,chain_num_pay_day," + ",".join(FEATURES)]
    for i in range(n):
        x = [round(r.gauss(i % 3, 0.4), 3) for _ in FEATURES]
        rows.append(f"链{i},{0 if i % 29 == 0 else 3},{x[0]},{'' if i % 11 == 0 else x[1]},{'NaN' if i % 13 == 0 else x[2]},{x[3]}")
    path.write_bytes(("\n".join(rows) + "\n").encode("gbk"))
    return str(path)


def test_classify_main(spark, tmp_path):
    index, labels, out = index_file(tmp_path / "index.csv"), tmp_path / "labels.csv", str(tmp_path / "out")
    labels.write_text("key,dis_index\n" + "".join(f"链{i},{1 + i % 3}\n" for i in range(140) if i % 5) + "other,1\n", encoding="utf-8")
    classify_job.main(index, str(labels), out)
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert read("scores_test").first()["accuracy"] > 0.7 and read("confusion_train").agg(F.sum("n")).first()[0] > 60
    assert read("null_profile").count() == 6
    assert {r["class"]: r["auc"] > 0.6 for r in read("roc_auc").collect() if r["class"] != 2} == {1: True, 3: True}
    assert read("roc_macro").where("tpr IS NULL").count() == 0 and read("roc_micro_auc").first()["auc"] > 0.6
    header = {"encoding": "GBK", "header": True, "inferSchema": True}
    results = spark.read.options(**header).csv(f"{out}/results")
    assert results.columns == [KEY, *FEATURES, "dis_index", "predict_index"] and results.where(f"{KEY} = '链1'").count() == 1
    assert results.where("dis_index IS NULL").count() > 0
    same, new = (spark.read.options(**header).csv(f"{out}/{n}").count() for n in ("same_project", "new_project"))
    assert same == new == 150 - 6


def test_cluster_main_with_sketch(spark, tmp_path):
    model, project, out = index_file(tmp_path / "model.csv"), index_file(tmp_path / "project.csv", 60), str(tmp_path / "out")
    cluster_job.main(model, project, out, "GBK", "sketch")
    for name, n in (("duration_result", 150), ("same_project", 57), ("new_project", 57)):
        rows = spark.read.options(encoding="GBK", header=True, inferSchema=True).csv(f"{out}/{name}")
        assert rows.columns == [KEY, *FEATURES, "predict_index"] and rows.where("predict_index BETWEEN 0 AND 6").count() == n


def test_mixed_and_modes_mains(spark, tmp_path):
    r = random.Random(2)
    (tmp_path / "stocks.csv").write_text("".join(f"S{i},{i % 4 * 100 + r.random()},{'abcd'[i % 4]},{'xy'[i % 2]}\n" for i in range(80)) + "bad,none,a,x\n")
    mixed_job.main(str(tmp_path / "stocks.csv"), str(tmp_path / "mixed"))
    clusters = spark.read.parquet(f"{tmp_path}/mixed/clusters")
    assert clusters.count() == 80 and clusters.select("cluster").distinct().count() == 4
    costs = [x["cost"] for x in spark.read.parquet(f"{tmp_path}/mixed/cost").orderBy("iteration").collect()]
    assert costs == sorted(costs, reverse=True)
    (tmp_path / "categories.csv").write_text("".join(f"K{i},{'abcd'[i % 4]},{'pqrs'[i % 4]},{'xy'[i % 2]}\n" for i in range(60)))
    modes_job.main(str(tmp_path / "categories.csv"), str(tmp_path / "modes"), "3", "4", "2")
    assert spark.read.parquet(f"{tmp_path}/modes/clusters").count() == 60 and spark.read.parquet(f"{tmp_path}/modes/centroids").count() == 12


def test_readers_of_keyed_tables(spark, tmp_path):
    (tmp_path / "x.csv").write_text("key,dis_index\na,1\nb,\n", encoding="utf-8")
    from paychain.sources.tables import LABEL_SCHEMA

    assert [tuple(r) for r in read_keyed_csv(spark, str(tmp_path / "x.csv"), LABEL_SCHEMA).orderBy("key").collect()] == [("a", 1), ("b", None)]
