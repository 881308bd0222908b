"""Typed CSV read (A3), graph table sink (A7), custom-model persistence (A9), scaler switch."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from binlens.operators.boosting import fit_adaboost
from binlens.operators.graph import write_graph_tables
from binlens.operators.persist import load_model, save_model
from binlens.operators.sgd import fit_sgd
from binlens.sources.binary import read_typed_csv
from binlens.sources.lookups import dictionary_frame, load_dictionary


def test_typed_csv_schema_and_multiline(spark, tmp_path):
    p = tmp_path / "train.csv"
    p.write_text('SampleName,Machine,Name0,TimeDateStamp,e_res2,IsMalware\n'
                 'a.exe,332,.text,2020,"00\\r\\n00",1\n'
                 'b.exe,34404,".data",2010,"line one\nline two",0\n')
    df = read_typed_csv(spark, str(p))
    types = dict(df.dtypes)
    assert types["SampleName"] == "string" and types["Name0"] == "string" and types["TimeDateStamp"] == "string"
    assert types["Machine"] == "double" and types["IsMalware"] == "double"
    rows = {r.SampleName: r for r in df.collect()}
    assert len(rows) == 2 and rows["b.exe"].e_res2 == "line one\nline two" and rows["a.exe"].Machine == 332.0


def test_graph_tables_bucketed(spark, tmp_path):
    nodes = spark.createDataFrame([(b, n) for b in range(20) for n in range(3)], "binary_id long, node int")
    edges = spark.createDataFrame([(b, 0, 1) for b in range(20)], "binary_id long, src int, dst int")
    labels = spark.createDataFrame([(b, b % 2) for b in range(20)], "binary_id long, label int")
    root = str(tmp_path / "graphs")
    write_graph_tables(nodes, edges, labels, root, buckets=4)
    assert 1 <= len([d for d in os.listdir(f"{root}/nodes") if d.startswith("bucket=")]) <= 4
    back = spark.read.parquet(f"{root}/nodes")
    assert back.count() == 60
    one = back.filter(F.col("binary_id") == 7).select("bucket").distinct().collect()
    assert len(one) == 1          # a graph lives in exactly one bucket


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.RandomState(5)
    rows = [(i, i % 2, Vectors.dense((rng.normal(0, .3, 3) + (1.5 if i % 2 else -1.5)).tolist())) for i in range(80)]
    return spark.createDataFrame(rows, ["id", "label", "features"]).cache()


def test_custom_models_roundtrip(spark, toy, tmp_path):
    for i, m in enumerate([fit_adaboost(toy, rounds=3, checkpoint_every=2), fit_sgd(toy, loss="perceptron", max_iter=5)]):
        path = str(tmp_path / f"m{i}")
        save_model(spark, m, path)
        back = load_model(spark, path)
        a = [(r.id, r.prediction, r.score) for r in m.transform(toy).orderBy("id").collect()]
        b = [(r.id, r.prediction, r.score) for r in back.transform(toy).orderBy("id").collect()]
        assert a == b


def test_maxabs_switch(spark):
    from binlens.plans.prepared import feature_pipeline

    df = spark.createDataFrame([("de", "s1", 10.0, 2.0, 4.0), ("en", "s2", -20.0, 1.0, 8.0)],
                               "lang string, source string, n_chars double, n_lines double, n_words double")
    out = feature_pipeline("maxabs").fit(df).transform(df).orderBy("n_chars").collect()
    assert out[0].features.toArray()[-3:].tolist() == [-1.0, 0.5, 1.0]
    raw = feature_pipeline(None).fit(df).transform(df).first()
    assert raw.features == raw.raw


def test_sinks_parquet_and_csv_roundtrip(spark, tmp_path):
    from binlens.sources.binary import write_table

    df = spark.createDataFrame([("a.exe", 1.0, "x,y"), ("b.exe", 0.0, 'say "hi"')],
                               "SampleName string, IsMalware double, note string")
    write_table(df, str(tmp_path / "pq"))
    write_table(df, str(tmp_path / "csv"), fmt="csv")
    write_table(df, str(tmp_path / "part"), partition_by=["IsMalware"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "pq")).collect())) == sorted(map(tuple, df.collect()))
    back = (spark.read.option("header", "true").option("escape", '"').schema(df.schema).csv(str(tmp_path / "csv")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert sorted(d for d in os.listdir(tmp_path / "part") if d.startswith("IsMalware=")) == \
        ["IsMalware=0.0", "IsMalware=1.0"]


def test_every_model_and_ensemble_roundtrip(spark, toy, tmp_path):
    from binlens.operators import network, newton, reduce, roster, trees

    members = {"knn": roster.builders(3)["knn"](toy), "logistic": roster.builders(3, 80)["logistic"](toy),
               "trees": roster.fitted("trees", trees.fit_forest(toy, 3, 3, bootstrap_rows=True)), "boosting": roster.fitted("boosting", newton.fit_boosted(toy, 4))}
    head = network.fit_network(roster.stack_features(roster.scored_union(members, toy), list(members)), hidden=(4,), max_iter=5, features_col="stack")
    ensembles = [roster.VoteModel(members, soft=False), roster.VoteModel(members, soft=True), roster.StackModel(members, head)]
    other = spark.newSession()
    for i, m in enumerate([*(f.model for f in members.values()), head, *ensembles]):
        path = str(tmp_path / f"e{i}")
        save_model(spark, m, path)
        back = load_model(other, path)
        if m is head:
            assert back.weights.tolist() == m.weights.tolist()
            continue
        a, b = ({r.id: (r.label, r.prediction, r.score) for r in roster.fitted("x", x).score(toy).collect()} for x in (m, back))
        assert a == b and len(a) == 80
    ny = reduce.fit_nystroem(toy, n_components=10)
    nmf = reduce.NmfModel(np.abs(np.random.RandomState(0).rand(2, 3)))
    for i, (m, col) in enumerate([(ny, "kernel_features"), (nmf, "w")]):
        save_model(spark, m, str(tmp_path / f"r{i}"))
        back = load_model(other, str(tmp_path / f"r{i}"))
        rows = toy.selectExpr("id", "label", "features")
        a, b = ({r.id: np.array(r[col]).tolist() for r in x.transform(rows).collect()} for x in (m, back))
        assert a == b
    with pytest.raises(TypeError):
        save_model(spark, object(), str(tmp_path / "no"))


def test_dictionary_file(spark):
    folder = tempfile.mkdtemp(prefix="binlens-dictionary-")
    for name, text in {"good": "jump: [JMP, je]\nempty:\nnumbers: [1]\n", "blank": "", "list": "- a\n- b\n"}.items():
        with open(f"{folder}/{name}.yml", "w") as fh:
            fh.write(text)
    assert load_dictionary(f"file://{folder}/good.yml", spark) == {"jump": ["JMP", "je"], "empty": [], "numbers": ["1"]}
    assert sorted(map(tuple, dictionary_frame(spark, f"{folder}/good.yml").collect())) == [("jump", "je"), ("jump", "jmp"), ("numbers", "1")]
    assert load_dictionary(f"{folder}/blank.yml") == {} and dictionary_frame(spark, f"{folder}/blank.yml").count() == 0
    with pytest.raises(ValueError):
        load_dictionary(f"{folder}/list.yml", spark)
