import numpy as np

from prosemetrics.operators import lm, relational
from prosemetrics.sources import readers, sinks


def test_texts_and_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("un café".encode())
    (tmp_path / "b.txt").write_bytes("un café".encode("cp1252"))
    got = {r["name"]: r["text"] for r in readers.decoded_texts(spark, str(tmp_path)).collect()}
    assert got == {"a": "un café", "b": "un café"}
    assert {r["name"] for r in readers.texts(spark, str(tmp_path)).collect()} == {"a", "b"}


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.ones((3, 4), np.float32))
    np.save(tmp_path / "none.npy", np.zeros((0, 4), np.float32))
    (tmp_path / "bad.npy").write_bytes(b"no array")
    rows = readers.arrays(spark, str(tmp_path)).collect()
    assert [(r["name"], r["row"], len(r["embedding"])) for r in sorted(rows, key=lambda r: r["row"])] == [("x", 0, 4), ("x", 1, 4), ("x", 2, 4)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "name string, x double")
    sinks.csv(rows, str(tmp_path / "t"))
    back = readers.delimited(spark, str(tmp_path / "t"), "name string, x double")
    assert sorted((r["name"], r["x"]) for r in back.collect()) == [("a", 1.0), ("b", None)]
    sinks.workbook({"one": rows}, str(tmp_path / "book"))
    assert readers.side_car(spark, str(tmp_path / "book/index")).first()["sheet"] == "one"
    sinks.parquet(rows, str(tmp_path / "p"))
    sinks.parquet(rows, str(tmp_path / "p"), append=True)
    assert readers.table_or_csv(spark, str(tmp_path / "p")).count() == 4
    arc = spark.createDataFrame([([0.5, 1.5],)], "arc array<double>")
    assert sinks.wide_arcs(arc, 2).first().asDict() == {"point_0": 0.5, "point_1": 1.5}


def test_csv_of_any_encoding(spark, tmp_path):
    """Headers by name, quotes, line breaks within them, types with commas, and the encoding of each file."""
    files = {
        "quoted": b'"Name","n","price"\r\n"a, b",1,2.50\r\n"say ""hi""\nthere",2,3.005\r\n\r\n',
        "capitals": "﻿ PRICE , NAME ,other\n1.25, café ,x\n".encode(),
        "latin": "name;x,name,n\nzz,\xe9lan\x80,3\n".encode("latin-1"),
        "short": b"name,n,price\nonly\n,,\nq,no number,nan\n",
        "none": b"",
        "header": b"name,n\n",
    }
    for k, v in files.items():
        (tmp_path / f"{k}.csv").write_bytes(v)
    got = readers.any_encoding(spark, str(tmp_path), "name string, n int, price decimal(10,2), ratio double")
    assert got.dtypes == [("name", "string"), ("n", "int"), ("price", "decimal(10,2)"), ("ratio", "double")]
    rows = {(r["name"], r["n"], None if r["price"] is None else str(r["price"]), r["ratio"]) for r in got.collect()}
    assert rows == {("a, b", 1, "2.50", None), ('say "hi"\nthere', 2, "3.01", None), ("café", None, "1.25", None), ("\xe9lan\x80", 3, None, None), ("only", None, None, None), ("q", None, None, None)}
    spread = readers.any_encoding(spark, str(tmp_path / "short.csv"), "price double, name string")
    assert [tuple(r) for r in spread.collect()] == [(None, "only"), (None, "q")]


def test_csv_of_windows(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes(" Name ,x\n\u201cquoted\u201d \u20ac,1.5\n".encode("cp1252"))
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / "w.csv"), "Name string, x double", "cp1252").collect()] == [("\u201cquoted\u201d \u20ac", 1.5)]


def test_saved_model_scores_alike(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three two"), (2, "two one")], "doc_id long, text string")
    model = lm.fit(docs, 0.7)
    lm.save(model, str(tmp_path / "m"))
    assert lm.document_nll(docs, lm.load(spark, str(tmp_path / "m"))).orderBy("doc_id").collect() == lm.document_nll(docs, model).orderBy("doc_id").collect()


def test_scores_without_broadcast(spark, monkeypatch):
    """A large vocabulary is met pair by pair; the scores are the same."""
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 7}" for j in range(9))) for k in range(6)], "doc_id long, text string")
    model = lm.fit(docs.where("doc_id < 3"))
    want = {r["doc_id"]: (round(r["mean_nll"], 9), r["n_scored"]) for r in lm.document_nll(docs, model).collect()}
    monkeypatch.setattr(lm, "MOST_SENT", -1)
    assert {r["doc_id"]: (round(r["mean_nll"], 9), r["n_scored"]) for r in lm.document_nll(docs, model).collect()} == want and len(want) == 6


def test_sentence_perplexity(spark):
    rows = spark.createDataFrame([(1, None), (2, " \n"), (3, "one"), (4, "a b a b"), (5, "a b zz zz zz"), (None, "b a")], "k int, text string")
    model = lm.fit(spark.createDataFrame([(1, "a b a b a")], "doc_id long, text string"))
    got = {r["k"]: r["perplexity"] for r in lm.sentence_perplexity(rows, model, ["k"], 2).collect()}
    assert got[1] == got[2] == float("inf") and got[3] is None and got[4] == got[5] < got[None] * 2 and len(got) == 6
    longer = {r["k"]: r["perplexity"] for r in lm.sentence_perplexity(rows, model, ["k"]).collect()}
    assert longer[5] > got[5]


def test_labels_and_infinities(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", float("inf")), (None, float("nan"))], "code string, x double")
    got = relational.labelled(relational.labelled(relational.without_infinity(rows, ["x"]), "code", {"a": "A"}, "name"), "code", {"a": "A"}, "other", "Cluster").collect()
    assert [tuple(r) for r in got] == [("a", 1.0, "A", "A"), ("b", None, None, "Cluster b"), (None, None, None, None)]
