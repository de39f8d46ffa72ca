"""Chunk texts, metadata, mixed models, readers, sinks and functions for SQL, on small fixtures."""

import datetime

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from prosemetrics.functions import sql
from prosemetrics.functions import text as T
from prosemetrics.operators import arcs, lexical, models, stats
from prosemetrics.sources import readers, scratch, sinks


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def greedy(sentences, most):
    """The chunker step by step."""
    done, open_ = [], []
    for s in sentences:
        w = s.split()
        if len(open_) + len(w) <= most:
            open_ += w
            continue
        if open_:
            done.append(open_)
        open_ = []
        if len(w) > most:
            done += [w[k : k + most] for k in range(0, len(w), most)]
        else:
            open_ = w
    return [" ".join(x) for x in done + ([open_] if open_ else [])]


def test_chunk_texts(spark):
    r = np.random.default_rng(2)
    for _ in range(6):
        sentences = [" ".join(f"w{r.integers(99)}" for _ in range(r.integers(1, 26))) for _ in range(r.integers(0, 12))]
        column = F.array(*[F.lit(s) for s in sentences]) if sentences else F.array().cast("array<string>")
        assert value(spark, T.chunk_texts(column, 10)) == greedy(sentences, 10)


def test_boilerplate(spark):
    strip = lambda x: value(spark, T.strip_boilerplate(F.lit(x)))
    rest = "\n".join(f"line {k} of the work" for k in range(60))
    assert strip(f"licence\n***START OF THIS PROJECT GUTENBERG EBOOK X***\nProduced by A\nTitle: B\n\n{rest}\n*** END OF THIS PROJECT GUTENBERG EBOOK X ***\nmore") == rest + "\n"
    assert strip(f"x\n*END*THE SMALL PRINT! FOR PUBLIC DOMAIN*\n{rest}\nEnd of the Project Gutenberg text\nlicence") == rest + "\n"
    assert strip(f"{rest}\n*** START OF THE PROJECT GUTENBERG EBOOK ***\nshort") == f"{rest}\n*** START OF THE PROJECT GUTENBERG EBOOK ***\nshort\n"  # not in the first half
    assert strip(f"a\r\rb\n\n\n\n\n{rest}") == f"a\n\nb\n\n\n{rest}\n" and strip("") == "\n" and value(spark, T.strip_boilerplate(F.lit(None).cast("string"))) is None


def test_names(spark):
    assert value(spark, T.without(F.lit("a_n_b_n"), "_n")) == "a_b"
    assert value(spark, T.overlay_name(F.array(*[F.lit(x) for x in ("The Waves", "O'Neill-and more", "x" * 20, "d")]))) == "The_ONeilland_" + "x" * 15 + "_and_others"
    assert value(spark, T.today()) == datetime.date.today().isoformat()
    assert [value(spark, arcs.title_or(F.lit(x).cast("string"), F.lit("?"))) for x in (None, " ", "nan", "A")] == ["?", "?", "?", "A"]


def test_rare_terms(spark):
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 400):
        terms = {"".join(r.choice(list("abé"), 6)): int(r.integers(1, 4)) for _ in range(n)}
        f = spark.createDataFrame(list(terms.items()), "term string, c long")
        order = sorted(terms, key=lambda t: (terms[t], t.encode()))
        assert {x["term"] for x in f.where(lexical.rare_terms(f)).collect()} == set(order[: len(order) // 2])


def test_permutation_in_blocks(spark, monkeypatch):
    """Structure that shuffling destroys, in one block or many; the figures of the two agree closely."""
    x = [(k, [float(v) for v in np.sin(np.linspace(0, 3, 40)) * (1 + k % 5) + np.random.default_rng(k).normal(0, 0.1, 40)]) for k in range(30)]
    rows, got = spark.createDataFrame(x, "label int, arc array<double>"), []
    for block in (4096, 7):
        monkeypatch.setattr(arcs, "BLOCK", block)
        got.append(arcs.permutation_test(rows, "label", m=1, rounds=99).first())
    assert all(r["p"] == 0.01 and r["real"] > 0.9 for r in got) and abs(got[0]["null_mean"] - got[1]["null_mean"]) < 0.02


def table(spark, n=120):
    r = np.random.default_rng(4)
    return spark.createDataFrame([(k, (k % 2 if k % 5 else None), float(r.normal(2 * (k % 2))), float(r.normal())) for k in range(n)], "k int, y int, a double, b double")


def test_models(spark, tmp_path):
    rows = table(spark)
    mixed = models.mixed_scores(rows, "k", "y", ["a", "b"], k=3)
    assert {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()} == {"out of fold": 96, "full fit": 24}
    oof = models.out_of_fold(rows, "k", "y", ["a", "b"], k=3)
    assert oof.count() == 96 and models.cv_summary(oof).first()["auc_mean"] > 0.8
    blocks = models.ablation(rows, "k", "y", {"one": ["b"], "all": ["a", "b"]}, k=2).collect()
    assert {r["block"]: r["auc_mean"] > 0.75 for r in blocks} == {"one": False, "all": True}
    assert models.cv_summary(models.out_of_fold(rows, "k", "y", ["a", "b"], k=2, forest=5)).first()["auc_mean"] > 0.7
    parts = models.loadings(rows, "k", "y", ["a", "b"], k=2).collect()
    assert len(parts) == 4 and abs(sum({r["component"]: r["explained"] for r in parts}.values()) - 1) < 1e-9
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows.where("y is not null"))
    fitted = LogisticRegression(labelCol="y").fit(vectors)
    models.save(fitted, str(tmp_path / "m"))
    assert models.load(LogisticRegressionModel, str(tmp_path / "m")).coefficients == fitted.coefficients


def test_first_and_last(spark):
    rows = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 3.0), ("a", 3, None), ("b", 1, None)], "g string, t int, v double")
    assert [tuple(r) for r in stats.first_and_last(rows, "g", ["t"], "v").collect()] == [("a", 3.0, 5.0, 2.0)]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.csv").write_bytes("name,n\ncafé,1\n".encode())
    (tmp_path / "c/b.csv").write_bytes("name,n\nélan,2\n".encode("latin-1"))
    got = readers.any_encoding(spark, str(tmp_path / "c"), "name string, n int").collect()
    assert {tuple(r) for r in got} == {("café", 1), ("élan", 2)}
    assert readers.newest(spark, str(tmp_path / "c/*.csv")).endswith("b.csv") and readers.newest(spark, str(tmp_path / "none*")) is None
    (tmp_path / "arcs.csv").write_text("label,v\n1,0.5\n")
    assert readers.table_or_csv(spark, str(tmp_path / "arcs.parquet")).first()["v"] == 0.5
    spark.range(3).write.parquet(str(tmp_path / "arcs.parquet"))
    assert readers.table_or_csv(spark, str(tmp_path / "arcs.parquet")).count() == 3
    sinks.failures(spark.range(5), spark.range(3), "id", str(tmp_path / "failed"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "failed")).collect()] == ["3", "4"]
    sinks.arrays(spark.createDataFrame([("x", 1, [1.0]), ("x", 0, [2.0]), ("y", 0, [3.0])], "name string, row int, embedding array<float>"), str(tmp_path / "e"))
    assert [r["row"] for r in spark.read.parquet(str(tmp_path / "e")).where("name = 'x'").collect()] == [0, 1]
    assert scratch.stored(spark.range(4)).count() == 4


def test_functions_for_sql(spark):
    assert len(sql.register(spark)) == 9
    r = spark.sql("select clean_text('  a —\\n b ') as a, title_label(repeat('x', 60)) as b, safe_name('a /b') as c, cosine_similarity_of(array(1D, 0D), array(1D, 1D)) as d, p_student(2D, 10D) as e").first()
    assert (r["a"], len(r["b"]), r["c"], round(r["d"], 6), round(r["e"], 6)) == ("a  b", 50, "a__b", 0.707107, 0.073388)
