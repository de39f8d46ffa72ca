"""Literal cases."""

import numpy as np
from pyspark.sql import functions as F

from prosemetrics.functions import arrays as A
from prosemetrics.functions import text as T
from prosemetrics.operators import relational, stats
from prosemetrics.sources.readers import id_list
from prosemetrics.streaming.incremental import increment


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_clean_text_keeps_the_double_blank(spark):
    assert value(spark, T.clean_text(F.lit("a — b"))) == "a  b"
    assert value(spark, T.clean_text(F.lit("  a\n\tb "))) == "a b"


def test_keynorm(spark):
    assert value(spark, T.keynorm(F.lit("Café_No. 1.txt"))) == "cafeno1txt"
    assert value(spark, T.keynorm(F.lit(None).cast("string"))) is None


def test_style_of_nothing(spark):
    s = T.style(T.words(F.lit("")))
    assert [value(spark, s[k]) for k in ("word_count", "avg_word_length", "ttr")] == [0, 0.0, 0.0]


def test_chunks(spark):
    chunks = lambda xs: value(spark, T.greedy_chunks(F.array(*[F.lit(x) for x in xs]), 200))
    assert chunks([100, 100]) == [200]
    assert chunks([450]) == [200, 200, 50]
    assert chunks([100, 100, 50, 450, 10, 199, 2]) == [200, 50, 200, 200, 50, 10, 199, 2]


def test_blocks_drop_the_rest(spark):
    got = value(spark, T.token_blocks(F.split(F.lit("a b c d e f g h i j"), " "), 4))
    assert got == [["a", "b", "c", "d"], ["e", "f", "g", "h"]]


def test_arcs(spark):
    x = F.array(*[F.lit(v) for v in (0.1, 0.2, 0.3, 0.4, 0.5)])
    assert np.allclose(value(spark, A.resample(A.moving_average(x))), [0.15] * 100)
    assert np.allclose(value(spark, A.resample(A.moving_average(F.array_repeat(F.lit(0.7), 37)))), [0.7] * 100)
    y = np.random.default_rng(1).random(230)
    w = 23
    smooth = np.convolve(y, np.ones(w) / w, "valid")
    expected = np.interp(np.linspace(0, 1, 100), np.linspace(0, 1, len(smooth)), smooth)
    assert np.allclose(value(spark, A.resample(A.moving_average(F.array(*[F.lit(float(v)) for v in y])))), expected)


def test_iqr_and_quantiles(spark):
    rows = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 8, 16, 100)], "x double")
    assert rows.agg(F.percentile("x", F.lit(0.25))).first()[0] == 2.5
    assert rows.agg(F.percentile("x", F.lit(0.95))).first()[0] == 79.0
    many = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 1000)], "x double")
    assert sorted(r["x"] for r in stats.iqr_repair(many, ["x"]).collect()) == [1, 1, 2, 3, 4, 5]


def test_bh_and_p_values(spark):
    rows = spark.createDataFrame([(0.01,), (0.02,), (0.03,)], "p double")
    assert [round(r["p_adjusted"], 9) for r in stats.benjamini_hochberg(rows, "p").collect()] == [0.03] * 3
    assert abs(stats.student_two_sided(2.0, 10) - 0.0733880348) < 1e-9
    assert abs(stats.student_two_sided(-1.0, 1) - 0.5) < 1e-12


def test_id_reader(spark):
    lines = spark.createDataFrame(list(enumerate(["1", "", "#x", "abc", "1", " 2 "])), "pos int, line string")
    assert [r["id"] for r in id_list(lines).orderBy("pos").collect()] == ["1", "2"]


def test_auc_is_the_share_of_pairs(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, 80), rng.integers(0, 2, 80)
    long = spark.createDataFrame([("f", float(a), int(b)) for a, b in zip(x, y, strict=True)], "feature string, x double, y int")
    pairs = [(a > b) + 0.5 * (a == b) for a in x[y == 1] for b in x[y == 0]]
    assert abs(stats.rank_statistics(long).first()["auc"] - np.mean(pairs)) < 1e-12


def test_strip_boilerplate(spark):
    book = "﻿Title\r\n*** START OF THE PROJECT GUTENBERG EBOOK ***\r\n\r\nProduced by X\r\n\r\nBody one.\n\n\n\n\nBody two.\n" + "x " * 60 + "\n*** END OF THE PROJECT GUTENBERG EBOOK ***\nLicence"
    assert value(spark, T.strip_boilerplate(F.lit(book))) == "Body one.\n\n\nBody two.\n" + ("x " * 60).strip() + "\n"


def test_increment_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.range(100).write.parquet(src)
    for expected in (100, 100, 150):
        if expected == 150:
            spark.range(50).write.mode("append").parquet(src)
        increment(spark, src, "id long", out, mark)
        assert spark.read.parquet(out).count() == expected


def test_coerce_and_finite(spark):
    rows = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "x string")
    assert [r["x"] for r in relational.finite(relational.coerce(rows, "x"), ["x"]).collect()] == [1.5]


def test_master_table(spark):
    from prosemetrics.operators import feature_tables as f

    ids = ["Café 1", "b_2", "c-3", "d", "e", "g"]
    meta = spark.createDataFrame([(i, " FIC " if k % 2 else "NON", "PW", 1000, *[str(float(k + 1) * (1000 if c == "volume" and k == 5 else 1)) for c in f.META]) for k, i in enumerate(ids)], "ID string, Category string, Genre string, token_count int, " + ", ".join(f"{c} string" for c in f.META))
    counts = spark.createDataFrame([(i + ".", *[k + j for j in range(10)]) for k, i in enumerate(ids[:-1])], "file_name string, " + ", ".join(f"`{c}` int" for c in f.EMBODIED + f.ABSTRACT))
    m = f.metadata(meta)
    assert {r["volume"] for r in m.collect()} == {1, 2, 3, 4, 5, 6} and {r["genre_label"] for r in m.collect()} == {"Prizewinners"}
    rates = f.category_rates(counts, m)
    other = m.select("_k").withColumn("lex", F.lit(1.0))
    out = f.master_table(m, rates, other.withColumnRenamed("lex", "share"), other)
    assert out.count() == 5 and abs(out.agg(F.sum("poetic")).first()[0]) < 1e-9


def test_archetypes(spark):
    from prosemetrics.operators import arcs

    up, hill = np.linspace(-1, 1, 100), -np.cos(np.linspace(0, 2 * np.pi, 100))
    rows = spark.createDataFrame([(k, [float(v) for v in (up * s if k < 4 else hill * s * 0.5)]) for k, s in enumerate((3, 2.5, -3, 2, 1, 1.2, -1))], "label int, arc array<double>")
    got = {r["label"]: r["cluster_name"] for r in arcs.archetypes(rows, "label", 4).collect()}
    assert got[0] == got[1] == got[3] == "1. Rags to Riches" and got[2] == "2. Riches to Rags" and got[4] == got[5] != got[6]
