"""Table functions in SQL."""

import numpy as np
from pyspark.sql import functions as F

from prosemetrics.functions import sql
from prosemetrics.functions import text as T
from prosemetrics.operators import lm


def test_chunks_with_lateral(spark):
    """As the column function, for each row; rows without chunks are gone."""
    sql.register(spark)
    r = np.random.default_rng(4)
    data = [(k, "  ".join(" ".join(f"w{r.integers(99)}é" for _ in range(r.integers(1, 26))) + r.choice([".", "!?", ".  "]) for _ in range(r.integers(0, 9)))) for k in range(30)] + [(90, None), (91, "  "), (92, "ab."), (93, "one\x85two three four five. six")]
    spark.createDataFrame(data, "id int, body string").createOrReplaceTempView("books")
    got = spark.sql("select id, chunk_number, chunk, word_count from books, lateral chunks_of(body, 10)").collect()
    want = spark.table("books").select("id", F.posexplode(T.chunk_texts(T.sentences(T.clean_text(F.col("body"))), 10)).alias("n", "c")).collect()
    assert sorted((x["id"], x["chunk_number"], x["chunk"]) for x in got) == sorted(map(tuple, want)) and all(x["word_count"] == len(x["chunk"].split()) <= 10 for x in got)
    assert {x["id"] for x in got}.isdisjoint({90, 91, 92})


def test_top_moments_of_a_partitioned_table(spark):
    sql.register(spark)
    r = np.random.default_rng(7)
    data = [(d, k + 1, f"sentence {d} {k} " + "x" * int(r.integers(0, 90)), None if r.uniform() < 0.2 else float(r.integers(0, 9))) for d in range(5) for k in range(40)] + [(9, 1, "alone", None)]
    rows = spark.createDataFrame(data, "doc_id long, sentence_number int, sentence string, mean_nll double").repartition(3)
    rows.createOrReplaceTempView("scored")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(x["doc_id"], x["place"]): x for x in lm.top_moments(rows, 4).collect()}
    try:
        for size in (10_000, 3):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = spark.sql("select * from top_moments(4, table(scored) partition by doc_id order by sentence_number)").collect()
            assert len(got) == len(want) == 20
            for x in got:
                w = want[x["doc_id"], x["place"]]
                assert (x["sentence_number"], x["mean_nll"], x["excerpt"]) == (w["sentence_number"], w["mean_nll"], w["excerpt"])
                assert w["context"] == "..." + x["before"] + " [" + x["excerpt"][:50] + "...] " + x["after"] + "..."
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
