"""Queries whose results or work went wrong on larger tables."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassifier

from prosemetrics.operators import fitting, forest, lexical, lm, models, ordering, stats
from prosemetrics.plans import catalogue
from prosemetrics.sources.scratch import stored


def against_sql(spark, name, d, **tables):
    """The rows of a query and of its SQL over tables that are written to ``d``."""
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{d}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    expected = con.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, str(d)).select(*expected.columns).collect()
    return sorted(map(tuple, got), key=str), sorted(expected.fetchall(), key=str)


def test_text_folder_at_the_ends(spark, tmp_path):
    texts = ["Çè two  words", "ends in é", " \té a b ", "no break", "plain"]
    got, expected = against_sql(spark, "text_folder", tmp_path, benchmark=spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"))
    assert got == expected and got[0] == (0, " two words")


def test_p_of_a_large_t():
    """The SQL of correlation_tests adds 2,000 steps up to t, too few here: it gives 0.176975."""
    assert stats.student_two_sided(3967.370541, 256408) == pytest.approx(0, abs=1e-300)


def test_token_blocks_split_a_text_once(spark, small):
    """Not once for every block."""
    plan = catalogue.QUERIES["token_blocks"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


@pytest.mark.parametrize("name", ["index_summary", "composite_indices"])
def test_indices_read_texts_once(spark, small, name):
    """The counts are stored; every moment and join reads these."""
    assert not [f for f in catalogue.QUERIES[name](spark, small).inputFiles() if "documents" in f]


DOCS = [(1, "a b b c the the the"), (2, "the a d"), (2, "e the. the,"), (3, ""), (4, None), (5, "rare the b"), (6, "Zz zz é")]


@pytest.mark.parametrize("name", ["foregrounding", "kl_own_class"])
@pytest.mark.parametrize("most", [0, 3, 1 << 18])
def test_terms_met_by_frequency(spark, tmp_path, monkeypatch, name, most):
    """The same rows whatever part of the vocabulary goes to all tasks; two texts of one id are one."""
    monkeypatch.setattr(ordering, "MOST_SENT", most)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (5, 0)], "doc_id long, quality int")
    got, expected = against_sql(spark, name, tmp_path, documents=docs, labels=labels)
    assert [tuple(round(v, 5) + 0.0 for v in r) for r in got] == [tuple(round(v, 5) + 0.0 for v in r) for r in expected]


def test_no_token_is_shuffled_to_be_counted(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    plan = lexical.term_rows(lexical.document_terms(docs.where("doc_id <> 2")))._jdf.queryExecution().toString()
    assert "Aggregate [" not in plan and "Window" not in plan


def test_features_are_made_once(spark, monkeypatch):
    """Loadings, and the folds of a design, read a stored table, not what made it."""
    seen = []
    monkeypatch.setattr(models, "stored", lambda rows: seen.append(rows.columns) or stored(rows))
    rows = spark.range(40).selectExpr("id as k", "cast(id % 2 as int) as y", "cast(id * id % 7 as double) as a", "cast(id % 5 as double) as b")
    models.loadings(rows, "k", "y", ["a", "b"], 2)
    models.block_scores(rows, "k", "y", {"x": ["a", "b"]}, 2)
    assert seen == [["k", "y", "a", "b"]] * 2


TEXTS = [(1, "en", "A b a b c. The the, of it all! b a b"), (2, "en", "the a b c d e. Of it all."), (3, "de", "der a b. Die die das é it all"), (4, "fr", "x"), (5, "de", ""), (6, None, "a\u00a0b c of it"), (7, "en", None), (8, "en", "It all. Of a b. Nothing else is here.")]
SCORES = ["lm_document_nll", "lm_saved_nll", "ppl_gap", "adaptation_curve", "lm_sentence_nll", "ppl_summary", "top_moments_context", "token_surprisal_top"]


@pytest.mark.parametrize("name", SCORES)
@pytest.mark.parametrize("most", [-1, 6])
def test_scores_whatever_is_sent(spark, tmp_path, monkeypatch, name, most):
    """The same rows as SQL's whether none or some of the words and pairs are with all tasks, of texts in several stretches."""
    monkeypatch.setattr(lm, "MOST_SENT", most)
    monkeypatch.setattr(ordering, "MOST_SENT", most)
    monkeypatch.setattr(lm, "STRETCH", 20, raising=False)
    docs = spark.createDataFrame(TEXTS, "doc_id long, lang string, text string")
    got, expected = against_sql(spark, name, tmp_path, documents=docs)
    near = lambda rows: [tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in rows]
    assert near(got) == near(expected)


def test_models_of_shares_are_counted_together(spark, small, monkeypatch):
    """Three steps by one table of pairs, one of words and one of values; before, each step had its own."""
    seen = []
    monkeypatch.setattr(lm, "stored", lambda rows: seen.append(rows.columns) or stored(rows))
    plan = catalogue.QUERIES["adaptation_curve"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 3 and plan.count("regexp_replace(text") == 1


def test_sentences_are_not_stored(spark, small, monkeypatch):
    """Places are found over numbers; the texts of sentences are neither written nor joined one by one."""
    seen = []
    monkeypatch.setattr(lm, "stored", lambda rows: seen.append(rows.columns) or stored(rows))
    catalogue.QUERIES["top_moments_context"](spark, small)
    assert not [c for c in seen if "sentence" in c]


def test_keys_of_pairs():
    """The key that NumPy gives a pair is the one that the model's table has; order counts."""
    w, k, at = lm.hashed(np.frombuffer(b"a b b a", np.uint8), np.array([0, 7]))
    assert at.tolist() == [0, 4] and w[0] == w[3] and w[1] == w[2] and len(set(k[1:].tolist())) == 3


def measured(n=1500):
    r = np.random.default_rng(1)
    for k in range(n):
        y = int(r.random() < 0.4)
        yield k, y, float(r.normal(0.8 * y)), float(r.integers(0, 6) + y), None if k % 50 == 0 else float(r.normal(-0.5 * y))


SCHEMA = "k long, y int, a double, b double, c double"


def forbidden(*_, **__):
    raise AssertionError


def test_a_forest_of_few_features_passes_rows_once(spark, monkeypatch):
    """Not once for each fold and level; any partitions give the same scores."""
    monkeypatch.setattr(RandomForestClassifier, "_fit", forbidden)
    rows = spark.createDataFrame(list(measured(300)), SCHEMA)
    one, two = (sorted(map(tuple, models.out_of_fold(x, "k", "y", ["a", "b", "c"], 3, 60).collect())) for x in (rows.coalesce(1), rows.repartition(7, "a")))
    assert len(one) == 300 and one == two and {r[2] for r in one} == {0, 1, 2}


def test_cells_do_not_grow_with_copies(spark):
    rows = spark.createDataFrame(list(measured(200)), SCHEMA)
    edges, medians = [[np.array([0.0, 1.0])] * 3] * 2, [np.zeros(3)] * 2
    once, often = (forest.cells(fitting.design(x.selectExpr("k", "y", "a", "b", "c", "k % 2 as fold"), "k", ["y"], ["a", "b", "c"], "fold"), edges, medians) for x in (rows, rows.crossJoin(spark.range(9))))
    assert {(r["model"], r["cell"]): 9 * r["n"] for r in once.collect()} == {(r["model"], r["cell"]): r["n"] for r in often.collect()}


def test_a_forest_over_cells_is_sparks(spark, monkeypatch):
    """As near to the forest of pyspark.ml as another seed of it would be."""
    rows = spark.createDataFrame(list(measured()), SCHEMA)
    own = {r["k"]: r for r in models.out_of_fold(rows, "k", "y", ["a", "b", "c"], 2, 200).collect()}
    monkeypatch.setattr(forest, "MOST_FEATURES", 0)
    theirs = {r["k"]: r for r in models.out_of_fold(rows, "k", "y", ["a", "b", "c"], 2, 200).collect()}
    assert own.keys() == theirs.keys() and all(own[k]["fold"] == theirs[k]["fold"] for k in own)
    p, q = (np.array([t[k]["probability"] for k in sorted(own)]) for t in (own, theirs))
    assert np.corrcoef(p, q)[0, 1] > 0.995 and abs((p - q).mean()) < 0.003 and abs(p - q).mean() < 0.015
    assert all(r["score"] == pytest.approx(200 * r["probability"]) for r in own.values())


def test_a_tree_of_one_split():
    """Bins 0 and 1 part the labels; a mixed cell of one bin is a leaf with its share; equal predictions are one leaf."""
    bins, y = np.array([[0], [1], [1]]), np.array([0, 1, 0])
    tree = forest.Tree(bins, y, np.array([4000, 3000, 1000]), np.random.default_rng(1))
    assert tree.share(np.array([[0], [1], [7]])).tolist() == pytest.approx([0, 0.75, 0.75], abs=0.03)
    flat = forest.Tree(bins, y, np.array([4000, 1000, 3000]), np.random.default_rng(1))
    assert flat.share(np.array([[0], [1]])).tolist() == pytest.approx([0.125, 0.125], abs=0.02)


def test_split_candidates():
    assert forest.candidates(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5]
    even = forest.candidates(np.arange(3200.0))
    assert len(even) == 31 and even.tolist() == [100 * i - 0.5 for i in range(1, 32)]
    heavy = forest.candidates(np.append(np.arange(39.0), np.full(1261, 50.0)))
    assert len(heavy) == 1 and 37 < heavy[0] < 50


def test_no_object_for_each_tree(spark, monkeypatch):
    """A fit by pyspark.ml leaves its trees where they are."""
    monkeypatch.setattr(DecisionTreeClassificationModel, "__init__", forbidden)
    rows = spark.createDataFrame(list(measured(60)), SCHEMA).selectExpr("*", "a * b as d")
    assert models.out_of_fold(rows, "k", "y", ["a", "b", "c", "d"], 2, 3).count() == 60
