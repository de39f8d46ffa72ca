"""The stages decide as brute force and their operators do, and keep the columns."""

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from prosemetrics.llm import language, toxicity
from prosemetrics.llm.common import table

from .cases import documents, prose, rows
from .test_operators import components, low


@pytest.fixture
def folder(spark, tmp_path):
    """A benchmark of one passage and labels of nothing."""
    spark.createDataFrame([(1, prose(51, 40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.select("doc_id", "text").collect())


def test_stage_names_and_columns(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "encoding"]
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_toxicity_stage(spark, small):
    docs = table(spark, small, "documents")
    model = toxicity.fit(docs, table(spark, small, "labels"))
    bad = {r["doc_id"] for r in toxicity.score_texts(docs, model).where("toxicity >= 0.5").select("doc_id").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.not_toxic(spark, docs, small).collect()} == {r["doc_id"] for r in docs.collect()} - bad


def test_toxicity_stage_without_labels_keeps_all(spark, folder):
    assert ids(corpus_pipeline.not_toxic(spark, documents(spark), folder)) == ids(documents(spark))


def test_language_stage(spark, folder):
    docs = documents(spark)
    clear = language.identify(docs, language.fit(docs)).where("lang_pred <> 'und' and not ambiguous")
    kept = corpus_pipeline.known_language(spark, docs, folder)
    assert ids(kept) == ids(clear) and not [x for x in ids(kept) if not re.search("[^\\W\\d_]", x[2])]
    assert ids(corpus_pipeline.known_language(spark, docs.withColumn("lang", docs["lang"].substr(0, 0)).where("lang is null"), folder)) == ids(docs.where("lang is null"))


def test_one_of_each_against_brute_force(spark, folder):
    """Null ids, repeated ids with other texts, repeated rows."""
    base = prose(1, 120)
    data = rows() + [(None, base + " more", "en", "a"), (None, prose(3, 50), "en", "a"), (2, prose(70, 60), "en", "a"), (500, prose(70, 60) + " x", "en", "a"), (13, prose(71, 60), "en", "a")]
    kept = ids(corpus_pipeline.one_of_each(spark, documents(spark, data), folder))
    unique = sorted({(i is None, i or 0, t) for i, t, *_ in data if t is not None} | {(i is None, i or 0, "") for i, t, *_ in data if t is None})
    ranked = [(k, t) for k, (_, _, t) in enumerate(unique)]  # the smallest id first, null ids last
    group = {}
    for (k, _, root), n in components([(k, t, "en", "a") for k, t in ranked]).items():
        assert n == 1
        group[k] = root
    assert kept == [unique[k] for k in range(len(unique)) if group[k] == k]


def test_decontamination_against_brute_force(spark, folder):
    passage = prose(51, 40).split()
    dirty, clean = " ".join(["q"] * 5 + passage[5:15] + ["z"]), " ".join(passage[5:14])
    data = rows() + [(1, dirty, "en", "a"), (None, dirty, "en", "a"), (300, clean, "en", "a"), (301, dirty.upper(), "en", "a")]
    windows = {tuple(passage[k : k + 10]) for k in range(31)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    hit = lambda t: any(tuple(words(t)[k : k + 10]) in windows for k in range(len(words(t)) - 9))
    expected = sorted((i is None, i or 0, t or "") for i, t, *_ in data if not hit(t))
    assert ids(corpus_pipeline.decontaminated(spark, documents(spark, data), folder)) == expected
    assert (False, 1, prose(1, 120)) in expected  # a clean text under the id of a dirty one stays


def test_encoding_stage(spark, folder):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {(r["doc_id"], r["text"]) for r in documents(spark).collect()}
    expected = sorted(str((i, tk.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    got = corpus_pipeline.encoded(spark, documents(spark).dropDuplicates(["doc_id", "text"]), folder)
    assert sorted(str((r["doc_id"], list(r["ids"]))) for r in got.collect()) == expected


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    assert out.where("n_tokens <> size(ids)").count() == 0 and 100 < out.count() < 200
