"""A training corpus out of ``documents``, stage by stage; each stage's rows are written and read again.

All stages but the last return the columns of ``documents``, extra columns included. A row is known by its doc_id
and text together (``row_key``), so that null and repeated ids are rows like others: what is decided about one text
touches no other text under the same id. Null and empty texts have no words, shingles or letters: they are not
toxic unless the corpus's labels say so of most texts, go in ``known_language`` where there is a language to learn,
and encode to no ids. Texts of any length are read whole. Empty tables pass every stage and stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemetrics.llm import common, decontamination, language, similarity, tokens, toxicity
from prosemetrics.llm.common import row_key, table, written

#: Keys that are broadcast at most (some 50 MB) to take rows out; more of them are joined by a shuffle.
MOST_BROADCAST = 500_000
KEY = "pipeline_row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, row_key(F.col("doc_id"), F.col("text")))


def _without(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``docs``, with their keys, less the rows whose key is in the one column of ``rows``."""
    gone = written(rows.toDF(KEY).distinct(), name)
    few = gone.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return _keyed(docs).join(F.broadcast(gone) if few else gone, KEY, "left_anti")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5; the model learns from the labelled rows among them.

    Without labels all texts score the same and under 0.5: all stay. Repeated rows share their fate.
    """
    common.drop_broadcasts()
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs.select(F.struct(*docs.columns).alias("pipeline_row"), "text"), model).where("toxicity < 0.5").select("pipeline_row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of one clear language: not those without letters (null and empty texts too) or between two.

    The model learns from every lang that is not null. Without one to learn, all rows stay.
    """
    common.drop_broadcasts()
    model = language.fit(docs)
    if not model.languages:
        return docs
    marked = language.identify(docs.select(F.struct(*docs.columns).alias("pipeline_row"), "text"), model)
    return marked.where((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous")).select("pipeline_row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the smallest doc_id, once; a null id only where all are null.

    Rows with the same id and text are one document: the first by its other columns stays. Texts without words are
    near nothing; of those with equal id and text one stays.
    """
    common.drop_broadcasts()
    ident = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(KEY).alias("row"))
    groups = similarity.join_similar(_keyed(docs).select(ident.alias("doc_id"), "text"))
    rest = _without(docs, groups.where("doc_id <> component_id").select("doc_id.row"), "near-duplicates")
    if not _keyed(docs).groupBy(KEY).count().where("count > 1").limit(1).count():
        return rest.select(docs.columns)
    order = Window.partitionBy(KEY).orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")] or ["doc_id"])
    return rest.withColumn("pipeline_place", F.row_number().over(order)).where("pipeline_place = 1").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no window with the benchmark; an empty benchmark takes none, nor do texts without words go."""
    common.drop_broadcasts()
    marked = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, marked.where("n_hit > 0").select("row"), "contaminated").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every row; null and empty texts have no ids."""
    common.drop_broadcasts()
    out = tokens.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", not_toxic),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("encoding", encoded),
]
#: The first two stages are learned, which SQL cannot express; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's own intermediate tables go as soon as its rows are written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        since = common.made()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
            common.forget(since, but=1)
    return docs
