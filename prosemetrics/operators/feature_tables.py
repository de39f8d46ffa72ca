"""The master table of works out of metadata, category counts, word-list shares and term counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import keynorm
from .relational import composite, labelled, master, per_thousand
from .stats import iqr_repair

# Columns of the metadata and category tables, and labels of genres.
META = ["total_characters", "protagonist_concentration", "avg_sentence_length", "avg_word_length", "tuldava_score", "event_count", "speed_avg", "circuitousness", "speed_min", "volume", "BAYES_ranking"]
ARTIFACTS = ["volume", "speed_avg", "speed_min", "circuitousness", "protagonist_concentration"]
EMBODIED = ["noun.body", "verb.perception", "verb.contact", "verb.motion", "verb.body"]
ABSTRACT = ["noun.act", "noun.group", "noun.cognition", "noun.relation", "noun.state"]
GENRES = {"BS": "Bestsellers", "NYT": "NYT Bestsellers", "PW": "Prizewinners", "MY": "Mystery", "SF": "Science Fiction", "ROM": "Romance", "YA": "Young Adult", "MID": "Middlebrow", "BIO": "Biography", "MEM": "Memoir", "HIST": "History", "MIX": "Mixed Nonfiction"}


def keyed(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn("_k", keynorm(F.col(name)))


def metadata(rows: DataFrame) -> DataFrame:
    """Trimmed and coerced features, decimal artefacts repaired, the class flag and the key."""
    for c in META:
        rows = rows.withColumn(c, F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None)))
    rows = rows.withColumns({"Category": F.trim("Category"), "Genre": F.trim("Genre")})
    rows = iqr_repair(rows, ARTIFACTS).withColumn("is_fic", (F.col("Category") == "FIC").cast("int"))
    return keyed(labelled(rows, "Genre", GENRES, "genre_label"), "ID")


def category_rates(counts: DataFrame, meta: DataFrame, name: str = "file_name") -> DataFrame:
    """Counts for each thousand of a work's tokens; a work without metadata has none."""
    features = [c for c in counts.columns if c != name]
    plain = {c: c.replace(".", "_") for c in features}
    x = keyed(counts, name).withColumnsRenamed(plain).join(meta.select("_k", "token_count"), "_k", "left")
    return per_thousand(x, list(plain.values()), "token_count").select("_k", *[f"{c}_n" for c in plain.values()])


def indices(rates: DataFrame) -> DataFrame:
    """embodied, abstract and poetic, their difference, over all rows of the table."""
    name = lambda c: c.replace(".", "_") + "_n"
    x = composite(rates, "embodied", [name(c) for c in EMBODIED])
    x = composite(x, "abstract", [name(c) for c in ABSTRACT])
    return x.select("_k", "embodied", "abstract", (F.col("embodied") - F.col("abstract")).alias("poetic"))


def master_table(meta: DataFrame, rates: DataFrame, shares: DataFrame, lexical: DataFrame) -> DataFrame:
    """The works that all tables have; ``shares`` and ``lexical`` carry the key _k."""
    return master("_k", meta, rates, shares, lexical, indices(rates))


def side_car(rows: DataFrame, layers: dict[str, list[str]]) -> DataFrame:
    """layer, column of the columns that are there."""
    return rows.sparkSession.createDataFrame([(k, c) for k, cs in layers.items() for c in cs if c in rows.columns], "layer string, column string")
