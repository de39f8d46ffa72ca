"""Cleaning, joining and choosing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, words


def coerce(rows: DataFrame, column: str) -> DataFrame:
    """A string column as double; what is no number becomes null."""
    return rows.withColumn(column, F.expr(f"try_cast(`{column}` as double)"))


def finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose values in ``columns`` are all there and finite."""
    for c in columns:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows


def without_infinity(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite values and NaN become null."""
    return rows.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in columns})


def labelled(rows: DataFrame, column: str, labels: dict[str, str], name: str, other: str | None = None) -> DataFrame:
    """``rows`` with the label of a code; a code without one is null, or ``other`` and the code."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else F.create_map().cast("map<string,string>")
    found = names[F.col(column).cast("string")]
    return rows.withColumn(name, found if other is None else F.coalesce(found, F.concat(F.lit(f"{other} "), F.col(column).cast("string"))))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("place = 1").drop("place")


def per_thousand(rows: DataFrame, counts: list[str], tokens: str) -> DataFrame:
    """<count>_n: counts for each thousand tokens; null where there are no tokens."""
    return rows.withColumns({f"{c}_n": F.try_divide(F.col(c) * 1000.0, F.col(tokens)) for c in counts})


#: Small word lists that stand for the categories of a lexicon.
CATEGORIES = {"article": ("the", "a", "an"), "preposition": ("of", "in", "to", "for", "with", "on", "at", "by", "from"), "pronoun": ("it", "he", "she", "they", "we", "you", "this", "that"), "verb": ("is", "was", "be", "are", "were")}


def category_counts(docs: DataFrame, categories: dict[str, tuple[str, ...]] = CATEGORIES) -> DataFrame:
    """doc_id, tokens, and how many of them each category has."""
    x = docs.select("doc_id", words(F.lower(clean_text(F.col("text")))).alias("w"))
    count = lambda names: F.size(F.filter("w", lambda t: t.isin(*names))).cast("long")
    return x.select("doc_id", F.size("w").cast("long").alias("tokens"), *[count(v).alias(k) for k, v in categories.items()])


def composite(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """The mean of the columns' z-scores over all rows."""
    stats = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = [F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")) for c in columns]
    total: Column = z[0]
    for x in z[1:]:
        total = total + x
    return rows.crossJoin(F.broadcast(stats)).select(*rows.columns, (total / len(z)).alias(name))


def master(key: str, *tables: DataFrame) -> DataFrame:
    """The inner join of tables with one row a key; Spark picks the strategy by their sizes."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, "inner")
    return out


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones each time: a sampling operator's limit."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
