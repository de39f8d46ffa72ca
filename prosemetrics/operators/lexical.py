"""Foregrounding measures from term counts in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import clean_text, words
from ..sources.scratch import spread, stored
from .ordering import met

FLOOR = 1e-12


def counted(text: Column) -> Column:
    """Structs term, cnt of the words of a cleaned, lower-case text, in the order of terms: runs of its sorted words."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.transform(t, lambda w, i: F.when((i == 0) | (w != F.get(t, i - 1)), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(t)) - i).cast("long").alias("cnt"))))

    return let(F.sort_array(words(F.lower(clean_text(text)))), runs)


def one_text_each(docs: DataFrame) -> DataFrame:
    """doc_id, text: texts that share an id become one, which has the words of all."""
    docs = docs.select("doc_id", "text")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # ids alone are shuffled
        return docs
    return docs.groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))


def document_terms(docs: DataFrame) -> DataFrame:
    """doc_id, n, terms: a row for each document, counted where its text is read; no token is shuffled."""
    each = spread(one_text_each(docs), "doc_id").select("doc_id", counted(F.col("text")).alias("terms"))
    return each.select("doc_id", F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + t["cnt"]).alias("n"), "terms")


def term_rows(documents: DataFrame) -> DataFrame:
    """doc_id, term, cnt, n and what other columns there are, of ``document_terms``."""
    rest = [c for c in documents.columns if c not in ("doc_id", "n", "terms")]
    return documents.select("doc_id", F.inline("terms"), "n", *rest)


def corpus_frequency(counts: DataFrame) -> DataFrame:
    """term, c: counts over all documents."""
    return counts.groupBy("term").agg(F.sum("cnt").alias("c"))


def rare_terms(frequency: DataFrame, share: float = 0.5) -> Column:
    """Whether a term c, term belongs to the rarer part of the vocabulary, ties by the term.

    Terms of a smaller count come first, so only those of one count are cut; of these, only the ones with the
    beginning that the cut falls in are ordered. No task orders the vocabulary.
    """

    def cut(rows: DataFrame, key: str, limit: int) -> tuple:
        """The first value of ``key`` by which ``limit`` rows are reached, and the rows still wanted there."""
        by = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)))  # over distinct values
        r = by.where(F.col("upto") >= limit).orderBy(key).select(key, (limit - F.col("upto") + F.col("n")).alias("rest")).first()
        return r[0], r[1]

    limit = int(frequency.count() * share)
    if not limit:
        return F.lit(False)
    c, rest = cut(frequency, "c", limit)
    same = frequency.where(F.col("c") == c).withColumn("start", F.left("term", F.lit(4)))
    start, rest = cut(same, "start", rest)
    last = same.where(F.col("start") == start).orderBy("term").limit(rest).agg(F.max("term")).first()[0]
    return (F.col("c") < c) | ((F.col("c") == c) & (F.col("term") <= last))


def exact_sum(x: Column) -> Column:
    """A sum of doubles at fifteen places, which the order of rows does not change; it is to stay below 9,000."""
    return F.sum(F.rint(x * 1e15).cast("long")) / 1e15


def foregrounding(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, lex_rarity, types_used_rate, hapax_rate, rare_tail_share, work_entropy, kl_from_corpus.

    The frequent terms' counts go to all tasks, so that only rare terms are shuffled.
    """
    counts = term_rows(stored(document_terms(docs)))
    frequency = stored(corpus_frequency(counts))
    whole = frequency.agg(F.sum("c")).first()[0] or 1
    x = met(counts, frequency.withColumn("rare", rare_terms(frequency)), ["term"], "c").withColumns({"p": F.col("cnt") / F.col("n"), "q": F.col("c") / F.lit(whole)})
    ln = lambda c: F.log(F.col(c) + FLOOR)
    return x.groupBy("doc_id").agg(
        F.max("n").alias("n_tokens"),
        exact_sum(-F.col("p") * ln("q")).alias("lex_rarity"),
        (F.count("*") / F.max("n")).alias("types_used_rate"),
        (F.count_if(F.col("cnt") == 1) / F.max("n")).alias("hapax_rate"),
        (F.coalesce(F.sum(F.when(F.col("rare"), F.col("cnt"))), F.lit(0)) / F.max("n")).alias("rare_tail_share"),
        exact_sum(-F.col("p") * ln("p")).alias("work_entropy"),
        exact_sum(F.col("p") * (ln("p") - ln("q"))).alias("kl_from_corpus"),
    )


def kl_from_class(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, kl_own: divergence from the mean distribution of the document's class; no label counts as class 0."""
    own = labels.groupBy("doc_id").agg(F.max(label).alias("label"))
    documents = stored(document_terms(docs).join(own, "doc_id", "left").withColumn("cls", F.coalesce("label", F.lit(0))).drop("label"))
    x = term_rows(documents).withColumn("p", F.col("cnt") / F.col("n"))
    mass = x.groupBy("cls").agg(F.sum("p").alias("mass"))
    sums = stored(x.groupBy("cls", "term").agg(F.sum("p").alias("s"), F.count("*").alias("held_by")))
    centre = sums.join(F.broadcast(mass), "cls").select("cls", "term", (F.col("s") / F.col("mass")).alias("q"), "held_by")
    return met(x, centre, ["cls", "term"], "held_by").groupBy("doc_id").agg(F.sum(F.col("p") * (F.log(F.col("p") + FLOOR) - F.log(F.col("q") + FLOOR))).alias("kl_own"))


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """z_<column>: over the sample deviation of all rows, whose moments are one broadcast row."""
    stats = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = rows.crossJoin(F.broadcast(stats))
    return out.select(*rows.columns, *[F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")).alias(f"z_{c}") for c in columns])


def foregrounding_index(measures: DataFrame) -> DataFrame:
    measures = stored(measures)
    four = ["lex_rarity", "types_used_rate", "hapax_rate", "rare_tail_share"]
    z = standardised(measures.select("doc_id", *four), four)
    return z.select("doc_id", ((F.col("z_lex_rarity") + F.col("z_types_used_rate") + F.col("z_hapax_rate") + F.col("z_rare_tail_share")) / 4).alias("foregrounding_index"))
