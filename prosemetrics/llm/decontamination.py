"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Of the K-gram hashes in each window of WINDOW neighbours, the smallest is kept; a span of K + WINDOW - 1 words
that two texts share has its window's smallest in common, so that joining the kept hashes finds every such span.
Each hit is extended by comparing, word for word, the spans that its fingerprint stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, table, written

#: Words of a benchmark window; K-gram length; K-grams in a window of them.
SPAN, K = 10, 5
WINDOW = SPAN - K + 1
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fingerprints or windows of a benchmark that are broadcast at most (some 50 MB); more of them are joined by a shuffle.
MOST_BROADCAST = 500_000
#: Positions of a text that one row has, where windows of under SPAN words are looked for.
STRETCH = 4_096


def word_array(text: Column) -> Column:
    """Words of characters other than ASCII punctuation and controls, A-Z in lower case."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")  # splitting is several times faster than extracting


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _upto(n: Column) -> Column:
    """0 .. n - 1; none if n is 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def kgrams(words: Column) -> Column:
    """The hash of each K neighbouring words."""
    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: F.transform(_upto(F.size(h) - (K - 1)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(K)])))


def fingerprints(words: Column) -> Column:
    """Structs first, last, hash: the smallest K-gram hash in each window of WINDOW K-grams, kept once for a run of
    neighbouring windows, first to last, that have the same."""
    mins = let(kgrams(words), lambda g: F.transform(_upto(F.size(g) - (WINDOW - 1)), lambda i: F.least(*[F.get(g, i + j) for j in range(WINDOW)])))
    fresh = lambda m: F.filter(_upto(F.size(m)), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
    return let(mins, lambda m: let(fresh(m), lambda s: F.transform(s, lambda i, k: F.struct(i.alias("first"), (F.coalesce(F.get(s, k + 1), F.size(m)) - 1).alias("last"), F.get(m, i).alias("hash")))))


def _few(df: DataFrame, size: Column | None = None) -> DataFrame:
    """A written table, marked for broadcast if its rows (or the sum of ``size``) are few enough."""
    held = df.agg(F.sum(size)).first()[0] or 0 if size is not None else df.limit(MOST_BROADCAST + 1).count()
    return F.broadcast(df) if held <= MOST_BROADCAST else df


def benchmark_windows(benchmark: DataFrame, item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """The distinct windows (content, length, cls) of the items, and the items of each class.

    A class is the set of items that hold a window: copies of an item share one. Items of under SPAN words are
    one window; items without words, null ones too, have none, and a null id is an item like others.
    """
    words = written(benchmark.select(F.col(item).cast("string").alias("item"), word_array(F.col("text")).alias("w")), "benchmark-words")
    starts = F.when(F.size("w") >= SPAN, _upto(F.size("w") - (SPAN - 1))).when(F.size("w") > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    each = words.select("item", "w", F.explode(starts).alias("i")).select("item", F.array_join(F.slice("w", F.col("i") + 1, SPAN), " ").alias("content"), F.least(F.size("w"), F.lit(SPAN)).alias("length"))
    # a class is known by a sum of hashes over its distinct items, so that no task holds them all
    each = written(each.distinct(), "benchmark-windows")
    a, b = F.xxhash64("item").cast("decimal(20,0)"), F.xxhash64("item", F.lit(1)).cast("decimal(20,0)")
    windows = written(each.groupBy("content", "length").agg(F.concat_ws("-", F.sum(a).cast("string"), F.sum(b).cast("string"), F.count("*").cast("string")).alias("cls")), "benchmark-classes")
    one = windows.groupBy("cls").agg(F.min("content").alias("content"))
    return windows, written(each.join(one, "content").select("cls", "item"), "benchmark-items")


def _stretches(words: Column, beyond: int) -> Column:
    """Structs at, w: STRETCH words from the place at on, and ``beyond`` more, so that a row stays small however long a text is."""
    at = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(STRETCH))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.slice(words, i + 1, STRETCH + beyond).alias("w")))


def _run_hashes(hashes: Column, lengths: list[int], body) -> Column:
    """``body`` of one array for each of ``lengths``: the hash of so many neighbours from each place on.

    The hash of n is that of n - 1 and the next one, so that each length costs one step a place.
    """

    def grow(n: int, own: Column, found: list[Column]) -> Column:
        found = [*found, own] if n in lengths else found
        if n == max(lengths):
            return body(found)
        longer = F.transform(_upto(F.size(own) - 1), lambda i: F.xxhash64(F.get(own, i), F.get(hashes, i + n)))
        return let(longer, lambda x: grow(n + 1, x, found))

    return grow(1, hashes, [])


def _short_hits(docs: DataFrame, short: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows doc, pos, length, cls of the windows of these lengths: found by hash, position by position, and compared as text."""
    word_hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    parts = docs.select("doc", F.explode(let(word_array(F.col("text")), lambda w: _stretches(w, max(lengths) - 1))).alias("c")).select("doc", "c.at", "c.w")
    each = lambda n, g: F.transform(F.slice(g, 1, STRETCH), lambda x, i: F.struct(i.alias("i"), F.lit(n).alias("length"), x.alias("hash")))
    every = lambda h: _run_hashes(h, lengths, lambda found: F.flatten(F.array(*[each(n, g) for n, g in zip(lengths, found, strict=True)])))
    grams = parts.select("doc", "at", F.explode(let(word_hashes(F.col("w")), every)).alias("g")).select("doc", "at", "g.*")
    own = let(word_hashes(F.split("content", " ")), lambda h: _run_hashes(h, lengths, lambda found: F.coalesce(*[F.when(F.size(h) == n, F.get(g, F.lit(0))) for n, g in zip(lengths, found, strict=True)])))
    marks = written(short.select("length", own.alias("hash")).distinct(), "benchmark-short-marks")
    found = grams.join(_few(marks), ["length", "hash"], "left_semi").groupBy("doc", "at").agg(F.collect_set(F.struct("i", "length")).alias("hits"))  # no more than a stretch has
    found = written(found, "document-short-candidates")
    near = parts.join(_few(found, F.size("hits") + 1), ["doc", "at"]).select("doc", "at", "w", F.explode("hits").alias("x"))
    spans = near.select("doc", (F.col("at") + F.col("x.i")).alias("pos"), "x.length", F.array_join(F.slice("w", F.col("x.i") + 1, F.col("x.length")), " ").alias("content"))
    return spans.join(_few(short), ["content", "length"]).select("doc", "pos", "length", "cls")


def find_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows doc, pos, length, cls: an occurrence of a window in the words of docs(doc, text)."""
    long, short = windows.where(F.col("length") == SPAN), windows.where(F.col("length") < SPAN)
    marks = written(long.select(F.explode(fingerprints(F.split("content", " "))).alias("f")).select("f.hash").distinct(), "benchmark-fingerprints")
    prints = docs.select("doc", F.explode(fingerprints(word_array(F.col("text")))).alias("f")).select("doc", "f.hash", "f.first", "f.last")
    found = prints.join(_few(marks), "hash", "left_semi").groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("at"))  # no more than one document has
    found = written(found, "document-candidates")
    # extension: the windows that a hit's hash is the smallest of, compared as text
    near = docs.join(_few(found, F.size("at") + 1), "doc").select("doc", word_array(F.col("text")).alias("w"), "at").select("doc", "w", F.explode("at").alias("at"))
    spans = near.select("doc", "w", F.explode(F.sequence("at.first", "at.last")).alias("pos")).select("doc", "pos", F.array_join(F.slice("w", F.col("pos") + 1, SPAN), " ").alias("content"))
    hits = spans.join(_few(long), "content").select("doc", "pos", "length", "cls")
    lengths = [n for (n,) in short.select("length").distinct().sort("length").collect()]  # at most SPAN - 1
    if lengths:
        hits = hits.unionByName(_short_hits(docs, written(short, "benchmark-short"), lengths))
    return hits


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of ``docs`` as doc_id, row (its ``row_key``), n_words, n_hit, first_hit (a position), items (sorted ids).

    Words are runs of characters other than ASCII punctuation and controls, A-Z in lower case. A word is hit if
    it lies in an occurrence of any window of the benchmark. Rows that repeat a doc_id and text get equal results;
    equal doc_ids with different texts are told apart; a null text has no words. An empty benchmark hits nothing,
    and an empty ``docs`` gives no rows.
    """
    windows, items = benchmark_windows(benchmark)
    keyed = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("doc"), "text")
    hits = written(find_hits(keyed.select("doc", "text"), windows).distinct(), "document-hits")
    # positions: distinct words in the union of the spans; runs of starts are merged, one document at a time
    starts = F.array_sort(F.collect_set(F.struct("pos", "length")))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["pos"] + x["length"] - F.greatest(x["pos"], s["end"]))).alias("n"), F.greatest(s["end"], x["pos"] + x["length"]).alias("end")), lambda s: s["n"])
    counts = hits.groupBy("doc").agg(covered.cast("long").alias("n_hit"), F.min("pos").alias("first_hit"))
    # documents with the same classes have the same items: each set of classes meets its items once, not once a document
    held = written(hits.groupBy("doc").agg(F.array_sort(F.collect_set("cls")).alias("classes")).withColumn("set", F.xxhash64("classes")), "document-classes")
    sets = held.groupBy("set", "classes").agg(F.count("*").alias("docs")).select("set", F.col("classes").alias("of"), F.explode("classes").alias("cls"))
    named = sets.join(_few(items), "cls").groupBy("set", "of").agg(F.array_sort(F.collect_set(F.coalesce("item", F.lit("null")))).alias("items"))
    named = held.join(named, (held["set"] == named["set"]) & (F.col("classes") == F.col("of"))).select("doc", "items")
    marks = written(counts.join(named, "doc"), "document-marks")
    rows = keyed.select("doc_id", "doc", F.size(word_array(F.col("text"))).cast("long").alias("n_words"))
    return rows.join(_few(marks, F.size("items") + 1), "doc", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))}).withColumnRenamed("doc", "row")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every whole document; a null item_id counts as the item null."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bg as (select distinct item, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from bw where len(w) > 0)),
ns as (select distinct n from bg),
dg as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, ns where len(w) >= n)),
h as (select doc_id, i, dg.n, item from dg join bg on dg.g = bg.g and dg.n = bg.n),
c as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as p from h) group by 1),
t as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by 1)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join c on dw.doc_id = c.doc_id left join t on dw.doc_id = t.doc_id
"""
