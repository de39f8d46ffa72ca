"""Functions of this package by name, for use in SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from ..operators.stats import p_normal, p_student
from ..sources.shipping import ship
from .text import LEAST_SENTENCE, _compatible

FUNCTIONS = {"p_student": p_student, "p_normal": p_normal, "compatibility_form": _compatible}
#: Plain SQL expressions of the column functions that need no Python.
EXPRESSIONS = {
    "clean_text": ("text string", "string", r"trim(regexp_replace(regexp_replace(text, r'(?U)\s+', ' '), r'[^\x00-\x7F]', ''))"),
    "title_label": ("title string", "string", "case when length(title) > 50 then concat(left(title, 47), '...') else title end"),
    "safe_name": ("name string", "string", "translate(name, ' /', '__')"),
    "cosine_similarity_of": ("x array<double>, y array<double>", "double", "aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, v) -> s + v) / sqrt(aggregate(x, 0D, (s, v) -> s + v * v) * aggregate(y, 0D, (s, v) -> s + v * v))"),
}


@udtf(returnType="chunk_number int, chunk string, word_count int", useArrow=True)
class ChunksOf:
    """chunks_of(text, most): chunks of whole sentences of up to ``most`` words, for use with LATERAL.

    Longer sentences are cut to that. A null text, or a blank one, has no chunks; ``most`` under 1 is an error.
    """

    def eval(self, text: str, most: int) -> Iterator[tuple]:
        if most is None or most < 1:
            raise ValueError("most must be at least 1")
        plain = re.sub(r"[^\x00-\x7F]", "", re.sub(r"\s+", " ", text or "")).strip(" ")
        waiting, number = [], 0
        for sentence in re.findall(r"[^.!?]+[.!?]*", plain):
            sentence = sentence.strip(" ")
            own = sentence.split() if len(sentence) >= LEAST_SENTENCE else []
            if waiting and len(waiting) + len(own) > most:
                yield number, " ".join(waiting), len(waiting)
                waiting, number = [], number + 1
            waiting += own
            if len(waiting) > most:  # one long sentence: its cuts stand alone
                for k in range(0, len(waiting), most):
                    yield number, " ".join(waiting[k : k + most]), len(waiting[k : k + most])
                    number += 1
                waiting = []
        if waiting:
            yield number, " ".join(waiting), len(waiting)


@arrow_udtf(returnType="doc_id long, place int, sentence_number int, mean_nll double, excerpt string, before string, after string")
class TopMoments:
    """top_moments(n, TABLE(t) PARTITION BY doc_id ORDER BY sentence_number): the n most surprising sentences of a document.

    t: doc_id, sentence_number, sentence, mean_nll. First ones first among equals; sentences without a value have no
    place but are neighbours. Of a document only the best so far and two neighbours are held, not its sentences.
    """

    def __init__(self) -> None:
        self.best, self.last, self.open = None, None, []

    def eval(self, n: pa.Array, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        n = n[0].as_py()
        ids, numbers, texts, values = (rows.column(c) for c in ("doc_id", "sentence_number", "sentence", "mean_nll"))
        before = pa.concat_arrays([pa.array([self.last], pa.string()), texts.cast(pa.string()).slice(0, max(0, len(texts) - 1))]) if len(texts) else texts
        after = pa.concat_arrays([texts.cast(pa.string()).slice(1), pa.array([None], pa.string())]) if len(texts) else texts
        new = pa.table({"doc_id": ids.cast(pa.int64()), "sentence_number": numbers.cast(pa.int32()), "mean_nll": values.cast(pa.float64()), "sentence": texts.cast(pa.string()), "before": before, "after": after})
        if self.best is not None and len(texts):  # the sentence that ended the batch before has its neighbour now
            at = self.best.column("sentence_number").to_pylist()
            following = [texts[0].as_py() if k == self.open else x for k, x in zip(at, self.best.column("after").to_pylist(), strict=True)]
            self.best = self.best.set_column(5, "after", pa.array(following, pa.string()))
        if len(texts):
            self.last, self.open = texts[-1].as_py(), numbers[-1].as_py()
        pool = new if self.best is None else pa.concat_tables([self.best, new])
        pool = pool.filter(pc.is_valid(pool.column("mean_nll")))
        self.best = pool.take(pc.sort_indices(pool, [("mean_nll", "descending"), ("sentence_number", "ascending")]).slice(0, n))
        yield from ()

    def terminate(self) -> Iterator[pa.Table]:
        if self.best is None or not self.best.num_rows:
            return
        b = self.best
        cut = lambda c, start, stop: pc.utf8_slice_codeunits(pc.fill_null(b.column(c), ""), start, stop)
        yield pa.table({"doc_id": b.column("doc_id"), "place": pa.array(range(1, b.num_rows + 1), pa.int32()), "sentence_number": b.column("sentence_number"), "mean_nll": b.column("mean_nll"), "excerpt": cut("sentence", 0, 100), "before": cut("before", -50, None), "after": cut("after", 0, 50)})


TABLES = {"chunks_of": ChunksOf, "top_moments": TopMoments}


def register(spark: SparkSession) -> list[str]:
    """Makes all of them known to the session; expressions stay plain SQL, which Spark optimizes through."""
    ship(spark)
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    for name, function in TABLES.items():
        spark.udtf.register(name, function)
    for name, (arguments, result, body) in EXPRESSIONS.items():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {result} return {body}")
    return [*FUNCTIONS, *TABLES, *EXPRESSIONS]
