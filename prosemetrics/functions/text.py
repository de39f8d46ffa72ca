"""String functions on columns."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .arrays import let

#: A sentence is a run up to and with its end marks; shorter ones than this are dropped.
LEAST_SENTENCE = 6


def clean_text(text: Column) -> Column:
    """White space, Unicode's too, becomes one blank; then characters beyond ASCII go; then the ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"[^\x00-\x7F]", ""))


def words(text: Column) -> Column:
    """Parts between white space; none for a blank text."""
    return F.array_remove(F.split(text, r"\s+"), "")


def sentences(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda s: F.trim(s))
    return F.filter(found, lambda s: F.length(s) >= LEAST_SENTENCE)


def style(tokens: Column) -> dict[str, Column]:
    """Word count, mean word length and type-token ratio; zeros where there are no words."""
    n = F.size(tokens)
    total = F.aggregate(tokens, F.lit(0), lambda s, w: s + F.length(w))
    return {"word_count": n.cast("long"), "avg_word_length": F.when(n > 0, total / n).otherwise(0.0), "ttr": F.when(n > 0, F.size(F.array_distinct(tokens)) / n).otherwise(0.0)}


def greedy_chunks(lengths: Column, most: int) -> Column:
    """Word counts of chunks of whole sentences, of up to ``most`` words; longer sentences are cut to that."""
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("open"))

    def add(s: Column, n: Column) -> Column:
        fits = s["open"] + n <= most
        flushed = F.when(s["open"] > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        cuts = F.concat(F.array_repeat(F.lit(most), F.floor(n / most).cast("int")), F.when(n % most > 0, F.array(n % most)).otherwise(F.array().cast("array<int>")))
        return F.when(fits, F.struct(s["done"].alias("done"), (s["open"] + n).cast("int").alias("open"))).when(n > most, F.struct(F.concat(flushed, cuts).alias("done"), F.lit(0).alias("open"))).otherwise(F.struct(flushed.alias("done"), n.alias("open")))

    return F.aggregate(lengths, start, add, lambda s: F.when(s["open"] > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def chunk_texts(sentence_list: Column, most: int) -> Column:
    """The chunks themselves: their words joined by a blank, cut where ``greedy_chunks`` says. One text's worth at a time."""
    lengths = F.transform(sentence_list, lambda s: F.size(words(s)))

    def cut(tokens: Column, sizes: Column) -> Column:
        ends = F.transform(sizes, lambda n, i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, b: a + b))
        return F.zip_with(ends, sizes, lambda at, n: F.array_join(F.slice(tokens, at + 1, n), " "))

    return let(F.flatten(F.transform(sentence_list, words)), lambda tokens: let(greedy_chunks(lengths, most), lambda sizes: cut(tokens, sizes)))


def token_blocks(tokens: Column, length: int) -> Column:
    """Blocks of ``length`` tokens one after another; what is left over is dropped."""

    def cut(t: Column) -> Column:
        n = F.size(t)
        return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length, F.lit(length)), lambda i: F.slice(t, i + 1, length))).otherwise(F.array().cast("array<array<string>>"))

    return let(tokens, cut)  # once a text, not once a block


@F.pandas_udf(StringType())
def _compatible(names: pd.Series) -> pd.Series:
    """The compatibility form; Spark has no such function of its own. Only names beyond ASCII come here."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def keynorm(name: str | Column) -> Column:
    """Letters a-z and digits of the compatibility form, in lower case."""
    name = F.col(name) if isinstance(name, str) else name
    wide = name.rlike(r"[^\x00-\x7F]")
    return F.regexp_replace(F.lower(F.when(wide, _compatible(F.when(wide, name))).otherwise(name)), "[^a-z0-9]", "")


# Words on the lines that open and close the text of a public-domain e-book, and that credit its makers.
OPENING = ("START OF PROJECT GUTENBERG", "START OF THE PROJECT GUTENBERG", "START OF THIS PROJECT GUTENBERG")
SMALL_PRINT = "*END*THE SMALL PRINT"
CLOSING = ("END OF PROJECT GUTENBERG", "END OF THE PROJECT GUTENBERG", "END OF THIS PROJECT GUTENBERG")
LAST_WORDS = ("End of Project Gutenberg", "End of The Project Gutenberg", "End of the Project Gutenberg")
CREDITS = (
    "Author:", "Character set encoding:", "Credits:", "E-text prepared by", "Editor:", "Etext prepared by", "Illustration", "Illustrator:",
    "Language:", "Posting Date:", "Produced by", "Release Date:", "Release date:", "This e-book was produced by", "This ebook was produced by",
    "Title:", "Transcribed by", "Transcribed from", "Translator:", "Updated editions will", "[Illustration",
)


def _begins(line: Column, words: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.startswith(line, F.lit(w)) for w in words])


def line_kinds(lines: Column) -> Column:
    """What each line is: 1 opens the text, 2 ends the small print, 3 closes the text, 4 credits someone or is blank, 0 none of these."""

    def kind(line: Column) -> Column:
        plain = F.upper(F.trim(F.regexp_replace(line, "[ \\t]+", " ")))
        bare = F.ltrim(F.translate(plain, "*", ""))
        starred = F.startswith(plain, F.lit("**"))
        return (
            F.when(starred & _begins(bare, OPENING), 1)
            .when(F.contains(F.replace(plain, F.lit("*END* "), F.lit("*END*")), F.lit(SMALL_PRINT)), 2)
            .when(starred & _begins(bare, CLOSING) | _begins(F.ltrim(line), LAST_WORDS), 3)
            .when((plain == "") | _begins(F.ltrim(line), CREDITS), 4)
            .otherwise(0)
        )

    return F.transform(lines, kind)


def strip_boilerplate(book: Column) -> Column:
    """The work itself: after the last opening line that ends in the first half (of the small print, where there is no
    other), before the next closing line, without blank and credit lines in front; at most two blank lines on end."""
    text = F.regexp_replace(F.regexp_replace(book, "\r\n?", "\n"), "^\ufeff+", "")
    first = lambda kinds, wanted, after: F.array_min(F.filter(F.transform(kinds, lambda x, i: F.when(wanted(x) & (i >= after), i)), lambda i: i.isNotNull()))

    def opened(lines: Column, kinds: Column) -> Column:
        """The place of the first line of the text proper, before credits."""
        state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit(0).alias("opening"), F.lit(0).alias("small"))
        half = F.floor((F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x) + 1) - 1) / 2)

        def step(s: Column, pair: Column) -> Column:
            end = s["at"] + F.length(pair["line"])
            early = lambda n, name: F.when((pair["kind"] == n) & (end <= half), s["k"] + 1).otherwise(s[name]).alias(name)
            return F.struct((end + 1).alias("at"), (s["k"] + 1).alias("k"), early(1, "opening"), early(2, "small"))

        pairs = F.zip_with(lines, kinds, lambda x, k: F.struct(x.alias("line"), k.alias("kind")))
        return F.aggregate(pairs, state, step, lambda s: F.when(s["opening"] > 0, s["opening"]).otherwise(s["small"]))

    def body(lines: Column, kinds: Column, begin: Column) -> Column:
        end = F.coalesce(first(kinds, lambda x: x == 3, begin), F.size(lines))
        start = F.coalesce(first(kinds, lambda x: x != 4, begin), F.size(lines))
        return F.array_join(F.slice(lines, F.least(start, end) + 1, end - F.least(start, end)), "\n")

    whole = let(F.split(text, "\n"), lambda lines: let(line_kinds(lines), lambda kinds: let(opened(lines, kinds), lambda begin: body(lines, kinds, begin))))
    return F.concat(F.regexp_replace(F.regexp_replace(whole, "\n{4,}", "\n\n\n"), r"^\s+|\s+$", ""), F.lit("\n"))


def shortened(title: Column, most: int = 50) -> Column:
    return F.when(F.length(title) > most, F.concat(F.left(title, F.lit(most - 3)), F.lit("..."))).otherwise(title)


def safe_name(name: Column) -> Column:
    return F.translate(name, " /", "__")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def without(name: Column, part: str) -> Column:
    """``name`` with every ``part`` taken out, inner ones too."""
    return F.replace(name, F.lit(part), F.lit(""))


def overlay_name(titles: Column, most: int = 3) -> Column:
    """A file name for several titles: the first word of each of the first ones, letters and digits, at most 15; then how many more there are is hinted."""
    first = F.transform(F.slice(titles, 1, most), lambda t: F.left(F.regexp_replace(F.element_at(F.split(F.trim(t), r"\s+"), 1), "[^A-Za-z0-9]", ""), F.lit(15)))
    return F.concat(F.array_join(first, "_"), F.when(F.size(titles) > most, F.lit("_and_others")).otherwise(F.lit("")))


def today() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")
