"""Every operator on the edge cases, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from prosemetrics.llm import bpe, context_tree, decontamination, language, neighbours, registry, sharding, similarity, tokens, toxicity, warc

from .cases import documents, empty, prose, rows


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


# 1
def test_shards(spark):
    got = sharding.shard_documents(documents(spark), 4).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert sharding.shard_documents(empty(spark), 4).count() == 0


def test_shards_are_even_and_copies_together(spark):
    data = [(k, prose(k % 700, 20 + k % 13), "en", "a") for k in range(2000)]
    got = sharding.shard_documents(documents(spark, data), 10).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 10 and size.max() < 1.05 * size.mean() and size.min() > 0.95 * size.mean()
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()


def test_a_group_larger_than_a_shard_is_divided(spark):
    data = [(k, "same text" if k % 3 == 0 else prose(k, 3), "en", "a") for k in range(3000)]
    size = sharding.shard_documents(documents(spark, data), 8).toPandas().groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() < 1.06 * size.mean()


def brute_shards(atoms, dims, shards):
    """Shards of atoms {(coordinates..., tie): weight}, by sorting each node's atoms."""
    spread = [max(1, max(a[i] for a in atoms) - min(a[i] for a in atoms)) for i in range(dims)]

    def split(mine, first, n):
        if n == 1 or not mine:
            return dict.fromkeys(mine, first)
        wide = [(max(a[i] for a in mine) - min(a[i] for a in mine)) / spread[i] for i in range(dims)]
        dim = max(range(dims), key=lambda i: (wide[i], -i))
        order = sorted(mine, key=lambda a: (a[dim], a[-1]))
        share, total, left = sum(atoms[a] for a in mine) * (n // 2) / n, 0, set()
        for a in order:
            if total + atoms[a] > share:
                if total + atoms[a] - share < share - total:
                    left.add(a)
                break
            total += atoms[a]
            left.add(a)
        return split([a for a in mine if a in left], first, n // 2) | split([a for a in mine if a not in left], first + n // 2, n - n // 2)

    return split(list(atoms), 0, shards)


@pytest.mark.parametrize(("copies", "shards"), [(1, 7), (30, 8), (400, 10)])
def test_shards_are_those_of_the_sorted_tree(spark, copies, shards):
    """With small groups, and with one larger than a shard, which alone is divided."""
    data = [(k, prose(k % 150 if k >= copies else 9999, 5 + k % 40 if k >= copies else 30), ("en", "fr", None)[k % 3], "ab"[k % 2]) for k in range(600)]
    docs = documents(spark, data)
    rows = sharding.coordinates(docs, shards, ["lang", "source"]).toPandas()
    atoms: dict = {}
    for r in rows.itertuples():
        key = (r.by_lang, r.by_source, r.scale, r.tie)
        atoms[key] = atoms.get(key, 0) + r.size
    expected = brute_shards(atoms, 3, shards)
    got = sharding.shard_documents(docs, shards).toPandas()
    want = {r.doc_id: expected[r.by_lang, r.by_source, r.scale, r.tie] for r in rows.itertuples()}
    assert dict(zip(got["doc_id"], got["shard"], strict=True)) == want
    whole = got.groupby("text_crc32").agg(shards=("shard", "nunique"), bytes=("size", "sum"))
    assert (whole["shards"][whole["bytes"] <= got["size"].sum() / shards] == 1).all()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == shards and size.max() - size.mean() < 2 * max(atoms.values())


# 2
def test_scores(spark, monkeypatch):
    def check():
        docs = documents(spark)
        out = context_tree.score_texts(docs, F.col("doc_id") % 3 != 0).collect()
        assert len(out) == len(rows())
        learned = [t for i, t, *_ in rows() if i is not None and i % 3]
        counts = Counter(w for t in learned for w in blank_words(t))
        n, v = sum(counts.values()) + len(learned), len(counts) + 1
        expected = Counter()
        for i, t, *_ in rows():
            w = blank_words(t)
            base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(learned) + 1) / (n + v + 1))
            expected[i, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, round(base, 6)] += 1
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == expected
        assert all(r["score"] < 0 and r["train_tokens"] == n for r in out)
        return sorted((r["doc_id"] or 0, r["n_tokens"], round(r["score"], 5)) for r in out)

    whole = check()
    monkeypatch.setattr(context_tree, "TYPES_HELD", 5)  # nearly all tokens are joined
    assert check() == whole
    monkeypatch.setattr(context_tree, "EVENTS_HELD", 3)  # and so are the events
    assert check() == whole
    assert context_tree.score_texts(empty(spark), F.lit(True)).count() == 0


def brute_tree(learned: list[str], asked: list[str]) -> list[float]:
    """Context-tree weighting as its definition has it: one dictionary of nodes, recursion from the root."""
    depth = context_tree.DEPTH
    node: dict[tuple, list[int]] = {}

    def decisions(text):
        stream = b"\n" * depth + b"".join(w.encode() + b" " for w in blank_words(text)) + b"\n"
        for k in range(depth, len(stream)):
            for j in range(8):
                yield [(bytes(stream[k - d : k]), d, (1 << j) | stream[k] >> (8 - j)) for d in range(depth + 1)], stream[k] >> (7 - j) & 1

    kids: dict[tuple, set] = {}
    for t in learned:
        for path, bit in decisions(t):
            for d, x in enumerate(path):
                node.setdefault(x, [0, 0])[bit] += 1
                if d:
                    kids.setdefault(path[d - 1], set()).add(x)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted: dict[tuple, tuple[float, float]] = {}  # logarithm, and odds of the own estimate
    for x in sorted(node, key=lambda x: -x[1]):
        own, below = kt(*node[x]), sum(weighted[y][0] for y in kids.get(x, ()))
        weighted[x] = (own, 1e9) if x[1] == depth else (np.logaddexp(own, below) - math.log(2), own - below)

    def said(path, bit, d=0):
        a, b = node.get(path[d], (0, 0))
        p = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == depth or path[d + 1] not in node:
            return p
        share = 1 / (1 + math.exp(-max(-700, min(700, weighted[path[d]][1]))))
        return share * p + (1 - share) * said(path, bit, d + 1)

    return [sum(math.log10(said(path, bit)) for path, bit in decisions(t)) for t in asked]


def test_scores_are_those_of_the_whole_tree(spark, monkeypatch):
    data = [(k, prose(k % 5, 8 + k), "en", "a") for k in range(12)] + [(12, None, "en", "a"), (13, "", "en", "a"), (14, "é😀 zz", "en", "a")]
    expected = brute_tree([t for i, t, *_ in data if i % 3], [t for _, t, *_ in data])
    for bucket, held in ((50_000, 2_000_000), (40, 30)):
        monkeypatch.setattr(context_tree, "BUCKET", bucket)
        monkeypatch.setattr(context_tree, "EVENTS_HELD", held)
        got = {r["doc_id"]: r["score"] for r in context_tree.score_texts(documents(spark, data), F.col("doc_id") % 3 != 0).collect()}
        assert [got[k] for k in range(15)] == pytest.approx(expected, rel=1e-9)


def test_order_of_words_matters(spark):
    data = [(k, "one two three four five six", "en", "a") for k in range(1, 6)] + [(6, "six two four one five three", "en", "a")]
    got = {r["doc_id"]: r["score"] for r in context_tree.score_texts(documents(spark, data), F.col("doc_id") < 6).collect()}
    assert got[1] > got[6] + 1


def test_tree_probabilities_sum_to_one():
    """Over all next bytes in a context, learned or not."""
    rng = np.random.default_rng(0)
    shift = np.uint64(8)
    draw = lambda lo, hi, n: bytes(rng.integers(lo, hi, n).astype(np.uint8))
    seen = np.unique(np.array([int.from_bytes(bytes([97] * (context_tree.DEPTH - 2)) + draw(97, 102, 2) + draw(97, 105, 1), "big") for _ in range(300)], np.uint64))
    context = seen[0] >> shift
    keys = np.unique(np.concatenate([seen, context << shift | np.arange(256, dtype=np.uint64)]))
    tree = context_tree.Tree(keys, np.where(np.isin(keys, seen), 3, 0))
    names = [tree._names(j) for j in range(8)]
    above = np.unique(np.concatenate([c << 8 | n for c, n in names]))
    p = 10 ** tree.scores(above, np.stack([np.full(len(above), 0.1), np.full(len(above), 0.2), np.full(len(above), 0.7)]))  # shorter contexts: a third, two thirds
    assert abs(p[keys >> shift == context].sum() - 1) < 1e-9


def test_kt_is_the_sequential_product():
    for a, b in ((0, 0), (3, 0), (2, 5), (40, 13)):
        x, zeros, ones = 0.0, 0, 0
        for bit in [0] * a + [1] * b:
            x += math.log(((ones if bit else zeros) + 0.5) / (zeros + ones + 1))
            zeros, ones = zeros + (not bit), ones + bit
        assert abs(context_tree.log_kt(np.array([a]), np.array([b]))[0] - x) < 1e-9
    big = context_tree.log_kt(np.array([5000.0]), np.array([9000.0]))[0]
    exact = math.lgamma(5000.5) + math.lgamma(9000.5) - math.lgamma(14001) - 2 * math.lgamma(0.5)
    assert abs(big - exact) < 1e-6


# 3
def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[50:60] = x[0]  # ties
    data = [(k, [float(v) for v in x[k]]) for k in range(400)]
    data += [(400, None), (500, [0.0] * 16), (600, [float("nan")] + [1.0] * 15), (700, [None] + [1.0] * 15), (800, [float("inf")] * 16), (900, [1.0]), (None, [1.0] * 16), (399, data[399][1])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 as code", "'x' as score")
    index, centre, dims = neighbours.build_index(vectors)
    assert index.count() == 401 and dims == 16
    got = neighbours.nearest(index, index.where("vec_id % 100 = 0").select("vec_id", "embedding"), centre, dims).collect()
    hits = 0
    for q in (0, 100, 200, 300):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        all_ = sorted([(d[k], k) for k in range(400) if k != q] + [(d[399], 399)])[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in mine)
        hits += len(Counter(m[1] for m in mine) & Counter(k for _, k in all_))
    assert hits >= 36
    none, c, n = neighbours.build_index(vectors.limit(0))
    assert neighbours.nearest(none, none.select("vec_id", "embedding"), c, n).count() == 0


# 4 and 9
def test_tokens(spark):
    words, count = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    one, two = Tokenizer.from_file(words), Tokenizer.from_file(count)
    for r in tokens.decode(tokens.encode(documents(spark), words), words).collect():
        ids = one.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["decoded"] == one.decode(ids, skip_special_tokens=False)
    for r in tokens.count_tokens(documents(spark), count).collect():
        assert r["n_tokens"] == len(two.encode(r["text"] or "", add_special_tokens=False).ids) and r["n_bytes"] == len((r["text"] or "").encode())
    assert tokens.encode(empty(spark), words).count() == tokens.count_tokens(empty(spark), count).count() == 0


def test_split_and_merge_odd_texts():
    import random

    r = random.Random(5)
    parts = ["a", "b", "'", "s", "re", "'ve", " ", "  ", "\n", "\t", "é", "é", "1", "²", ".", ",", "!", "’", "Σ", "İ", "<|endoftext|>", "|", "中文", "😀", "\xa0", "\x1c", "\x85"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    vocab, tk = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    counter = bpe.Counter(vocab, most=50)  # states are forgotten again and again
    counter.AT_ONCE = 500
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    first, last, at = tokens._spans(data, offsets, True)
    raw = data.tobytes()
    for k, t in enumerate(texts):
        spans = [raw[a:b] for a, b in zip(first[at[k] : at[k + 1]], last[at[k] : at[k + 1]], strict=True)]
        ids = tk.encode(t, add_special_tokens=False).ids
        assert counter.count_all(data, first[at[k] : at[k + 1]], last[at[k] : at[k + 1]]).sum() == len(ids) and [i for s in spans for i in vocab.encode(s)] == ids


@pytest.mark.parametrize("at_once", [1 << 18, 300])
def test_chunk_maps_of_long_pieces(at_once):
    """Unbroken pieces of many chunks: maps that meet soon, late or never."""
    import random

    r = random.Random(8)
    vocab = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    counter = bpe.Counter(vocab, most=20)
    counter.AT_ONCE = at_once
    pieces = ["".join(r.choice(x) for _ in range(n)) for n in (1, 63, 64, 65, 129, 1000, 4000) for x in ("a", "ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "é中😀")]
    data, ends = np.frombuffer("".join(pieces).encode(), np.uint8), np.cumsum([0, *(len(p.encode()) for p in pieces)])
    assert counter.count_all(data, ends[:-1], ends[1:]).tolist() == [len(vocab.encode(p.encode())) for p in pieces]


def test_words_that_a_polynomial_hash_confuses(spark):
    """A Thue-Morse word and its complement: sums of bytes times powers modulo 2^64 are equal."""
    from prosemetrics.llm.common import distinct, span_hash

    one = "".join("ab"[bin(k).count("1") & 1] for k in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    data, at = np.frombuffer((one + two).encode(), np.uint8), np.array([0, 2048, 4096])
    assert len(set(span_hash(data, at[:-1], at[1:]).tolist())) == 2
    assert len(distinct(data, at[:-1], at[1:])[0]) == 2
    docs = documents(spark, [(1, one, "en", "a"), (2, two, "en", "a"), (3, one, "en", "a")])
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in tokens.encode(docs, public_tokenizers.path("word_bpe_49k.json")).collect():
        assert list(r["ids"]) == tk.encode(r["text"], add_special_tokens=False).ids
    assert {r["doc_id"]: r["component_id"] for r in similarity.join_similar(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_bytes_decide_where_hashes_meet(monkeypatch):
    from prosemetrics.llm import common

    monkeypatch.setattr(common, "span_hash", lambda data, start, end: np.zeros(len(start), np.uint64))
    data, at = np.frombuffer(b"abcabdabc", np.uint8), np.array([0, 3, 6, 9])
    where, back = common.distinct(data, at[:-1], at[1:])
    assert [bytes(data[at[w] : at[w + 1]]) for w in where[back]] == [b"abc", b"abd", b"abc"]


@pytest.mark.parametrize("change", [{"model": {"dropout": 0.1}}, {"added": {"lstrip": True}}, {"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": None}])
def test_tokenizer_files_of_other_kinds_are_refused(tmp_path, change):
    import json

    spec = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    spec["model"] |= change.pop("model", {})
    spec["added_tokens"][0] |= change.pop("added", {})
    (tmp_path / "t.json").write_text(json.dumps(spec | change))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "t.json"))


def test_special_strings_of_another_file(spark, tmp_path):
    """Special strings need not hold a bar."""
    import json

    for name, column in (("word_bpe_49k.json", "ids"), ("byte_bpe_50k.json", "n_tokens")):
        spec = json.loads(open(public_tokenizers.path(name), encoding="utf-8").read())
        spec["added_tokens"][0]["content"] = "[END]"
        path = str(tmp_path / name)
        (tmp_path / name).write_text(json.dumps(spec))
        tk, docs = Tokenizer.from_file(path), documents(spark, [(1, "one [END] two[END]", "en", "a"), (2, "[END", "en", "a")])
        out = tokens.encode(docs, path) if column == "ids" else tokens.count_tokens(docs, path)
        for r in out.collect():
            ids = tk.encode(r["text"], add_special_tokens=False).ids
            assert (list(r["ids"]) if column == "ids" else r["n_tokens"]) == (ids if column == "ids" else len(ids))


# 5
@pytest.mark.parametrize(("most", "stretch"), [(500_000, 4_096), (0, 7)])
def test_decontamination(spark, monkeypatch, most, stretch):
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", most)
    monkeypatch.setattr(decontamination, "STRETCH", stretch)
    passage = prose(1, 120).split()
    items = [(1, " ".join(passage[20:45])), (2, " ".join(passage[20:45]).upper()), (3, "two three"), (4, None), (5, ""), (6, prose(99, 30)), (None, " ".join(passage[50:61])), (7, "the the the the the the the the the the the the"), (3, "two three")]
    data = rows() + [(200, "the " * 40, "en", "a"), (201, "x " + " ".join(passage[20:30]) + " y", "en", "a"), (202, " ".join(passage[20:29]), "en", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as w", "2 as content")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    expected = Counter()
    for i, t, *_ in data:
        w, hit, held = find(t), set(), set()
        for k, x in items:
            v = find(x)
            m = min(10, len(v))
            grams = {tuple(v[j : j + m]) for j in range(len(v) - m + 1)} if v else set()
            for j in range(len(w) - m + 1 if v else 0):
                if tuple(w[j : j + m]) in grams:
                    hit |= set(range(j, j + m))
                    held.add("null" if k is None else str(k))
        expected[i, len(w), len(hit), ",".join(sorted(held))] += 1
    got = decontamination.decontaminate(documents(spark, data), bench).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got) == expected
    assert decontamination.decontaminate(documents(spark), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.decontaminate(empty(spark), bench).count() == 0


def test_short_items_in_a_very_long_text(spark):
    """Items of one to nine words in 400,000 words: no row holds them all."""
    words = [f"w{(k * 7919) % 5003}" for k in range(400_000)]
    bench = spark.createDataFrame([(n, " ".join(f"only{n}x{j}" for j in range(n))) for n in range(1, 10)] + [(20, " ".join(words[9:12]))], "item_id long, text string")
    for n in range(1, 10):
        words[40_000 * n : 40_000 * n + n] = [f"only{n}x{j}" for j in range(n)]
    want = sum(words[k : k + 3] == words[9:12] for k in range(len(words) - 2))
    got = decontamination.decontaminate(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), bench).first()
    assert got["n_hit"] == 45 + 3 * want and got["items"] == sorted([*map(str, range(1, 10)), "20"]) and want > 10


# 6
def test_toxicity(spark):
    bad = ["scoundrel", "rotter", "vilka", "vilken", "vilkor"]
    data = [(k, prose(k, 30) + (f" {bad[k % 5]} " + bad[(k // 5) % 5] if k % 4 == 0 else "") + " " + prose(k + 9000, 5), "en", "a") for k in range(600)]
    docs = documents(spark, data + [(10_000, None, "en", "a"), (10_001, "", "en", "a"), (None, "rotter", "en", "a")])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)] + [(0, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs.where(~toxicity.held_out(F.col("doc_id"))), labels.where(~toxicity.held_out(F.col("doc_id"))))
    got = toxicity.score_texts(docs, model).where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxicity").collect()
    right = [(r["toxicity"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 600]
    assert np.mean(right) > 0.97
    every = toxicity.score_texts(docs, model).collect()
    assert len(every) == 603 and all(0 <= r["toxicity"] <= 1 for r in every)
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score_texts(docs, none).select("toxicity").distinct().count() == 1
    assert toxicity.score_texts(empty(spark), model).count() == 0


def test_toxicity_above_the_caps_fits_the_true_shares(spark, monkeypatch):
    """``mild`` is in 250 texts, 100 of them toxic; 300 of 3,000 texts are toxic. Capped classes change neither."""
    word = lambda k: "rotter" if k < 200 else "mild"
    data = [(k, prose(k, 20) + (f" {word(k)}" if k < 450 else ""), "en", "a") for k in range(3000)]
    docs, labels = documents(spark, data), spark.createDataFrame([(k, int(k < 300)) for k in range(3000)], "doc_id long, toxic int")
    asked = documents(spark, [(1, "rotter", "en", "a"), (2, "mild", "en", "a"), (3, "", "en", "a")])

    def scores():
        return [r["toxicity"] for r in toxicity.score_texts(asked, toxicity.fit(docs, labels)).orderBy("doc_id").collect()]

    whole = scores()
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 240)
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 200)
    capped = scores()
    assert whole[0] > 0.5 > whole[1] and capped[0] > 0.5 > capped[1]
    assert max(abs(a - b) for a, b in zip(whole, capped, strict=True)) < 0.1


def test_toxicity_against_brute_force(spark):
    """Entries and patterns found word by word; the model teaches itself from votes, so unlabelled rows move it."""
    from prosemetrics.llm.common import span_hash

    data = [(k, prose(k, 30) + (" rotter scoundrel" if k % 4 == 0 else ""), "en", "a") for k in range(300)]
    docs, labels = documents(spark, data), spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    asked = data[250:] + [(1000, "ROTTER scoundrel!!!!", "en", "a"), (1001, "SHOUTING ONLY", "en", "a"), (1002, "", "en", "a"), (1003, None, "en", "a")]
    weight = dict(zip(model.lexicons.places.tolist(), model.weights.tolist(), strict=False))

    def places(text):
        for word in set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))):
            raw = word.encode()
            for family, n in enumerate(toxicity.FAMILIES):
                if len(raw) >= n:
                    part = raw[:n] if n else raw
                    h = span_hash(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]))[0]
                    yield int(h >> np.uint64(64 - toxicity.BITS)) | family << toxicity.BITS

    def score(text):
        raw = (text or "").encode()
        shown = [sum(65 <= c <= 90 for c in raw) > sum(97 <= c <= 122 for c in raw), raw.count(b"!") > 0.02 * max(1, len(raw)), sum(raw.count(c) for c in (b"*", b"#", b"$")) > 0.01 * max(1, len(raw)), sum(a == b == c for a, b, c in zip(raw, raw[1:], raw[2:], strict=False)) > 0.01 * max(1, len(raw))]
        z = model.bias + sum(weight.get(x, 0.0) for x in set(places(text or ""))) + sum(w for w, on in zip(model.weights[len(weight) :], shown, strict=True) if on)
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_texts(documents(spark, asked), model).collect()}
    assert got == pytest.approx({i: score(t) for i, t, *_ in asked})
    assert got[1000] > 0.5 > got[1002] == got[1003]
    assert len(model.accuracies) == toxicity.LEXICONS + len(toxicity.PATTERNS) == len(model.correlations)
    more = documents(spark, data + [(5000 + k, "rotter", "en", "a") for k in range(3000)])  # without labels
    assert abs(toxicity.fit(more, labels).accuracies - model.accuracies).max() > 1e-6


def test_label_model_finds_good_and_bad_voters():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 4000)
    vote = lambda p: np.where(rng.random(4000) < p, y, 1 - y)
    copy = vote(0.7)
    votes = np.stack([vote(0.9), vote(0.85), vote(0.8), copy, copy], 1)
    votes[rng.random(votes.shape) < 0.2] = -1
    post, accuracy, corr = toxicity.label_model(votes, (votes == 1).sum(1) / np.maximum(1, (votes >= 0).sum(1)))
    assert ((post > 0.5) == y).mean() > 0.9 and accuracy[0] > accuracy[2] > accuracy[3] and corr[3, 4] > 0.4 > corr[0, 1]


# 7
def sets(text):
    w = blank_words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(data):
    ids = [i for i, *_ in data]
    s = [sets(t) for _, t, *_ in data]
    group = list(range(len(data)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(data)):
        for b in range(a):
            both = len(s[a] & s[b])
            if s[a] and s[b] and 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
                group[top(a)] = top(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return Counter((i, len(s[k]), least.get(top(k))) for k, i in enumerate(ids))


@pytest.mark.parametrize(("long", "block"), [(32, 1024), (2, 5)])
def test_similarity(spark, monkeypatch, long, block):
    monkeypatch.setattr(similarity, "LONG", long)  # the second time, nearly all lists go block by block
    monkeypatch.setattr(similarity, "BLOCK", block)
    r = np.random.default_rng(6)
    data = rows()
    for size in range(1, 22):  # every size around the boundary, with edits
        for k in range(4):
            w = prose(500 + size, size + 4).split()
            if k:
                w[int(r.integers(len(w)))] = f"edit{k}"
            if k == 3:
                w = w[:-1]
            data.append((1000 + 10 * size + k, " ".join(w), "en", "a"))
    for k in range(40):  # a chain of edits, and a crowd about one text
        w = prose(77, 150).split()
        for j in range(k % 12):
            w[3 * j] = f"z{j}"
        data.append((2000 + k, " ".join(w), "en", "a"))
        v = prose(78, 100).split()
        v[int(r.integers(100))], v[int(r.integers(100))] = f"q{k}", f"r{k}"
        data.append((3000 + k, " ".join(v), "en", "a"))
    got = similarity.join_similar(documents(spark, data)).collect()
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == components(data)
    assert similarity.join_similar(empty(spark)).count() == 0


def edited(seed, n, k, every):
    w = prose(seed, n).split()
    for j in range(k % 7, n, every):
        w[j] = f"e{k}x{j}"
    return " ".join(w)


def test_a_crowd_of_near_copies_is_never_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "LONG", 4)
    monkeypatch.setattr(similarity, "_crowds", lambda *a: pytest.fail("representatives link all of them"))
    data = [(k, edited(91, 200, k, 150), "en", "a") for k in range(60)]
    got = similarity.join_similar(documents(spark, data)).collect()
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == components(data)
    assert {x["component_id"] for x in got} == {0}


@pytest.mark.parametrize("elements", [1_000_000, 700])
def test_what_representatives_leave_apart(spark, monkeypatch, elements):
    """Near copies, others too far from them, and longer ones of the same passage, in blocks of few sets or shingles."""
    monkeypatch.setattr(similarity, "LONG", 2)
    monkeypatch.setattr(similarity, "BLOCK", 6)
    monkeypatch.setattr(similarity, "ELEMENTS", elements)
    seen, real = [], similarity._blocks
    monkeypatch.setattr(similarity, "_blocks", lambda apart: seen.append(real(apart)) or seen[-1])
    data = [(k, edited(91, 200, k, 150), "en", "a") for k in range(25)] + [(100 + k, edited(91, 200, k, 24 + k), "en", "a") for k in range(25)]
    data += [(200 + k, edited(91, 200, k, 90) + " " + prose(300 + k, 20 * (k % 4)), "en", "a") for k in range(25)]
    got = similarity.join_similar(documents(spark, data)).collect()
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == components(data)
    assert len(seen) == 1
    tiles = seen[0].select("crowd", "i", "j").distinct().collect()
    assert tiles and all((t["i"]["rest"] or t["j"]["rest"]) and t["i"] <= t["j"] and t["j"]["band"] - t["i"]["band"] <= 1 for t in tiles)
    assert any(not t["i"]["rest"] for t in tiles)


def test_bands_hold_every_link():
    band = lambda s: math.floor(math.log(s) / math.log(similarity.BAND))
    assert all(abs(band(s) - band(t)) <= 1 for s in range(1, 700) for t in similarity.partners(s))


def test_similarity_bounds():
    for s in range(1, 60):
        for t in similarity.partners(s):
            i = similarity.overlap(s, t)
            assert 100 * i >= 80 * (s + t - i) and 100 * (i - 1) < 80 * (s + t - i + 1)
        assert similarity.prefix(s) == s - math.ceil(0.8 * s - 1e-9) + max(1, s // similarity.SHARE)


# 8
def test_warc(spark, tmp_path):
    long = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc é 😀"
    data = [(5, "http://a.b/c?d=1#e", long), (3, "http://a.b/d", long), (9, None, long), (3, "http://a.b/d", long), (1, "no url\r\nX: y", "short"), (2, "http://q", "short"), (4, "http://q", None), (6, "http://q", ""), (None, "http://q", long), (None, "http://q", "z" * 150), (7, "http://q", "y" * 100), (8, "http://q", "y" * 100), (10, "http://q", "w" * 99), (11, "http://q", "w" * 99)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as first")
    warc.write_warc(pages, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    captures = warc.assemble(records)
    assert captures.count() == len(data) and captures.where("request is null or metadata is null").count() == 0
    assert {bytes(r["p"]) for r in captures.selectExpr("response.payload as p").where("p is not null").collect()} == {(h or "").encode() for _, _, h in data}
    got = warc.resolve(captures).selectExpr("page_id", "url", "origin_bytes", "digest", "response.kind", "origin").collect()
    first = {}
    for i, _, h in data:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    expected = Counter()
    for i, u, h in data:
        p = (h or "").encode()
        again = h in first and i != first[h]
        expected[i, u, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    assert Counter(tuple(r) for r in got) == expected
    warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_records(spark, str(tmp_path / "none")).count() == 0


def test_warc_rejects_other_bytes():
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"no archive at all"))
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


# 10
def test_language(spark):
    docs = documents(spark)
    model = language.fit(docs)
    got = {(r["doc_id"], r["text"]): r for r in language.identify(docs, model).collect()}
    assert all(got[i, t]["lang_pred"] == "und" and got[i, t]["score"] == 0 for i, t in ((4, None), (5, ""), (6, " \n\t "), (10, "12 345 !!!")))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(empty(spark), model).count() == 0
    nothing = language.fit(empty(spark))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}


def test_language_held_out(spark, small):
    from prosemetrics.llm.common import table

    r = language.op10_output_codes(spark, small).join(table(spark, small, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (r["lang"] == r["lang_pred"]).mean() > 0.95


def test_codewords():
    for n in (1, 2, 4, 7, 12, 60):
        code = language.codewords(n)
        assert code.shape[0] == n and len({tuple(c) for c in code}) == n
        if n > 1:
            assert min((a != b).sum() for k, a in enumerate(code) for b in code[:k]) >= max(1, code.shape[1] // 5)


def test_grams_do_not_cross_texts():
    a, b = np.frombuffer(b"abcxyz", np.uint8), np.frombuffer(b"abc", np.uint8)
    assert (language.grams(a, np.array([0, 3, 6]))[0][:3] == language.grams(b, np.array([0, 3]))[0]).all()


def test_utf8_of_sliced_columns():
    from prosemetrics.llm.common import utf8

    data, offsets = utf8(pa.array(["aa", None, "é", "zz"])[1:3])
    assert data.tobytes().decode() == "é" and offsets.tolist() == [0, 0, 2]


def test_oracles_are_sql():
    """SQL does not express operators 2 and 4, whose brute force is above."""
    sql = __spark_entry__.oracle_sql()
    assert all(isinstance(x, str) for x in sql.values())
    assert set(sql) & set(registry.QUERIES) == {"op3_one_bit_codes", "op5_winnowing", "op8_warc_transactions"}
