"""Whitening, the filter audit and vector packing, against brute force."""

import itertools
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from prosemetrics.llm import filters, packing, whitening

from .cases import documents, empty, prose, rows

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, data):
    return spark.createDataFrame(data, VECTORS).selectExpr("*", "1 as n", "'x' as x", "0 as component")


# 11
def brute_whitening(data, components=4):
    """n, deviations by row, covariance's eigenvalues, and the projections' absolute values."""
    good = [(k, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for k, v, _ in data if v and all(c is not None and np.isfinite(c) for c in v)]
    length = max({len(x) for _, x in good}, key=lambda d: (sum(len(x) == d for _, x in good), d))
    good = [(k, x) for k, x in good if len(x) == length]
    fit = sorted({tuple(x) for _, x in good})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, float) - np.array([s / n for s in total])
    v = sum(np.outer(r, r) for r in x) / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1][:, :components]
    out = {}
    for k, own in good:
        own_white = (np.array(own) - np.array([s / n for s in total])) @ axes
        out.setdefault(k, []).append((sum((n * c - s) ** 2 for c, s in zip(own, total, strict=True)), own_white / np.sqrt(np.maximum(e[: axes.shape[1]], 1e-300))))
    return n, out, e / max(1e-300, e.sum()), e


@pytest.mark.parametrize("dims", [3, 70])
def test_whitening(spark, dims, monkeypatch):
    """Over several tiles and row blocks; copies count once."""
    r = np.random.default_rng(5)
    data = [(k, (r.standard_normal(dims) * np.arange(1, dims + 1) / 9).astype(np.float32).tolist(), 0) for k in range(400)]
    data += [(400 + k, data[7][1], 0) for k in range(200)] + [(7, data[7][1], 1), (None, data[3][1], 0)]
    odd = [(900, None, 0), (901, [], 0), (902, [float("nan")] * dims, 0), (903, [None] * dims, 0), (904, [float("inf")] * dims, 0), (905, [1.0] * (dims + 1), 0), (906, [0.0] * dims, 0), (907, [-0.0] * dims, 0)]
    usable = whitening.usable(vectors(spark, data + odd)).repartition(5)
    monkeypatch.setattr(whitening.covariance, "__defaults__", (None, 32, 50))
    found = whitening.fit(usable)
    got = whitening.whiten(usable, found).toPandas()
    n, want, explained, _ = brute_whitening(data + odd)
    assert (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    assert len(got) == min(4, dims) * sum(len(v) for v in want.values())
    assert np.allclose(found.axes.T @ found.axes, np.eye(min(4, dims)), atol=1e-12)
    signs = {}
    for key, own in got.groupby(got["vec_id"].fillna(-1)):
        expected = want[None if key == -1 else int(key)]
        assert sorted(own["deviation"].tolist()) == sorted(d for d, w in expected for _ in w)
        for c, x in own.groupby("component"):
            for have, (_, w) in zip(sorted(x["whitened"].abs()), sorted(expected, key=lambda t: abs(t[1][c - 1])), strict=True):
                assert have == pytest.approx(abs(w[c - 1]), abs=1e-9)
                if abs(w[c - 1]) > 1e-6 and len(expected) == 1:
                    signs.setdefault(c, set()).add(bool((x["whitened"].iloc[0] > 0) == (w[c - 1] > 0)))
            assert x["explained"].iloc[0] == pytest.approx(explained[c - 1], rel=1e-9)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_without_variance(spark):
    """One distinct vector: no component varies. Two: one component does."""
    one = whitening.usable(vectors(spark, [(k, [0.5, 0.25], 0) for k in range(5)]))
    got = whitening.whiten(one, whitening.fit(one)).collect()
    assert len(got) == 10 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, None) for r in got)
    two = whitening.usable(vectors(spark, [(1, [0.5, 0.25], 0), (2, [0.25, 0.25], 0)]))
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(two, whitening.fit(two)).collect()}
    assert abs(got[1, 1]["whitened"]) == pytest.approx(1) and got[1, 2]["whitened"] is None and got[1, 1]["explained"] == pytest.approx(1) and got[1, 1]["identity_error"] < 1e-12


def test_whitening_of_large_numbers_and_of_nothing(spark):
    assert whitening.deviations(np.array([[1 << 40, 0], [3, 4]]), 1 << 20, [5, 6]) == [None, ((3 << 20) - 5) ** 2 + ((4 << 20) - 6) ** 2]
    assert whitening.fit(whitening.usable(vectors(spark, []))) is None
    large = whitening.usable(vectors(spark, [(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0)]))
    assert large.orderBy("vec_id").first()["x"] == [(1 << 63) - 1, 256]
    got = whitening.whiten(large, whitening.fit(large)).where("component = 1").collect()
    assert [r["deviation"] for r in got] == [None, None] and sorted(round(r["whitened"], 9) for r in got) == [-1, 1]


def test_whitening_query(spark, small):
    got = __spark_entry__.queries()["op11_tiled_whitening"](spark, small).toPandas()
    raw = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    n, want, _, _ = brute_whitening([(r["vec_id"], r["embedding"], 0) for r in raw])
    assert len(got) == 4 * sum(len(v) for v in want.values()) and (got["n"] == n).all() and got["identity_error"].max() < 1e-9
    first = {int(r.vec_id): r for r in got[got["component"] == 1].itertuples()}
    assert all(r.deviation == want[k][0][0] and abs(r.whitened) == pytest.approx(abs(want[k][0][1][0]), abs=1e-8) for k, r in first.items())


# 12
def brute_audit(data, labels):
    """Every order applied left to right, row by row."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    smallest = {}
    for i, t, *_ in data:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    docs = []
    for i, t, lang, *_ in data:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        docs.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, kept = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                failing = [d for d in mine if f in d[1]]
                out[part, "".join(order), step] = [len(kept), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                total[f] += len(gone)
                left = kept
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def audit_cases():
    lines = prose(9, 150).replace("the", "The")
    return [*rows(), (200, "Aa a A " * 80, "en", "a"), (201, "ONE # " * 20, None, "a"), (202, lines, "en", "a"), (203, lines, "fr", "a"), (1, lines, "en", "a"), (None, lines, "en", "a"), (204, "é　x\x85 y\x0bz\x0c" * 60, "en", "a"), (205, None, None, "a"), (206, "A" * 700, "", "a"), (207, "$", "en", "a")]


def test_filter_audit(spark):
    labels = [(1, 0, 1), (1, 1, 0), (3, 1, None), (7, None, 1), (202, 1, 1), (203, 1, 0), (None, 1, 1), (100, 0, 1), (9999, 1, 1)]
    docs, marks = documents(spark, audit_cases()).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as n")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filters.interactions(filters.mask_counts(docs, marks)).collect()}
    assert got == brute_audit(audit_cases(), labels)
    assert filters.interactions(filters.mask_counts(empty(spark), marks)).count() == 0
    assert filters.interactions(filters.mask_counts(docs, marks.limit(0))).agg(F.sum("good_lost")).first()[0] == 0


def test_filter_audit_sql(spark, tmp_path):
    documents(spark, audit_cases()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (203, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = con.execute(f"select {', '.join(columns)} from ({filters.ORACLE})").fetchall()
    got = __spark_entry__.queries()["op12_filter_audit"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 600 * 4


@pytest.mark.parametrize("stretch", [1, 7, 64, 10**6])
def test_stretches_of_a_long_text(stretch):
    text = (prose(3, 300) + "\tA# " + prose(3, 200) + " " + "w" * 500 + "\n\n").encode()
    data = np.frombuffer(text, np.uint8)
    assert (filters.measures_long(data, stretch) == filters.measures(data, np.array([0, len(data)]))).all()
    assert (filters.measures_long(np.zeros(0, np.uint8)) == 0).all()


def test_bytes_decide_where_word_hashes_meet(monkeypatch):
    data, bounds = np.frombuffer(b"a b a c c b", np.uint8), np.array([0, 5, 5, 11])
    want = filters.measures(data, bounds)[1].tolist()
    monkeypatch.setattr(filters, "span_hash", lambda data, start, end: np.zeros(len(start), np.uint64))
    assert filters.measures(data, bounds)[1].tolist() == want == [2, 0, 2]


# 13
def check_packing(pieces, wanted, limits, prompts=None, split=True):
    """Every id once and in its place, sequences gapless and within all limits; returns the padding."""
    by_document, by_sequence = {}, {}
    for p in pieces:
        by_document.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_document) == {k for k, ids in wanted.items() if ids}
    for key, own in by_document.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            ids = wanted[key][at : at + p["length"]]
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(wanted[key]) and p["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and p["ids"] in (None, ids)
            assert p["loss_tokens"] == max(0, at + p["length"] - max(at, (prompts or {}).get(key, 0)))
            at += p["length"]
        assert at == len(wanted[key])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limits.tokens and len(own) <= limits.segments and sum(p["loss_tokens"] for p in own) <= limits.loss
        padding += limits.tokens - at if at & (at - 1) or not split else 0
    return padding


@pytest.mark.parametrize("parts", [1, 3])
def test_packing_of_texts(spark, parts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    data = [(k, t, lang, s) for k, (_, t, lang, s) in enumerate([*rows(), (0, "a<|endoftext|>b İſK ﬁ é x́̂ \x00 　 ''s 'LL", "en", "a")])]
    wanted = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t, *_ in data}
    got = packing.pack_texts(documents(spark, data).repartition(parts), path).collect()
    assert check_packing(got, wanted, packing.Limits()) == 0
    assert packing.pack_texts(empty(spark), path).count() == 0
    again = packing.pack_texts(documents(spark, [(1, "same text", "en", "a")] * 3 + [(None, "x", "en", "a")]), path).collect()
    assert sorted((r["doc_id"] or 0, r["start"], r["doc_tokens"]) for r in again if r["start"] == 0) == [(0, 0, 2), (1, 0, 3), (1, 0, 3), (1, 0, 3)]


@pytest.mark.parametrize("limits", [packing.Limits(64, 3, 64), packing.Limits(64, 8, 20), packing.Limits(50, 4, 0), packing.Limits(1, 1, 1), packing.Limits(2048, 128, 1500)])
@pytest.mark.parametrize("split", [True, False])
def test_packing_of_instructions(spark, limits, split, monkeypatch):
    """Prompts bear no loss, answers do; all three limits hold at once."""
    r = np.random.default_rng(3)
    data = [(k, r.integers(0, 49_000, int(r.integers(0, 40 if k % 9 else 400))).tolist(), int(r.integers(0, 60))) for k in range(150)] + [(150, None, 3), (151, [], None)]
    if not limits.loss:
        data = [(k, ids, 10**6) for k, ids, _ in data]
    frame = spark.createDataFrame(data, "doc_id long, ids array<int>, prompt int").selectExpr("*", "1 as start", "2 as length").repartition(2)
    got = packing.pack(frame, limits, split=split).collect()
    padding = check_packing(got, {k: ids or [] for k, ids, _ in data}, limits, {k: p or 0 for k, _, p in data}, split)
    assert padding == 0 or not split


def test_packing_takes_what_fits_whole():
    """With room for two of three, the heuristic leaves no document cut."""
    packer = packing.Packer(packing.Limits(10, 10, 10), 0, True, True)
    for key, n in (("a", 6), ("b", 7), ("c", 3), ("d", 4)):
        packer.add(key, np.arange(n, dtype=np.int32))
    packer.finish()
    assert sorted((r[0], r[2]) for r in packer.rows) == [("a", 6), ("b", 7), ("c", 3), ("d", 4)] and len({r[7] for r in packer.rows}) == 2


def test_packing_refuses_limits_without_room(spark):
    with pytest.raises(ValueError, match="limits"):
        packing.pack(spark.createDataFrame([(1, [1])], "doc_id long, ids array<int>"), packing.Limits(0, 1, 1))
    packer = packing.Packer(packing.Limits(4, 4, 0), 0, True, True)
    packer.add("a", np.arange(3, dtype=np.int32))
    with pytest.raises(ValueError, match="limits"):
        packer.finish()


def test_packing_query(spark, small):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    wanted = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs}
    got = [r.asDict() | {"ids": None} for r in __spark_entry__.queries()["op13_vector_packing"](spark, small).collect()]
    assert check_packing(got, wanted, packing.Limits()) == 0
    assert len({r["sequence_id"] for r in got}) <= sum(map(len, wanted.values())) / 2048 + 12
