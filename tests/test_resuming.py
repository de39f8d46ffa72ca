"""The arc table broken off and run again; texts from a scripted server."""

import pytest
from pyspark.sql import functions as F

from prosemetrics.operators import arcs
from prosemetrics.sources import fetch
from prosemetrics.streaming.arc_table import ArcTable

SCHEMA = "book string, place int, embedding array<float>"


def chunks(spark, names, seed=0, n=14):
    rows = [(b, k, [float((hash((len(b), ord(b[0]), k, d, seed)) % 1000) / 500 - 1) for d in range(6)]) for b in names for k in range(n + ord(b[0]) % 5)]
    return spark.createDataFrame(rows, SCHEMA)


def as_dict(rows):
    return {r["book"]: (r["n_chunks"], [round(v, 9) for v in r["arc"]]) for r in rows.collect()}


def add(spark, where, rows):
    rows.coalesce(1).write.mode("append").parquet(where)


def test_a_broken_run_goes_on_to_the_same_table(spark, tmp_path, monkeypatch):
    one, two = str(tmp_path / "in"), str(tmp_path / "t")
    for names in ("ab", "cd", "e"):
        add(spark, one, chunks(spark, names))
    table = ArcTable(spark, one, two, SCHEMA, "book", "place", files_at_once=1)
    keep, calls = ArcTable._keep, []

    def breaks(self, batch, number):
        keep(self, batch, number)
        calls.append(number)
        if number == 1 and calls.count(1) == 1:
            raise RuntimeError("lost")

    monkeypatch.setattr(ArcTable, "_keep", breaks)
    with pytest.raises(Exception, match="lost"):
        table.run()
    with pytest.raises(ValueError, match="no finished run"):
        table.table()
    writes = arcs.arcs
    monkeypatch.setattr(arcs, "arcs", lambda *a, **k: writes(*a, **k).withColumn("arc", F.expr("transform(arc, x -> if(x > -9, cast(raise_error('lost') as double), x))")))
    with pytest.raises(Exception, match="lost"):
        table.run()
    assert table._runs() == []
    monkeypatch.setattr(arcs, "arcs", writes)
    table.run()
    assert calls == [0, 1, 1, 2]
    whole = as_dict(arcs.arcs(spark.read.parquet(one), "book", "place"))
    assert as_dict(table.table()) == whole and len(whole) == 5
    table.run()
    assert table._runs() == [2]
    at_once = ArcTable(spark, one, str(tmp_path / "u"), SCHEMA, "book", "place")
    at_once.run()
    assert as_dict(at_once.table()) == whole


@pytest.mark.parametrize("recentre", [True, False])
def test_books_that_come_later_or_again(spark, tmp_path, recentre):
    where = str(tmp_path / "in")
    add(spark, where, chunks(spark, "ab"))
    table = ArcTable(spark, where, str(tmp_path / "t"), SCHEMA, "book", "place", recentre)
    table.run()
    first = as_dict(table.table())
    add(spark, where, chunks(spark, "bc", seed=1, n=20).unionByName(chunks(spark, "d").limit(1)))
    table.run()
    now = chunks(spark, "a").unionByName(chunks(spark, "bc", seed=1, n=20)).unionByName(chunks(spark, "d").limit(1))
    whole, got = as_dict(arcs.arcs(now, "book", "place")), as_dict(table.table())
    assert set(got) == {"a", "b", "c"} and {b: got[b] for b in "bc"} == {b: whole[b] for b in "bc"}
    assert got["a"] == (whole if recentre else first)["a"] and whole["a"] != first["a"]


def script(log):
    """A server of four books: found at once, at the third address, after waiting, never."""
    pages = {"a/1": [(200, "café".encode(), None)], "c/2": [(200, "élan".encode("latin-1"), None)], "a/3": [(429, b"", None), OSError("reset"), (200, b"late", "utf-8")], "a/4": [(500, b"", None)], "b/4": [(200, b" \n", None)], "c/4": [(503, b"", None)] * 9, "a/5": [(200, "ñ".encode("cp1252"), "no-such-charset")]}
    left = {k: list(v) for k, v in pages.items()}

    def opener(url):
        log.append(url)
        answers = left.get(url, [])
        answer = answers.pop(0) if answers else (404, b"", None)
        if isinstance(answer, OSError):
            raise answer
        return fetch.Reply(*answer)

    return opener


def test_failover_and_waiting():
    log, waits = [], []
    policy, opener = fetch.Policy(("a/{id}", "b/{id}", "c/{id}"), 3, 1.0, 0.0), script(log)
    assert [policy.get(k, opener, waits.append) for k in "12"] == [("a/1", "café", 1, None), ("c/2", "élan", 3, None)] and waits == []
    assert policy.get("3", opener, waits.append) == ("a/3", "late", 3, None) and waits == [5.0, 2.0]
    waits.clear()
    assert policy.get("4", opener, waits.append) == (None, None, 5, "status 503") and waits == [5.0, 25.0, 125.0]
    assert policy.get("5", opener, waits.append)[1] == "ñ" and fetch.Policy(()).get("1", opener) == (None, None, 0, "no address")
    assert log.count("a/4") == 1 and log[-1] == "a/5"


def test_downloads(spark, tmp_path):
    """Texts and failures are told apart; a second run asks for what is missing alone."""

    def opener(url):
        from prosemetrics.sources.fetch import Reply

        if url.endswith("9"):
            raise OSError("down")
        return Reply(200, b"short" if url.endswith("8") else b"Produced by X\n\n" + url.encode() * 300) if url.startswith("two/") else Reply(404)

    quiet, policy = (lambda seconds: None), fetch.Policy(("one/{id}", "two/{id}"), 2, 0.0, 0.0)
    ids = spark.createDataFrame([("7",), ("8",), ("9",), ("7",), (None,)], "id string")
    where = {k: str(tmp_path / k) for k in ("target", "failed", "raw")}
    fetch.download(ids, policy, where["target"], where["failed"], opener, raw=where["raw"], sleep=quiet)
    got = spark.read.parquet(where["target"]).collect()
    assert [(r["id"], r["text"]) for r in got] == [("7", "two/7" * 300 + "\n")]
    assert {r["id"]: (r["attempts"], r["error"]) for r in spark.read.parquet(where["failed"]).collect()} == {"8": (2, "only 6 characters"), "9": (4, "OSError: down")}
    assert spark.read.parquet(where["raw"]).count() == 2
    fetch.download(ids, policy, where["target"], where["failed"], opener, sleep=quiet)
    assert spark.read.parquet(where["target"]).count() == 1 and spark.read.parquet(where["failed"]).count() == 2
    fetch.register(spark, opener, quiet)
    rows = spark.read.format("texts_by_id").options(ids="7, 9,,7", templates="one/{id} two/{id}", tries=1, delay=0, jitter=0, workers=3).load().orderBy("id").collect()
    assert [(r["id"], r["url"], r["error"]) for r in rows] == [("7", "two/7", None), ("9", None, "OSError: down")]
