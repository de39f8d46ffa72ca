"""The workbook, opened with the standard zip and XML modules."""

import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from prosemetrics.sources import workbook

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def opened(path):
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        xml = {n: ElementTree.fromstring(z.read(n)) for n in z.namelist()}
    names = [s.get("name") for s in xml["xl/workbook.xml"].iterfind(".//m:sheet", NS)]
    return names, [xml[f"xl/worksheets/sheet{k}.xml"] for k in range(1, len(names) + 1)], xml


def values(sheet):
    out = []
    for row in sheet.iterfind(".//m:row", NS):
        cells = {}
        for c in row.iterfind("m:c", NS):
            text, number = c.find(".//m:t", NS), c.find("m:v", NS)
            cells[c.get("r").rstrip("0123456789")] = (text.text or "") if text is not None else (float(number.text), c.get("s"))
        out.append(cells)
    return out


def test_workbook(spark, tmp_path):
    first = spark.createDataFrame([("a <b> & \"c\"\n", 1, 0.12345, True), (None, None, float("nan"), None), ("", -3, float("inf"), False), ("é\x01", 2**40, -0.0, None)], "name string, n long, x double, flag boolean")
    second = spark.range(0, 5000, 1, 7).select(F.col("id"), (F.col("id") * 1.5).alias("half more"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.lit("x" * 90).alias("long"), F.col("id").cast("decimal(9,2)").alias("price"))
    path = str(tmp_path / "book.xlsx")
    workbook.workbook({"01_first": first, "B & C": second, "empty": first.limit(0)}, path)
    names, sheets, xml = opened(path)
    assert names == ["01_first", "B & C", "empty"] and set(xml) >= {"[Content_Types].xml", "_rels/.rels", "xl/styles.xml", "xl/_rels/workbook.xml.rels"}
    assert values(sheets[0]) == [{"A": "name", "B": "n", "C": "x", "D": "flag"}, {"A": "a <b> & \"c\"\n", "B": (1, "3"), "C": (0.12345, "2"), "D": "true"}, {}, {"A": "", "B": (-3, "3"), "D": "false"}, {"A": "é", "B": (2**40, "3"), "C": (0.0, "2")}]
    rows = values(sheets[1])
    assert len(rows) == 5001 and [r["A"][0] for r in rows[1:]] == list(range(5000)) and rows[2] == {"A": (1, "3"), "B": (1.5, "2"), "C": "2024-01-02", "D": "x" * 90, "E": (1, "2")}
    assert [c.get("width") for c in sheets[1].iterfind(".//m:col", NS)] == ["10", "11", "12", "60", "10"]
    assert all(s.find(".//m:pane", NS).get("topLeftCell") == "A2" for s in sheets) and values(sheets[2]) == values(sheets[0])[:1]
    assert [p.name for p in tmp_path.iterdir()] == ["book.xlsx"]
    workbook.workbook({"again": first}, path)
    assert opened(path)[0] == ["again"]


def test_workbook_refuses(spark, tmp_path, monkeypatch):
    one = spark.range(3)
    for sheets in ({}, {"a/b": one}, {"x" * 32: one}, {"a": one, "A": one}):
        with pytest.raises(ValueError, match="names"):
            workbook.workbook(sheets, str(tmp_path / "no.xlsx"))
    with pytest.raises(Exception, match="more than 32767 characters"):
        workbook.workbook({"a": spark.range(1).select(F.lit("x" * 40_000).alias("x"))}, str(tmp_path / "no.xlsx"))
    assert list(tmp_path.iterdir()) == [] and [workbook.column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
