"""A data source that writes tables as the sheets of one XLSX file, in the format's own XML.

Tasks write the rows of their partition, in order, beside the file; the commit merges them, row by row, into sheets.
The file's folder is to be one that the driver and all executors have mounted at the same place.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .shipping import ship

#: The format's own bounds.
MOST_ROWS, MOST_COLUMNS, MOST_CHARACTERS, MOST_NAME = 1_048_576, 16_384, 32_767, 31
#: Columns are as wide as their longest value and two more, between these.
WIDTHS = (10, 60)

# The look of a sheet. Styles: 0 text, 1 header, 2 number with three places, 3 whole number.
STYLES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="1"><numFmt numFmtId="164" formatCode="0.000"/></numFmts>
<fonts count="2"><font><sz val="10"/><name val="Arial"/></font><font><b/><sz val="10"/><color rgb="FFFFFFFF"/><name val="Arial"/></font></fonts>
<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF1F4E79"/></patternFill></fill></fills>
<borders count="2"><border/><border><left/><right/><top/><bottom style="thin"><color rgb="FFD9D9D9"/></bottom></border></borders>
<cellStyleXfs count="1"><xf/></cellStyleXfs>
<cellXfs count="4"><xf fontId="0" borderId="1" applyBorder="1"/><xf fontId="1" fillId="2" applyFont="1" applyFill="1" applyAlignment="1"><alignment horizontal="center" vertical="center" wrapText="1"/></xf>
<xf fontId="0" borderId="1" numFmtId="164" applyNumberFormat="1" applyBorder="1"/><xf fontId="0" borderId="1" numFmtId="1" applyNumberFormat="1" applyBorder="1"/></cellXfs></styleSheet>"""
MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
KINDS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


@dataclass
class _Written(WriterCommitMessage):
    path: str
    widths: dict[int, list[int]]  # by sheet, the longest value of each column


def column_name(k: int) -> str:
    """A, B, ... Z, AA, ... of the column at place k."""
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def _cell(place: str, value, header: bool) -> str:
    if value is None:
        return ""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value).lower() if isinstance(value, bool) else str(value))
        return f'<c r="{place}" t="inlineStr" s="{int(header)}"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
    return f'<c r="{place}" s="{2 if isinstance(value, float) else 3}"><v>{value!r}</v></c>'


class WorkbookWriter(DataSourceWriter):
    """Rows position, sheet, row, cells, sorted by position and row in each partition: cells as a JSON list, the header first."""

    def __init__(self, path: str):
        self.path = re.sub(r"^file:(//)?(?=/)", "", path)
        if re.match(r"^[a-z0-9]+:", self.path):
            raise ValueError("a workbook's path must be a mounted folder's")
        self.staging = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        os.makedirs(self.staging, exist_ok=True)
        part, widths = f"{self.staging}/{uuid.uuid4().hex}", {}
        with open(part, "w", encoding="utf-8") as out:
            for r in iterator:
                own = widths.setdefault(r["position"], [])
                values = json.loads(r["cells"])
                own.extend([0] * (len(values) - len(own)))
                for k, v in enumerate(values):
                    size = 0 if v is None else len(str(v))
                    if size > MOST_CHARACTERS:
                        raise ValueError(f"a cell of sheet {r['sheet']} has more than {MOST_CHARACTERS} characters")
                    own[k] = max(own[k], size)
                out.write(json.dumps([r["position"], r["row"], r["sheet"], r["cells"]]) + "\n")
        return _Written(part, widths)

    def commit(self, messages: list) -> None:
        messages = [m for m in messages if m is not None]
        widths: dict[int, list[int]] = {}
        for m in messages:
            for sheet, own in m.widths.items():
                old = widths.setdefault(sheet, [])
                old.extend([0] * (len(own) - len(old)))
                widths[sheet] = [max(a, b) for a, b in zip(old, own + [0] * (len(old) - len(own)), strict=True)]
        if any(len(w) > MOST_COLUMNS for w in widths.values()):
            raise ValueError(f"a sheet has more than {MOST_COLUMNS} columns")
        files = [open(m.path, encoding="utf-8") for m in messages]
        try:
            rows, names, unfinished = heapq.merge(*[map(json.loads, f) for f in files], key=lambda r: r[:2]), [], f"{self.staging}/whole.xlsx"
            with zipfile.ZipFile(unfinished, "w", zipfile.ZIP_DEFLATED) as out:
                row = next(rows, None)
                while row is not None:
                    position, name = row[0], row[2]
                    names.append(name)
                    with out.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as sheet:
                        sheet.write(self._opening(widths[position]).encode())
                        n = 0
                        while row is not None and row[0] == position:
                            n += 1
                            if n > MOST_ROWS:
                                raise ValueError(f"sheet {name} has more than {MOST_ROWS} rows")
                            cells = "".join(_cell(f"{column_name(k)}{n}", v, n == 1) for k, v in enumerate(json.loads(row[3])))
                            sheet.write(f'<row r="{n}"{" ht=\"30\" customHeight=\"1\"" if n == 1 else ""}>{cells}</row>'.encode())
                            row = next(rows, None)
                        sheet.write(b"</sheetData></worksheet>")
                self._frame(out, names)
            os.replace(unfinished, self.path)
        finally:
            for f in files:
                f.close()
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)

    @staticmethod
    def _opening(widths: list[int]) -> str:
        columns = "".join(f'<col min="{k}" max="{k}" width="{min(max(w + 2, WIDTHS[0]), WIDTHS[1])}" customWidth="1"/>' for k, w in enumerate(widths, 1))
        return f'{HEAD}<worksheet {MAIN}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{columns}</cols><sheetData>'

    @staticmethod
    def _frame(out: zipfile.ZipFile, names: list[str]) -> None:
        numbers = range(1, len(names) + 1)
        base, types = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
        sheets = "".join(f'<sheet name="{escape(x, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, x in zip(numbers, names, strict=True))
        links = "".join(f'<Relationship Id="rId{k}" Type="{KINDS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{types}.worksheet+xml"/>' for k in numbers)
        out.writestr("xl/styles.xml", STYLES)
        out.writestr("xl/workbook.xml", f"{HEAD}<workbook {MAIN}><sheets>{sheets}</sheets></workbook>")
        out.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{base}/relationships">{links}<Relationship Id="rId{len(names) + 1}" Type="{KINDS}/styles" Target="styles.xml"/></Relationships>')
        out.writestr("_rels/.rels", f'{HEAD}<Relationships xmlns="{base}/relationships"><Relationship Id="rId1" Type="{KINDS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        out.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="{base}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{types}.styles+xml"/>{parts}</Types>')


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "position int, sheet string, row long, cells string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.options["path"])


def workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """One XLSX file at ``path`` with a sheet for each table, in the order given, its rows in the table's own order.

    Numbers stay numbers, with three places if they are no whole ones; dates and lists are text; nulls, NaN and infinity
    are empty cells. The header is fixed and coloured, columns are as wide as their values. Raises ValueError for no sheet,
    for names that the format refuses, and beyond its bounds on rows, columns and characters.
    """
    bad = [n for n in sheets if not n or len(n) > MOST_NAME or re.search(r"[\[\]:*?/\\]", n)]
    if not sheets or bad or len({n.lower() for n in sheets}) < len(sheets):
        raise ValueError(f"sheets need names of their own of up to {MOST_NAME} characters: {bad or list(sheets)}")
    spark, out = next(iter(sheets.values())).sparkSession, None
    ship(spark)
    spark.dataSource.register(Workbook)
    for k, (name, rows) in enumerate(sheets.items()):
        plain = ("tinyint", "smallint", "int", "bigint", "boolean", "string")
        value = lambda c, t: F.col(f"`{c}`") if t in plain else F.when(F.abs(F.col(f"`{c}`")) < float("inf"), F.col(f"`{c}`").cast("double")) if t in ("float", "double") or t.startswith("decimal") else F.col(f"`{c}`").cast("string")
        # each value as JSON of its own type, null where it is none; NaN is greater than infinity here
        cells = [F.coalesce(F.regexp_extract(F.to_json(F.struct(value(c, t).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("")) for c, t in rows.dtypes]
        body = rows.select(F.monotonically_increasing_id().alias("row"), F.concat(F.lit("["), F.concat_ws(",", *[F.when(x == "", "null").otherwise(x) for x in cells]), F.lit("]")).alias("cells"))
        header = spark.createDataFrame([(-1, json.dumps(rows.columns))], "row long, cells string")
        one = header.unionByName(body).select(F.lit(k).alias("position"), F.lit(name).alias("sheet"), "row", "cells")
        out = one if out is None else out.unionByName(one)
    out.repartitionByRange("position", "row").sortWithinPartitions("position", "row").write.format("workbook").mode("append").save(path)
