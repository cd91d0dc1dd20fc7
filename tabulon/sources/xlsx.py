"""Workbooks as tables of cells: a reader over binary files and a writer of plain workbooks, with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bounds of a package: bytes of a part unpacked, parts, cells of a workbook.
PART, PARTS, CELLS = 256 << 20, 10_000, 20_000_000
CELLS_DDL = "path string, sheet string, row int, col int, kind string, num double, txt string, formula string"
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _part(z: zipfile.ZipFile, name: str) -> bytes:
    if z.getinfo(name).file_size > PART:
        raise ValueError(f"{name} is larger than {PART} bytes")
    return z.read(name)


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_M}t"))


def cells(data: bytes) -> Iterator[tuple]:
    """(sheet, row, col, kind, num, txt, formula) of every cell with a value or formula, sheets in tab order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if len(z.namelist()) > PARTS:
            raise ValueError(f"more than {PARTS} parts")
        book = ET.fromstring(_part(z, "xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(_part(z, "xl/_rels/workbook.xml.rels"))}
        shared = [_text(s) for s in ET.fromstring(_part(z, "xl/sharedStrings.xml")).findall(f"{_M}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        count = 0
        for sheet in book.iter(f"{_M}sheet"):
            target = targets[sheet.get(f"{_R}id")]
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for c in ET.fromstring(_part(z, name)).iter(f"{_M}c"):
                at = re.match(r"([A-Z]+)(\d+)$", c.get("r", ""))
                if not at:
                    continue
                count += 1
                if count > CELLS:
                    raise ValueError(f"more than {CELLS} cells")
                kind, v, f = c.get("t", "n"), c.find(f"{_M}v"), c.find(f"{_M}f")
                value = v.text if v is not None else None
                num = txt = None
                if kind == "s" and value is not None:
                    kind, txt = "text", shared[int(value)]
                elif kind == "inlineStr":
                    kind, txt = "text", _text(c)
                elif kind == "str":
                    kind, txt = "text", value or ""
                elif kind == "b":
                    kind, num = "logical", float(value or 0)
                elif kind == "e":
                    kind, txt = "error", value
                elif value is not None:
                    kind, num = "number", float(value)
                else:
                    kind = "blank"
                if kind != "blank" or f is not None:
                    yield sheet.get("name"), int(at[2]), column_number(at[1]), kind, num, txt, None if f is None or not f.text else "=" + f.text


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks at a path, read by Spark, a task for each file."""
    names = [c.split()[0] for c in CELLS_DDL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string()]
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(p, *c) for c in cells(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CELLS_DDL)


def sheet_table(cells: DataFrame, sheet: str, columns: dict[int, tuple[str, str]], header: int = 1) -> DataFrame:
    """Rows below a header: columns maps column numbers to (name, type: double, string or boolean)."""
    from pyspark.sql import functions as F

    own = cells.where((F.col("sheet") == sheet) & (F.col("row") > header))
    value = {"double": F.col("num"), "string": F.coalesce("txt", F.col("num").cast("string")), "boolean": F.col("num") != 0}
    return own.groupBy("path", "row").agg(*[F.max(F.when(F.col("col") == c, value[kind])).alias(name) for c, (name, kind) in columns.items()])


def workbook_bytes(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """A workbook of sheets with a header and rows of numbers, texts, logicals and formulas (`=...`)."""
    main, rel = _M[1:-1], _R[1:-1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (header, rows) in enumerate(sheets.values(), 1):
            body = []
            for r, row in enumerate([tuple(header), *rows], 1):
                body.append(f'<row r="{r}">' + "".join(_cell(f"{column_letters(c)}{r}", v) for c, v in enumerate(row, 1) if v is not None) + "</row>")
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>')
    return out.getvalue()


def _cell(at: str, v) -> str:
    if isinstance(v, bool):
        return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{at}"><v>{v!r}</v></c>'
    if isinstance(v, str) and v.startswith("="):
        return f'<c r="{at}"><f>{escape(v[1:])}</f></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
