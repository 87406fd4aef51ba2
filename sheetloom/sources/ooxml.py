"""Workbook files (.xlsx, .xlsm) as tables: one task reads one file with the standard library; errors are rows, never exceptions.

``read_workbooks`` gives all tables of a folder by name; ``register`` makes ``spark.read.format("workbook").option("table", "cells").load(path)`` work.
Limits: max_bytes of a file, max_unpacked bytes of its parts, max_cells of a sheet.  Beyond them a file or sheet has an error row.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
import zlib
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema

MAX_BYTES, MAX_UNPACKED, MAX_CELLS = 50 << 20, 1 << 30, 2_000_000
TABLES = {
    "workbooks": schema.WORKBOOKS, "sheets": schema.SHEETS, "cells": schema.CELLS, "merges": schema.MERGES, "tables": schema.TABLES,
    "table_columns": "wb string, sheet string, table_name string, column_index int, name string, totals_function string", "names": schema.NAMES,
    "cf_rules": schema.CF_RULES, "dv_rules": schema.DV_RULES, "charts": schema.CHARTS, "errors": "wb string, path string, sheet string, severity string, stage string, message string",
    "comments": "wb string, sheet string, row int, col int, text string", "links": "wb string, sheet string, row int, col int, target string", "pivots": "wb string, part string",
    "external_links": "wb string, name string, ref string, link_index int",
}
#: What reading damaged or odd (say, encrypted) files may raise.
DAMAGE = (zipfile.BadZipFile, zlib.error, LookupError, ValueError, TypeError, AttributeError, ArithmeticError, RuntimeError, EOFError, MemoryError, ElementTree.ParseError)
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_KINDS = {"barChart": "bar", "bar3DChart": "bar", "lineChart": "line", "line3DChart": "line", "pieChart": "pie", "pie3DChart": "pie", "doughnutChart": "doughnut", "areaChart": "area", "area3DChart": "area", "scatterChart": "scatter", "bubbleChart": "bubble", "radarChart": "radar", "stockChart": "stock", "surfaceChart": "surface"}
_FORMATS = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 49: "@"}


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def _all(e, name: str):
    return [x for x in e.iter() if _local(x) == name]


def _one(e, name: str):
    return next((x for x in e.iter() if _local(x) == name), None) if e is not None else None


def place(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Z]{1,3})\$?([0-9]{1,7})", ref.upper())
    if not m:
        raise ValueError(f"no cell: {ref}")
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]), col


def name_of(row: int, col: int) -> str:
    out = ""
    while col:
        col, digit = divmod(col - 1, 26)
        out = chr(65 + digit) + out
    return f"{out}{row}"


#: Pieces of a formula: strings, quoted sheet names, names of functions or sheets, references.
_PIECE = re.compile(r"""("(?:[^"]|"")*"|'(?:[^']|'')*'!?|\[[^\]]*\]|[A-Za-z_\\][\w.\\]*(?=[(!\[])|[A-Za-z_\\][\w.\\]*(?:\.[\w.]*)+)|(?<![\w.$])(\$?)([A-Za-z]{1,3})(\$?)([1-9][0-9]{0,6})(?![\w.(!])|(?<![\w.$])(\$?)([A-Za-z]{1,3}):(\$?)([A-Za-z]{1,3})(?![\w.(!])|(?<![\w.$])(\$?)([1-9][0-9]{0,6}):(\$?)([1-9][0-9]{0,6})(?![\w.(!])""")


def shifted(formula: str, rows: int, cols: int) -> str:
    """A shared formula as it reads so many rows and columns further: relative parts of references move, parts with $ stay; beyond the sheet is #REF!."""

    def column(fixed: str, name: str) -> str | None:
        if fixed:
            return "$" + name
        col = place(name + "1")[1] + cols
        return name_of(1, col)[:-1] if 1 <= col <= 16384 else None

    def row(fixed: str, number: str) -> str | None:
        if fixed:
            return "$" + number
        return str(int(number) + rows) if 1 <= int(number) + rows <= 1048576 else None

    def move(m: re.Match) -> str:
        if m[1] is not None:
            return m[1]
        if m[3] is not None:
            if place(m[3] + "1")[1] > 16384:
                return m[0]
            parts = [column(m[2], m[3]), row(m[4], m[5])]
            return "#REF!" if None in parts else "".join(parts)
        parts = [column(m[6], m[7]), column(m[8], m[9])] if m[7] is not None else [row(m[10], m[11]), row(m[12], m[13])]
        return "#REF!" if None in parts else ":".join(parts)

    return _PIECE.sub(move, formula)


def is_date(number_format: str) -> bool:
    """Whether a number format shows dates or times: codes for them outside quotes, escapes and brackets."""
    plain = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", number_format.lower()).partition(";")[0]
    return plain != "general" and re.search("[ymdhs]", plain) is not None


def iso_date(serial: float, number_format: str, date_system: str) -> str | None:
    """The date, date and time, or time (below one day) that a serial number stands for; null where it stands for none."""
    if not 0 <= serial < 2958466:
        return None
    if serial < 1 and not re.search("[yd]", number_format.lower()):
        return (datetime(2000, 1, 1) + timedelta(seconds=round(serial * 86400))).time().isoformat()
    begin = datetime(1904, 1, 1) if date_system == "1904" else datetime(1899, 12, 31) if serial < 60 else datetime(1899, 12, 30)
    when = begin + timedelta(days=int(serial), seconds=round(serial % 1 * 86400))
    return when.date().isoformat() if serial == int(serial) else when.isoformat()


def span(ref: str) -> tuple[int, int, int, int]:
    a, _, b = ref.partition(":")
    return (*place(a), *place(b or a))


class _Book:
    """One file's parts and what the sheets share."""

    def __init__(self, data: bytes, max_unpacked: int):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        if sum(i.file_size for i in self.zip.infolist()) > max_unpacked:
            raise ValueError("unpacked parts are too large")
        self.parts = set(self.zip.namelist())
        self.date_system = "1900"
        self.strings = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in _all(self.xml("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in self.parts else []
        self._styles()

    def xml(self, part: str):
        return ElementTree.fromstring(self.zip.read(part))

    def rels(self, part: str) -> dict[str, tuple[str, str]]:
        folder, name = posixpath.split(part)
        path = f"{folder}/_rels/{name}.rels"
        if path not in self.parts:
            return {}
        out = {}
        for r in self.xml(path):
            target = r.get("Target", "")
            full = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id")] = (r.get("Type", "").rpartition("/")[2], target if r.get("TargetMode") == "External" else full)
        return out

    def _styles(self) -> None:
        self.styles = []
        if "xl/styles.xml" not in self.parts:
            return
        root = self.xml("xl/styles.xml")
        formats = dict(_FORMATS) | {int(n.get("numFmtId")): n.get("formatCode") for n in _all(root, "numFmt")}
        fonts = [(_one(f, "b") is not None and _one(f, "b").get("val", "1") not in ("0", "false"), float(_one(f, "sz").get("val")) if _one(f, "sz") is not None else None) for f in (_one(root, "fonts") if _one(root, "fonts") is not None else [])]
        fills = [self._colour(_one(f, "fgColor")) if _one(f, "patternFill") is not None and _one(f, "patternFill").get("patternType") == "solid" else None for f in (_one(root, "fills") if _one(root, "fills") is not None else [])]
        at = lambda list_, k, default: list_[k] if 0 <= k < len(list_) else default
        for xf in _one(root, "cellXfs") if _one(root, "cellXfs") is not None else []:
            bold, size = at(fonts, int(xf.get("fontId", 0)), (False, None))
            self.styles.append((bold, at(fills, int(xf.get("fillId", 0)), None), size, formats.get(int(xf.get("numFmtId", 0)), "General")))

    @staticmethod
    def _colour(e) -> str | None:
        if e is None:
            return None
        if e.get("rgb"):
            return e.get("rgb")[-6:]
        return f"theme:{e.get('theme')}" if e.get("theme") else f"indexed:{e.get('indexed')}" if e.get("indexed") else None


def _value(c, book: _Book) -> tuple[str, str | None, float | None]:
    kind, v = c.get("t", "n"), next((x.text for x in c if _local(x) == "v"), None)
    if kind == "inlineStr":
        return "s", "".join(t.text or "" for t in c.iter() if _local(t) == "t"), None
    if v is None:
        return "n", None, None
    if kind == "s":
        return "s", book.strings[int(v)], None
    if kind in ("str", "d"):
        return "s", v, None
    if kind == "b":
        return "b", "True" if v == "1" else "False", None
    if kind == "e":
        return "e", v, None
    number = float(v)
    style = int(c.get("s", 0))
    shape = book.styles[style][3] if 0 <= style < len(book.styles) else "General"
    if is_date(shape) and (shown := iso_date(number, shape, book.date_system)) is not None:
        return "d", shown, number
    whole = number.is_integer() and not re.search("[.eE]", v)
    return ("i", str(int(v)), number) if whole else ("f", repr(number), number)


def _sheet(book: _Book, part: str, wb: str, name: str, index: int, hidden: bool, out: dict[str, list], path: str, max_cells: int) -> None:
    root, key = book.xml(part), (wb, name)
    fmt, view, protect = _one(root, "sheetFormatPr"), _one(root, "pane"), _one(root, "sheetProtection")
    heights, hidden_rows, widths, hidden_cols, n = {}, [], {}, [], 0
    shared: dict[str, tuple[str, int, int]] = {}
    r = 0
    for row in _all(root, "row"):
        r, col = int(row.get("r") or r + 1), 0  # without a number, the place after the last one
        if row.get("ht"):
            heights[r] = float(row.get("ht"))
        if row.get("hidden") in ("1", "true"):
            hidden_rows.append(r)
        for c in row:
            if _local(c) != "c":
                continue
            rr, col = place(c.get("r")) if c.get("r") else (r, col + 1)
            kind, raw, num = _value(c, book)
            f = next((x for x in c if _local(x) == "f"), None)
            formula = None
            if f is not None:
                formula = f.text
                if f.get("t") == "shared" or f.get("si"):
                    if f.text:
                        shared[f.get("si")] = f.text, rr, col
                    elif f.get("si") in shared:
                        text, r0, c0 = shared[f.get("si")]
                        formula = shifted(text, rr - r0, col - c0)
            style = int(c.get("s", 0))
            bold, fill, size, number_format = book.styles[style] if style < len(book.styles) else (False, None, None, "General")
            if raw is None and formula is None and not (bold or fill):
                continue
            n += 1
            if n > max_cells:
                out["errors"].append((wb, path, name, "error", "cells", f"more than {max_cells} cells"))
                break
            out["cells"].append((*key, rr, col, kind, raw, num, formula, bold, fill, size, number_format))
        else:
            continue
        break
    for col in _all(root, "col"):
        first = int(col.get("min", 1))
        last = int(col.get("max", first))
        for k in range(first, min(last, 16384) + 1):
            if col.get("width") and last < 16384:
                widths[k] = float(col.get("width")) * 7.5
            if col.get("hidden") in ("1", "true"):
                hidden_cols.append(k)
    filtered = _one(root, "autoFilter")
    out["sheets"].append((*key, index, hidden, view.get("topLeftCell") if view is not None else None, filtered.get("ref") if filtered is not None else None, protect is not None, float(fmt.get("defaultRowHeight", 15)) if fmt is not None else 15.0, float(fmt.get("defaultColWidth", 8.43)) * 7.5 if fmt is not None else 8.43 * 7.5, heights, widths, hidden_rows, hidden_cols, None))
    out["merges"] += [(*key, *span(m.get("ref"))) for m in _all(root, "mergeCell")]
    for block in _all(root, "conditionalFormatting"):
        for rule in (x for x in block if _local(x) == "cfRule"):
            f = _one(rule, "formula")
            out["cf_rules"].append((*key, block.get("sqref", "").split(), rule.get("type"), rule.get("operator"), f.text if f is not None else None, int(rule.get("priority", 0)), rule.get("stopIfTrue") == "1"))
    for v in _all(root, "dataValidation"):
        text = lambda e: e.text if e is not None else None
        out["dv_rules"].append((*key, v.get("sqref", "").split(), v.get("type"), v.get("operator"), text(_one(v, "formula1")), text(_one(v, "formula2")), v.get("allowBlank") in ("1", "true")))
    rels = book.rels(part)
    for h in _all(root, "hyperlink"):
        target = rels.get(h.get(_REL + "id"), ("", h.get("location")))[1]
        out["links"].append((*key, *place(h.get("ref").partition(":")[0]), target))
    for what, target in rels.values():
        if target not in book.parts:
            continue
        if what == "table":
            t = book.xml(target)
            table = t.get("displayName") or t.get("name")
            out["tables"].append((*key, table, *span(t.get("ref"))))
            out["table_columns"] += [(*key, table, k, c.get("name"), c.get("totalsRowFunction")) for k, c in enumerate(_all(t, "tableColumn"))]
        elif what == "comments":
            out["comments"] += [(*key, *place(c.get("ref")), "".join(t.text or "" for t in c.iter() if _local(t) == "t")) for c in _all(book.xml(target), "comment")]
        elif what == "drawing":
            _charts(book, target, key, out)
        elif what == "pivotTable":
            out["pivots"].append((wb, target))


def _charts(book: _Book, part: str, key: tuple, out: dict[str, list]) -> None:
    rels = book.rels(part)
    for anchor in (x for x in book.xml(part) if _local(x).endswith("Anchor")):
        link = _one(anchor, "chart")
        target = rels.get(link.get(_REL + "id"), ("", ""))[1] if link is not None else ""
        if target not in book.parts:
            continue
        c = book.xml(target)
        plot = _one(c, "plotArea")
        kind = next((_KINDS[_local(x)] for x in (plot if plot is not None else []) if _local(x) in _KINDS), "unknown")
        words = lambda e: "".join(t.text or "" for t in e.iter() if _local(t) in ("t", "v")) or None if e is not None else None
        chart = _one(c, "chart")
        title = next((words(x) for x in chart if _local(x) == "title"), None) if chart is not None else None
        axes = [next((words(y) for y in x if _local(y) == "title"), None) for x in (plot if plot is not None else []) if _local(x) in ("catAx", "valAx", "dateAx")]
        ref = lambda e, name: _one(_one(e, name), "f").text if _one(e, name) is not None and _one(_one(e, name), "f") is not None else None
        series = [{"name": words(_one(s, "tx")) if _one(s, "tx") is not None else None, "values_ref": ref(s, "val") or ref(s, "yVal"), "categories_ref": ref(s, "cat") or ref(s, "xVal")} for s in _all(c, "ser")]
        spot = lambda name: tuple(int(_one(_one(anchor, name), x).text) for x in ("row", "col")) if _one(anchor, name) is not None else (None, None)
        out["charts"].append((*key, sum(1 for x in out["charts"] if x[0] == key[0]), kind, title, axes[0] if axes else None, axes[1] if len(axes) > 1 else None, *spot("from"), *spot("to"), series))


def parse(data: bytes, path: str = "", max_bytes: int = MAX_BYTES, max_unpacked: int = MAX_UNPACKED, max_cells: int = MAX_CELLS) -> dict[str, list[tuple]]:
    """Rows of all tables of one file."""
    out: dict[str, list] = {t: [] for t in TABLES}
    wb, name = hashlib.md5(data).hexdigest(), path.rpartition("/")[2]
    macros, date, title, creator, error = name.lower().endswith(".xlsm"), "1900", None, None, None
    if macros:
        out["errors"].append((wb, path, None, "warning", "load", "the file has macros; they are not read"))
    try:
        if len(data) > max_bytes:
            raise ValueError("the file is too large")
        book = _Book(data, max_unpacked)
        if "docProps/core.xml" in book.parts:
            core = book.xml("docProps/core.xml")
            title, creator = ((e.text if e is not None else None) for e in (_one(core, "title"), _one(core, "creator")))
        root, rels = book.xml("xl/workbook.xml"), book.rels("xl/workbook.xml")
        pr = _one(root, "workbookPr")
        date = "1904" if pr is not None and pr.get("date1904") in ("1", "true") else "1900"
        book.date_system = date
        sheets = [s for s in _all(root, "sheet") if _local(s) == "sheet"]
        for k, s in enumerate(sheets):
            part = rels.get(s.get(_REL + "id"), ("", ""))[1]
            try:
                _sheet(book, part, wb, s.get("name"), k, s.get("state", "visible") != "visible", out, path, max_cells)
            except DAMAGE as e:
                out["errors"].append((wb, path, s.get("name"), "error", "sheet", f"{type(e).__name__}: {e}"[:300]))
        for d in _all(root, "definedName"):
            scope = int(d.get("localSheetId")) if d.get("localSheetId") else None
            out["names"].append((wb, d.get("name"), d.text, sheets[scope].get("name") if scope is not None and scope < len(sheets) else None, d.get("hidden") in ("1", "true")))
            if "[" in (d.text or ""):
                out["external_links"].append((wb, d.get("name"), d.text, len(out["external_links"])))
    except DAMAGE as e:
        error = f"{type(e).__name__}: {e}"[:300]
        out["errors"].append((wb, path, None, "error", "load", error))
    out["workbooks"].append((wb, path, name, len(data), macros, date, title, creator, error))
    return out


def _columns(ddl: str) -> list[str]:
    depth, parts, part = 0, [], ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(part)
            part = ""
        else:
            part += c
    return [p.split()[0] for p in [*parts, part]]


def read_workbooks(spark: SparkSession, path: str, tables: list[str] | None = None, **limits: int) -> dict[str, DataFrame]:
    """The tables of all workbook files under a path.  Each table is its own lazy scan; only tables that are used are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def of(table: str) -> DataFrame:
        names = _columns(TABLES[table])

        def run(batches):
            for pdf in batches:
                for p, content in zip(pdf["path"], pdf["content"], strict=True):
                    yield pd.DataFrame(parse(content, p, **limits)[table], columns=names, dtype=object)

        return files.mapInPandas(run, TABLES[table])

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    return {t: of(t) for t in tables or TABLES}


class WorkbookSource(DataSource):
    """spark.read.format("workbook").option("table", ...).load(folder): one partition a file, on any file system that Arrow knows; option sheet reads one sheet's rows."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "cells")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _files(path: str):
    """File system and path, of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"], options.get("table", "cells")
        self.sheet = options.get("sheet")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, place = _files(self.path)
        if self.path.lower().endswith((".xlsx", ".xlsm")):
            return [InputPartition(self.path)]
        head = self.path[: len(self.path.rstrip("/")) - len(place.rstrip("/"))] if "://" in self.path else ""
        found = system.get_file_info(fs.FileSelector(place, recursive=True))
        return [InputPartition(head + f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.lower().endswith((".xlsx", ".xlsm"))]

    def read(self, partition):
        system, place = _files(partition.value)
        with system.open_input_stream(place) as f:
            rows = parse(f.read(), partition.value)[self.table]
        k = _columns(TABLES[self.table]).index("sheet") if self.sheet else None
        yield from (r for r in rows if k is None or r[k] == self.sheet)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def chart_ranges(charts: DataFrame) -> DataFrame:
    """wb, sheet, r1, c1, r2, c2 of what charts' series show; for key cells."""
    from ..functions import a1

    s = charts.select("wb", "sheet", F.explode("series").alias("s")).select("wb", "sheet", F.col("s.values_ref").alias("ref")).where("ref IS NOT NULL")
    own = F.regexp_replace(F.substring_index("ref", "!", 1), "'", "")
    return s.select("wb", F.when(F.col("ref").contains("!"), own).otherwise(F.col("sheet")).alias("sheet"), a1.parse(F.substring_index("ref", "!", -1)).alias("p")).select("wb", "sheet", "p.*").where("r1 IS NOT NULL")
