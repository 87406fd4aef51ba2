"""Workbook files, streams, sinks and the driver's entry."""

import __spark_entry__ as entry
import duckdb
import pandas as pd
import pytest
from sheetloom.operators import chunk, graph, layout
from sheetloom.sources import ooxml, sinks
from sheetloom.streaming import ingest
from workbook_files import workbook

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(workbook())
    (tmp_path / "in" / "b.xlsm").write_bytes(b"no zip")
    return str(tmp_path / "in")


def test_all_tables(spark, folder):
    t = {n: [r.asDict() for r in d.collect()] for n, d in ooxml.read_workbooks(spark, folder).items()}
    at = {(c["sheet"], c["row"], c["col"]): c for c in t["cells"]}
    assert at["Sales", 1, 2]["raw"] == "Price" and at["Sales", 1, 1]["bold"] and at["Sales", 1, 1]["fill"] == "FFC7CE" and at["Sales", 1, 1]["font_size"] == 14
    assert (at["Sales", 2, 2]["kind"], at["Sales", 3, 2]["kind"], at["Sales", 3, 1]["raw"], at["Sales", 4, 1]["kind"]) == ("i", "f", "True", "e")
    assert at["Sales", 5, 2]["formula"] == "SUM(B2:B3)" and at["Sales", 5, 2]["number_format"] == "$#,##0.00" and ("Hidden", 1048576, 1) in at
    s = {r["sheet"]: r for r in t["sheets"]}
    assert s["Hidden"]["hidden"] and s["Sales"]["hidden_rows"] == [3] and s["Sales"]["hidden_cols"] == [2] and s["Sales"]["row_heights"] == {1: 30.0} and s["Sales"]["autofilter"] == "A1:B5"
    assert (t["merges"][0]["r1"], t["merges"][0]["c2"]) == (7, 2) and t["tables"][0]["table_name"] == "SalesData" and [c["name"] for c in t["table_columns"]] == ["Item", "Price"]
    assert t["cf_rules"][0]["operator"] == "greaterThan" and t["dv_rules"][0]["formula1"] == '"a,b"' and t["comments"][0]["text"] == "check" and t["links"][0]["target"] == "https://example.com"
    assert {n["name"] for n in t["names"]} == {"Total", "Ext"} and t["external_links"][0]["name"] == "Ext"
    c = t["charts"][0]
    assert (c["chart_type"], c["title"], c["from_col"], c["series"][0]["values_ref"]) == ("bar", "Prices", 3, "Sales!$B$2:$B$3")
    assert {(e["severity"], e["stage"]) for e in t["errors"]} == {("warning", "load"), ("error", "load")}
    assert {w["date_system"] for w in t["workbooks"] if not w["error"]} == {"1904"}
    assert ooxml.chart_ranges(ooxml.read_workbooks(spark, folder)["charts"]).first()["r2"] == 3


def test_source_and_limits(spark, folder):
    ooxml.register(spark)
    assert spark.read.format("workbook").option("table", "cells").option("sheet", "Sales").load(folder).count() == 9
    assert ooxml.read_workbooks(spark, folder, ["errors"], max_cells=3)["errors"].where("stage = 'cells'").count() == 1
    assert ooxml.parse(workbook(), "x.xlsx", max_unpacked=10)["errors"][0][4] == "load"
    broken = ooxml.parse(workbook(**{"xl/worksheets/sheet2.xml": "<bad"}), "x.xlsx")
    assert len(broken["cells"]) == 9 and broken["errors"][0][2] == "Hidden"


def test_file_to_chunks_and_back(spark, folder, tmp_path):
    t = ooxml.read_workbooks(spark, folder)
    blocks = layout.segment(t["cells"], t["tables"])
    made = chunk.chunks(blocks, t["cells"], t["charts"])
    kinds = [r["block_type"] for r in made.orderBy("chunk_index").collect()]
    assert kinds[-1] == "chart_anchor" and "table" in kinds
    sinks.write_tables({"chunks": made}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/chunks")).count() == len(kinds)
    sinks.write_json(chunk.workbook_json(made, graph.edges(t["cells"]), t["cells"]), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["total_sheets"] == 2


def test_stream(spark, folder, tmp_path):
    q = ingest.write_chunks(ingest.stream_cells(spark, folder), str(tmp_path / "chunks"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "chunks")).count() >= 3


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "chunk_id" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["a1_roundtrip", "workbook_totals", "merge_recovery", "classify_blocks", "segment_sheet", "annotate_cells", "flood_fill_blocks", "dependency_edges", "circular_cells", "kpi_catalog", "sheet_purpose", "template_compare", "pattern_split", "display_format", "perf_percentiles"])
def test_sql_says_the_same(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    a, b = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda d: sorted(str([None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) else str(v) for v in r]) for r in d[sorted(d.columns)].astype(object).to_numpy().tolist())
    assert rows(a) == rows(b)


SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def cells_of(body, **more):
    out = ooxml.parse(workbook(**{"xl/worksheets/sheet2.xml": SHEET.format(body)} | more), "x.xlsx")
    return {(c[2], c[3]): c for c in out["cells"] if c[1] == "Hidden"}, out["errors"]


def test_shared_formulas_are_shifted():
    body = '<row r="1"><c r="A1"><f t="shared" ref="A1:A3" si="0">B1*2</f><v>1</v></c><c r="C1"><f t="shared" ref="C1:D2" si="1">SUM($A1:A$1)+LOG10(B1)+Sheet1!C2&amp;"B1"+\'A1 x\'!A1+T[B1]+B:B+$3:4</f></c></row>'
    body += '<row r="2"><c r="A2"><f t="shared" si="0"/><v>1</v></c><c r="D2"><f t="shared" si="1"/></c></row><row r="3"><c r="A3"><f t="shared" si="0"/></c></row>'
    at, errors = cells_of(body)
    assert not errors and [at[r, 1][7] for r in (1, 2, 3)] == ["B1*2", "B2*2", "B3*2"]
    assert at[2, 4][7] == "SUM($A2:B$1)+LOG10(C2)+Sheet1!D3&\"B1\"+'A1 x'!B2+T[B1]+C:C+$3:5"
    assert ooxml.shifted("A1+XFD1", -1, 1) == "#REF!+#REF!"


def test_places_without_references_and_dates():
    styles = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="170" formatCode="[Red]0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="22"/><xf numFmtId="21"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    body = '<row><c><v>1</v></c><c s="1"><v>45000</v></c></row><row r="5"><c r="C5"><v>2</v></c><c s="2"><v>45000.75</v></c><c s="3"><v>0.5</v></c><c s="4"><v>3.5</v></c></row><row><c><v>9</v></c></row>'
    at, errors = cells_of(body, **{"xl/styles.xml": styles})
    assert not errors and sorted(at) == [(1, 1), (1, 2), (5, 3), (5, 4), (5, 5), (5, 6), (6, 1)]
    assert [(at[k][4], at[k][5]) for k in ((1, 2), (5, 4), (5, 5), (5, 6))] == [("d", "2027-03-16"), ("d", "2027-03-16T18:00:00"), ("d", "12:00:00"), ("f", "3.5")]
    assert ooxml.iso_date(45000, "yyyy-mm-dd", "1900") == "2023-03-15" and ooxml.iso_date(1, "d", "1900") == "1900-01-01" and ooxml.iso_date(-1, "d", "1900") is None


def test_damage_never_raises():
    import random

    rng, whole = random.Random(8), workbook()
    for body in ('<row r="x"><c r="A1"/></row>', '<row r="1"><c r="A1" t="s"><v>99</v></c></row>', '<row r="1"><c r="A1" s="-5"><v>inf</v></c></row>', '</sheetData><cols><col/></cols><sheetData>'):
        cells_of(body)
    for k in range(300):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 20)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        out = ooxml.parse(bytes(data[: rng.randint(1, len(data))] if k % 4 == 0 else data), "x.xlsx")
        assert len(out["workbooks"]) == 1


def test_source_takes_uris(spark, folder):
    ooxml.register(spark)
    df = spark.read.format("workbook").load("file://" + folder)
    assert df.where("sheet = 'Sales'").count() == 9 and df.count() > 9


def test_large_blocks_keep_all_cells(spark):
    from sheetloom.operators import render

    cells = spark.createDataFrame([("w", "s", 1 + k * 1000, 1 + k * 10, "s", f"v{k}", None, None, False, None, None, None) for k in range(300)], "wb string, sheet string, row int, col int, kind string, raw string, num double, formula string, bold boolean, fill string, font_size double, number_format string")
    block = spark.createDataFrame([("w", "s", 0, "mixed", 1, 1, 299_001, 2991)], "wb string, sheet string, block_index int, block_type string, r1 int, c1 int, r2 int, c2 int")
    text, html = render.text(block, cells).first()["render_text"], render.html(block, cells).first()["render_html"]
    assert all(f" v{k} " in text and f">v{k}<" in html for k in range(300))
