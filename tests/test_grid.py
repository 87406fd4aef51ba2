"""Layout, annotation, tables, graph, templates, rendering on small sheets with known results."""

import random

import pytest
from pyspark.sql import functions as F
from sheetloom import schema
from sheetloom.functions import a1, formats, refs
from sheetloom.operators import annotate, artifacts, chunk, graph, layout, render, tables, template
from sheetloom.sources import grid, sinks


def cells(spark, *rows, wb="w"):
    """rows: (sheet, address, value, options)"""
    import re

    out = []
    for sheet, address, value, *more in rows:
        m = re.fullmatch("([A-Z]+)([0-9]+)", address)
        col = 0
        for c in m[1]:
            col = col * 26 + ord(c) - 64
        o = more[0] if more else {}
        formula = value[1:] if isinstance(value, str) and value.startswith("=") else None
        kind = "n" if formula or value is None else "s" if isinstance(value, str) else "i" if isinstance(value, int) else "f"
        raw = None if formula or value is None else str(value)
        out.append((wb, sheet, int(m[2]), col, kind, raw, float(value) if kind in "if" else None, formula, o.get("bold", False), o.get("fill"), o.get("size"), o.get("fmt")))
    return spark.createDataFrame(out, schema.CELLS)


B = {"bold": True}


def block_of(spark, top, left, rows, cols, sheet="S", head=True):
    return [(sheet, f"{chr(64 + left + c)}{top + r}", f"h{c}" if head and r == 0 else r * 10 + c, B if head and r == 0 else {}) for r in range(rows) for c in range(cols)]


def ranges(df):
    return [r["x"] for r in df.orderBy("block_index").select(a1.rect("r1", "c1", "r2", "c2").alias("x")).collect()]


def test_notation(spark):
    def name(n):
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(65 + k) + out
        return out

    rows = spark.range(1, 16385).select("id", a1.letters("id").alias("t")).withColumn("back", a1.number("t")).collect()
    assert all(r["t"] == name(r["id"]) and r["back"] == r["id"] for r in rows)
    x = spark.createDataFrame([("$A$1",), ("b2:C30",), ("1A",)], "t string").select(a1.parse("t").alias("p")).collect()
    assert [tuple(r["p"]) if r["p"] else None for r in x] == [(1, 1, 1, 1), (2, 2, 30, 3), None]


def test_two_tables(spark):
    vertical = cells(spark, *block_of(spark, 1, 1, 4, 3), *block_of(spark, 7, 1, 4, 2))
    assert ranges(layout.segment(vertical)) == ["A1:C4", "A7:B10"]
    side = cells(spark, *block_of(spark, 1, 1, 4, 3), *block_of(spark, 1, 5, 4, 2))
    out = layout.segment(side)
    assert ranges(out) == ["A1:C4", "E1:F4"] and {r["block_type"] for r in out.collect()} == {"table"}


@pytest.mark.parametrize(("top", "want"), [(2, ["A1:C5"]), (3, ["A1:C6"]), (5, ["A1:B1", "A5:C8"])])
def test_titles(spark, top, want):
    """Adjacent, one blank row below, and too far."""
    out = layout.segment(cells(spark, ("S", "A1", "Sales", B), ("S", "B1", "report", B), *block_of(spark, top, 1, 4, 3)))
    assert ranges(out) == want


def test_title_merge_is_the_fold(spark):
    rng = random.Random(3)
    rows = []
    for sheet in range(40):
        r = 1
        for k in range(rng.randint(1, 7)):
            height, c = rng.randint(1, 5), rng.randint(1, 3)
            rows.append(("w", f"s{sheet}", f"t{k}" if rng.random() < 0.1 else None, r, c, r + height - 1, c + rng.randint(0, 2), height, rng.choice([0, 0, 0, 2]), False, False, rng.choice(["header", "table", "mixed", "text_block", "calculation_block"]), f"A{r}"))
            r += height + rng.choice([0, 0, 1, 2])
    names = ["wb", "sheet", "table_name", "r1", "c1", "r2", "c2", "cell_count", "formula_count", "has_merges", "has_formatting", "block_type", "key_cells"]
    kinds = "wb string, sheet string, table_name string, r1 int, c1 int, r2 int, c2 int, cell_count long, formula_count long, has_merges boolean, has_formatting boolean, block_type string, key_cells string"
    got = {(r["sheet"], r["block_index"]): (r["r1"], r["c1"], r["r2"], r["c2"], r["cell_count"], r["key_cells"]) for r in layout.merge_titles(spark.createDataFrame(rows, kinds)).collect()}
    want = {}
    for sheet in {r[1] for r in rows}:
        todo = [dict(zip(names, r, strict=True)) for r in rows if r[1] == sheet]
        done = []
        for k, b in enumerate(todo):
            n = todo[k + 1] if k + 1 < len(todo) else None
            height = b["r2"] - b["r1"] + 1
            if n and height <= 3 and not b["formula_count"] and not b["table_name"] and b["block_type"] != "calculation_block" and n["r1"] - b["r2"] - 1 <= (b["block_type"] == "header") and n["r2"] - n["r1"] + 1 > height and not (b["c2"] < n["c1"] or b["c1"] > n["c2"]):
                n.update(r1=min(b["r1"], n["r1"]), c1=min(b["c1"], n["c1"]), r2=max(b["r2"], n["r2"]), c2=max(b["c2"], n["c2"]), cell_count=b["cell_count"] + n["cell_count"], key_cells=b["key_cells"] + "," + n["key_cells"])
            else:
                done.append(b)
        for k, b in enumerate(done):
            want[sheet, k] = tuple(b[x] for x in ("r1", "c1", "r2", "c2", "cell_count", "key_cells"))
    assert got == want and len(got) < len(rows)


def test_style_split_and_declared_table(spark):
    rows = [("S", f"{c}{r}", r, {"fill": "FF0000" if r <= 4 else "00FF00"}) for r in range(1, 10) for c in "AB"]
    assert ranges(layout.segment(cells(spark, *rows))) == ["A1:B4", "A5:B9"]
    declared = spark.createDataFrame([("w", "S", "T", 1, 1, 3, 2)], schema.TABLES)
    out = layout.segment(cells(spark, *rows), declared)
    assert out.orderBy("block_index").collect()[0]["table_name"] == "T" and out.agg(F.sum("cell_count")).first()[0] == 18


def test_extreme_places_cost_nothing(spark):
    far = cells(spark, ("S", "A1", 1), ("S", "XFD1048576", 2))
    assert ranges(layout.segment(far)) == ["A1", "XFD1048576"]


def test_partitions_do_not_matter(spark):
    x = cells(spark, *block_of(spark, 1, 1, 4, 3), *block_of(spark, 7, 2, 4, 2), *block_of(spark, 1, 1, 5, 5, "T"))
    a = chunk.chunks(layout.segment(x), x).select("chunk_id", "prev_id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(str, a)) == sorted(map(str, chunk.chunks(layout.segment(x), x).select("chunk_id", "prev_id").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_merges(spark):
    x = cells(spark, ("S", "A1", None, {"fill": "x"}), ("S", "B1", "Recovered"), ("S", "A3", "kept"), ("S", "B3", "no"))
    m = spark.createDataFrame([("w", "S", 1, 1, 1, 2), ("w", "S", 3, 1, 3, 2)], schema.MERGES)
    flags = {(r["row"], r["col"]): (r["is_master"], r["is_slave"], r["col_span"]) for r in layout.merge_flags(x, m).collect()}
    assert flags[1, 1] == (True, False, 2) and flags[3, 2] == (False, True, None)
    got = {(r["row"], r["col"]): r["raw"] for r in layout.recover_masters(x, m, x).collect()}
    assert got[1, 1] == "Recovered" and got[3, 1] == "kept"


def test_bounding_boxes(spark):
    b = spark.createDataFrame([("w", "S", 0, 2, 2, 3, 2)], "wb string, sheet string, block_index int, r1 int, c1 int, r2 int, c2 int")
    sizes = spark.createDataFrame([("w", "S", "row", 1, 30.0), ("w", "S", "row", 3, 20.0), ("w", "S", "col", 2, 100.0)], "wb string, sheet string, axis string, at int, points double")
    r = layout.bounding_boxes(b, sizes).first()
    assert (r["y"], r["h"], round(r["x"], 3), r["w"]) == (30.0, 35.0, 63.225, 100.0)


def test_flood_fill_against_search(spark):
    rng = random.Random(5)
    rows = [("w", f"s{s}", r, c, rng.choice(["label", "data"])) for s in range(6) for r in range(1, 12) for c in range(1, 9) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "wb string, sheet string, row int, col int, annotation string").withColumn("formula", F.lit(None).cast("string")).withColumn("bold", F.lit(False))
    got = {(r["sheet"], r["reg_row"], r["reg_col"]): (r["annotation"], r["cell_count"]) for r in annotate.regions(df).collect()}
    place = {(s, r, c): a for _, s, r, c, a in rows}
    want, seen = {}, set()
    for p in sorted(place):
        if p in seen:
            continue
        todo, n = [p], 0
        seen.add(p)
        while todo:
            s, r, c = todo.pop()
            n += 1
            for q in ((s, r + 1, c), (s, r - 1, c), (s, r, c + 1), (s, r, c - 1)):
                if place.get(q) == place[p] and q not in seen:
                    seen.add(q)
                    todo.append(q)
        want[p] = (place[p], n)
    assert got == want


def test_assembly(spark):
    kinds = "wb string, sheet string, block_index int, annotation string, r1 int, c1 int, r2 int, c2 int, cell_count long, density double"
    b = spark.createDataFrame([("w", "S", 0, "label", 1, 1, 1, 4, 4, 1.0), ("w", "S", 1, "data", 2, 1, 5, 4, 16, 1.0), ("w", "S", 2, "label", 6, 1, 6, 4, 4, 1.0), ("w", "S", 3, "data", 8, 1, 9, 4, 3, 0.4), ("w", "S", 4, "label", 2, 0, 5, 0, 4, 1.0)], kinds)
    got = {r["structure"]: r for r in tables.assemble(b).collect()}
    assert (got[1]["header"], got[1]["row_label"], got[1]["footer"], got[1]["r1"], got[1]["c1"], got[1]["r2"]) == (0, 4, 2, 1, 0, 6)
    assert got[3]["header"] is None
    near = tables.nearest(tables.light(b), tables.assemble(b)).first()
    assert (near["block_index"], near["structure"], near["distance"], near["role"]) == (3, 1, 1, "footer")
    assert tables.attach_light(b, tables.assemble(b)).first()["structure"] == 1
    t = {r["node"]: (r["parent"], r["depth"]) for r in tables.tree(b, tables.assemble(b), spark.createDataFrame([], "wb string, sheet string, structure int, table_group int")).collect()}
    assert t["w|S|block|0"] == ("w|S|table|1", 2) and t["w|S|table|1"] == ("w|S|sheet", 1)


def test_patterns(spark):
    x = cells(spark, *[("S", f"A{r}", ["north", "south", "east"][(r - 1) % 3]) for r in range(1, 10)], *[("S", f"B{r}", r) for r in range(1, 10)])
    body = spark.createDataFrame([("w", "S", 0, 1, 1, 9, 2)], "wb string, sheet string, body int, r1 int, c1 int, r2 int, c2 int")
    assert [(r["factor"], r["stability"]) for r in tables.stability(body, x).collect()] == [(3, 1.0)]
    split = tables.pattern_split(body, x)
    assert [(r["r1"], r["r2"]) for r in split.orderBy("part").collect()] == [(1, 3), (4, 6), (7, 9)]
    assert tables.varying_labels(split, x).count() == 0


def test_references(spark):
    known = {
        "A1+B1": ["A1", "B1"], "SUM(A1:A10)": ["A1:A10"], "Sheet2!A1+Sheet2!B1": ["Sheet2!A1", "Sheet2!B1"], "'My Sheet'!A1": ["'My Sheet'!A1"], "$A$1+$B$2:$C$3": ["$A$1", "$B$2:$C$3"],
        "[Budget.xlsx]Sheet1!A1": ["[Budget.xlsx]Sheet1!A1"], "SalesData[Revenue]": ["SalesData[Revenue]"], "IF(Inputs!B1>0,SUM(A1:A10)*Inputs!B3,0)": ["Inputs!B1", "A1:A10", "Inputs!B3"], "1+2+3": [], "A1+A1": ["A1"],
    }
    df = spark.createDataFrame([(k,) for k in known], "f string").select("f", refs.references("f").alias("r"))
    assert {r["f"]: r["r"] for r in df.collect()} == known


def test_graph(spark):
    x = cells(spark, ("S", "A1", "=B1"), ("S", "B1", "=A1"), ("S", "A3", "=C3"), ("S", "C3", "=B3"), ("S", "B3", "=A3+T!A1"), ("S", "A5", "=B5"), ("S", "B5", "=C5"), ("S", "D1", "=D1"), ("T", "A1", 5), ("S", "E1", "=SUM(A1:B3)+[x.xlsx]S!A1+Tab[c]"))
    e = graph.edges(x)
    kinds = {r["ref"]: r["edge_type"] for r in e.collect()}
    assert kinds["T!A1"] == "cross_sheet" and kinds["A1:B3"] == "cell_to_range" and kinds["[x.xlsx]S!A1"] == "external" and kinds["Tab[c]"] == "structured_ref" and kinds["B5"] == "cell_to_cell"
    loops = {r["t"] for r in graph.cycles(e).select(a1.coord("row", "col").alias("t")).collect()}
    assert loops == {"A1", "B1", "A3", "B3", "C3", "D1"}
    up = {(r["row"], r["ref"]): r["step"] for r in graph.upstream(e, 2).where("col = 1 AND row = 5").collect()}
    assert up == {(5, "B5"): 1, (5, "C5"): 2}
    down = graph.downstream(e, 2).where("sheet = 'S' AND row = 5 AND col = 3").collect()
    assert {(r["user_row"], r["user_col"], r["step"]) for r in down} == {(5, 2, 1), (5, 1, 2)}
    names = spark.createDataFrame([("w", "Tab", "x", None, False)], schema.NAMES)
    assert graph.edges(x, names).where("edge_type = 'named_range'").count() == 1
    s = graph.summary(layout.segment(x), e).where("has_circular").count()
    assert s >= 1


def test_text_and_html(spark):
    x = cells(spark, ("S", "A1", "Name", B), ("S", "B1", "a<b", B), ("S", "A2", "x"), ("S", "B2", 5), ("S", "A3", "y"), ("S", "B3", "=B2*2"))
    b = layout.segment(x)
    t = render.text(b, x).first()["render_text"]
    assert t == "[S!A1:B3] (table)\n| A    | B   |\n|------|-----|\n| Name | a<b |\n|------|-----|\n| x    | 5   |\n| y    |  [=] |"
    h = render.html(b, x).first()["render_html"]
    assert h.startswith('<table data-sheet="S" data-range="A1:B3" data-block-type="table">\n<thead>\n<tr>') and "a&lt;b" in h and '<th data-ref="A1" style="font-weight:bold">Name</th>' in h and h.endswith("</tbody>\n</table>")
    hidden = spark.createDataFrame([("w", "S", [2], [1])], "wb string, sheet string, hidden_rows array<int>, hidden_cols array<int>")
    assert "x" not in render.text(b, x, hidden).first()["render_text"].replace("[", "")


def test_formats():
    assert [formats.shown(*v) for v in ((2.5, "0"), (0.125, "0.00"), (0.5, "0%"), (1234.5, "#,##0.00"), (1234567.5, None), (1234567.0, None), (None, "0"))] == ["2", "0.12", "50%", "1,234.50", "1.23457e+06", "1234567", None]


def test_templates(spark):
    one = cells(spark, ("S", "A1", "total", B), ("S", "B1", 5), ("S", "C1", "=B1*2"), ("S", "D1", "label name", B))
    two = cells(spark, ("S", "A1", "total", B), ("S", "B1", 6), ("S", "C1", "=B1*2"), ("S", "D1", "label date", B), wb="v")
    s = template.specs(annotate.annotate(one.unionByName(two)))
    t = template.compare(s)
    assert {r["col"]: (r["dof_type"], r["conflict"]) for r in t.collect()} == {1: ("constant", False), 2: ("dof", False), 3: ("formula", False), 4: ("dof", True)}
    assert template.conflicts(s).count() == 2
    bad = cells(spark, ("S", "A1", "sum"), wb="u").unionByName(cells(spark, ("Z", "A1", 1), wb="t"))
    assert {(r["wb"], r["problem"]) for r in template.validate(t, bad).collect()} == {("u", "mismatch"), ("t", "missing_sheet")}
    assert sorted(r["raw"] for r in template.extract(t, one).collect()) == ["5", "label name"]
    assert "formulas" in template.importer_source(t)


def test_artifacts(spark):
    x = cells(spark, ("S", "A1", "Revenue", B), ("S", "B1", "=C1+C2", {"bold": True, "fmt": "$0"}), ("S", "C1", 4), ("S", "C2", 3), ("S", "D1", "=B1"))
    e = graph.edges(x)
    k = artifacts.kpis(x, e).collect()
    assert [(r["cell_ref"], r["label"], r["in_degree"]) for r in k] == [("S!B1", "Revenue", 1)]
    assert artifacts.entities(x).first()["category"] == "measure"
    assert artifacts.linearize(x).first()["text"] == "Revenue | =C1+C2 | 4 | =B1\n3"
    assert "Key outputs: Revenue (S!B1)." in artifacts.summary_text(artifacts.purposes(x, e), artifacts.kpis(x, e)).first()["summary_text"]
    assert all(r["violations"] == 0 for r in artifacts.invariants(x, layout.segment(x), e).collect())
    assert "| parse | cells | 5 |" in sinks.report(artifacts.stage_metrics(x, annotate.annotate(x), layout.segment(x), e))


def test_sheet_of(spark):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 0.5)], "k long, t string, v double")
    out = {(r["row"], r["col"]): r["raw"] for r in grid.sheet_of(df, ["k"]).collect()}
    assert out == {(1, 1): "k", (1, 2): "t", (1, 3): "v", (2, 1): "1", (2, 2): "a", (2, 3): "0.5", (3, 1): "2", (3, 2): "b"}
