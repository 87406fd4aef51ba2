"""Queries over workbooks made of small tables with odd values, against what their SQL says or against plain loops."""

import random

import pytest
from pyspark.sql import functions as F
from sheetloom.functions import formats
from sheetloom.plans import catalog
from sheetloom.sources import grid

duckdb = pytest.importorskip("duckdb")
ODD = [0.125, 0.375, 2.675, 1.005, 387373.855, 296814.225, -0.125, -1234.565, -0.001, 0.005, 0.995, 99.995, 0.0, 12.5, 1e15 + 0.375, 7e15]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Prices and balances whose third decimal is a five, nulls, customers without orders and orders without customers."""
    d, rng = tmp_path_factory.mktemp("odd"), random.Random(7)
    con = duckdb.connect()
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR)")
    con.execute("CREATE TABLE customer (c_custkey BIGINT, c_name VARCHAR, c_acctbal DOUBLE, c_mktsegment VARCHAR)")
    for k in range(300):
        price = None if k % 41 == 0 else rng.choice(ODD) if k % 2 else rng.randint(0, 10**6) / 8
        con.execute("INSERT INTO orders VALUES (?, ?, ?, ?, TIMESTAMP '1998-02-06' + INTERVAL (?) DAY, ?)", [k, rng.randint(0, 24), rng.choice("FFFOP"), price, k, rng.choice(["5-LOW", "4-NOT SPECIFIED"])])
    for k in range(22):
        con.execute("INSERT INTO customer VALUES (?, ?, ?, ?)", [k, f"Customer#{k:09d}", None if k == 5 else rng.choice(ODD), "MACHINERY"])
    for t in ("orders", "customer"):
        con.execute(f"COPY {t} TO '{d}/{t}.parquet' (FORMAT parquet)")
    return str(d), con


def both(spark, odd, name):
    d, con = odd
    df = catalog.QUERIES[name](spark, d)
    names = ", ".join(f'"{c}"' for c in df.columns)
    got = [tuple(r) for r in df.collect()]
    return sorted(got, key=repr), sorted((tuple(r) for r in con.execute(f"SELECT {names} FROM ({catalog.ORACLE[name]})").fetchall()), key=repr)


@pytest.mark.parametrize("name", ["grid_cells", "template_extract", "linearize_sheet", "merge_recovery"])
def test_texts_of_odd_numbers(spark, odd, name):
    got, want = both(spark, odd, name)
    assert got == want and got


def test_fixed2_is_printf(spark):
    rng = random.Random(2)
    values = ODD + [rng.randint(-(10**8), 10**8) / 1000 for _ in range(2000)] + [round(rng.random() * 1e5, 2) * 1.5 for _ in range(2000)] + [rng.random() * 10 ** rng.randint(-4, 15) for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", formats.fixed2("x").alias("t")).collect()
    assert [r for r in rows if r["t"] != f"{r['x']:.2f}"] == []
    assert spark.createDataFrame([(None,)], "x double").select(formats.fixed2("x")).first()[0] is None


def test_a_workbook_stays_in_its_partition(spark, odd):
    x = grid.statements(spark, odd[0]).withColumn("p", F.spark_partition_id())
    assert x.groupBy("wb").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0


def moves(df) -> int:
    """How often rows are shuffled in the plan of df."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def chain(spark, d, name):
    """The same query, step by step over DataFrames."""
    from sheetloom.operators import annotate, tables

    a = annotate.annotate(grid.statements(spark, d))
    blocks = annotate.regions(a).localCheckpoint()
    structures = tables.assemble(blocks).localCheckpoint()
    if name == "assemble_tables":
        return structures
    if name == "attach_light_blocks":
        return tables.attach_light(blocks, structures)
    alike = tables.similarity(tables.features(structures, blocks, a)).localCheckpoint()
    if name == "table_similarity":
        return alike
    return tables.groups(alike) if name == "table_groups" else tables.tree(blocks, structures, tables.groups(alike).localCheckpoint())


@pytest.mark.parametrize("name", ["attach_light_blocks", "table_groups", "structure_tree", "assemble_tables", "table_similarity"])
def test_tables_in_one_pass(spark, odd, name):
    """The orders and the customers are moved, nothing after them; and the result is that of the steps."""
    df = catalog.QUERIES[name](spark, odd[0])
    assert moves(df) <= 3
    want = chain(spark, odd[0], name)
    assert sorted(map(str, df.collect())) == sorted(map(str, want.select(df.columns).collect())) and not want.isEmpty()


def test_labels_meet_bodies_by_place(spark):
    """Against all pairs of labels and bodies, on random blocks."""
    from sheetloom.operators import tables

    rng = random.Random(4)
    rows = []
    for sheet in range(8):
        for k in range(40):
            r, c = rng.randint(1, 30), rng.randint(1, 12)
            rows.append(("w", f"s{sheet}", k, rng.choice(["label", "data"]), r, c, r + rng.randint(0, 4), c + rng.randint(0, 3), 4, 1.0))
    b = spark.createDataFrame(rows, "wb string, sheet string, block_index int, annotation string, r1 int, c1 int, r2 int, c2 int, cell_count long, density double")
    rank = {"header": 0, "row_label": 1, "footer": 2}
    todo = sorted((r["sheet"], r["d_block_index"], rank[r["role"]], r["l_block_index"], r["role"]) for r in tables.candidates(b).collect())
    used, want = set(), {}
    for sheet, d, _, label, role in todo:
        if role not in want.setdefault((sheet, d), {}) and (sheet, label) not in used:
            used.add((sheet, label))
            want[sheet, d][role] = label
    got = {(r["sheet"], r["structure"]): {k: r[k] for k in rank if r[k] is not None} for r in tables.assemble(b).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v} and any(want.values())


@pytest.mark.parametrize("name", ["title_merge", "segment_sheet", "bounding_boxes", "invariants", "classify_blocks", "col_islands", "block_type_counts"])
def test_layout_in_one_pass(spark, odd, name):
    """As the SQL says, and no cell is moved: only orders, customers and what is already counted."""
    got, want = both(spark, odd, name)
    assert got == want
    assert moves(catalog.QUERIES[name](spark, odd[0])) <= (14 if name == "invariants" else 5)


def test_segments_are_the_steps(spark):
    """Against windows and joins, on random sheets with fills, merges, declared tables and columns of one row."""
    from sheetloom import schema
    from sheetloom.operators import layout

    rng, rows, declared = random.Random(9), [], []
    for sheet in range(30):
        for r in range(1, 26):
            if rng.random() < 0.85:
                fill = rng.choice([None, "AA"]) if r % 9 == 0 else "AA" if r // 9 % 2 else None
                for c in range(1, 8):
                    if c != 4 and rng.random() < (0.97 if sheet % 2 else 0.7):
                        kind = rng.choice("sssfi")
                        rows.append(("w", f"s{sheet}", r, c, kind, rng.choice(["scenario", "x", None]), None, rng.choice([None, None, "A1"]), rng.random() < 0.2, fill, None, None))
        if sheet % 3 == 0:
            declared.append(("w", f"s{sheet}", "T", 5, 1, 9, 3))
            declared.append(("w", f"s{sheet}", "U", 90, 1, 91, 2))
    x = spark.createDataFrame(rows, schema.CELLS).withColumn("merged", F.col("col") == 7)
    t = spark.createDataFrame(declared, schema.TABLES)
    for tables in (None, t):
        want = layout.merge_titles(layout.raw_blocks(x, tables))
        got = layout.segment(x, tables)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    want = layout.components(layout.style_split(layout.islands(x)))
    assert sorted(map(str, layout.classified(x).select(want.columns).collect())) == sorted(map(str, want.collect())) and want.where("style_part > 0").count()
    n = layout.raw_blocks(x, t).count() - layout.merge_titles(layout.raw_blocks(x, t)).count()
    assert (layout.absorbed(x, t).agg(F.sum("absorbed")).first()[0] or 0) == n


def test_stage_metrics_are_counts(spark, odd):
    got = {(r["stage"], r["metric"]): r["value"] for r in catalog.QUERIES["stage_metrics"](spark, odd[0]).collect()}
    cells = grid.statements(spark, odd[0])
    labels = catalog.QUERIES["annotate_cells"](spark, odd[0]).where("annotation = 'label'").count()
    blocks, edges = (catalog.QUERIES[n](spark, odd[0]) for n in ("segment_sheet", "dependency_edges"))
    assert (got["parse", "cells"], got["parse", "formulas"], got["annotate", "labels"]) == (cells.count(), cells.where("formula IS NOT NULL").count(), labels)
    assert got["segment", "covered"] == cells.count() and got["graph", "edges"] == edges.count() and len(got) == 8 and blocks.count()
    assert moves(catalog.QUERIES["stage_metrics"](spark, odd[0])) <= 12


@pytest.mark.parametrize("name", ["upstream_2hop", "kpi_catalog", "template_compare", "template_conflicts"])
def test_workbooks_stay(spark, odd, name):
    """As the SQL says; the orders and customers are moved, and what is counted by place."""
    got, want = both(spark, odd, name)
    assert got == want
    assert moves(catalog.QUERIES[name](spark, odd[0])) <= {"upstream_2hop": 3, "kpi_catalog": 7, "template_compare": 4}.get(name, 9)


def test_validate_whole(spark):
    """Missing sheets and cells, other texts, none twice and none left out; a document with a place twice has a row for each wrong text."""
    from sheetloom import schema
    from sheetloom.operators import template

    t = spark.createDataFrame([("S", 1, 1, "constant", "a"), ("S", 2, 1, "constant", "b"), ("T", 1, 1, "constant", None), ("S", 3, 1, "dof", None)], "sheet string, row int, col int, dof_type string, constant string")
    place = lambda wb, sheet, row, raw: (wb, sheet, row, 1, "s", raw, None, None, False, None, None, None)
    x = spark.createDataFrame([place("u", "S", 1, "a"), place("u", "S", 2, "c"), place("u", "S", 2, "b"), place("v", "T", 1, "z"), place("w", "S", 1, "a"), place("w", "S", 2, "b")], schema.CELLS)
    got = {(r["wb"], r["sheet"], r["row"], r["found"], r["problem"]) for r in template.validate(t, x).collect()}
    assert got == {("u", "S", 2, "c", "mismatch"), ("v", "S", 1, None, "missing_sheet"), ("v", "S", 2, None, "missing_sheet"), ("v", "T", 1, "z", "mismatch")}


def test_summary_of_blocks_against_loops(spark):
    from sheetloom import schema
    from sheetloom.operators import graph, layout

    rng, rows = random.Random(12), []
    for wb in "uv":
        for sheet in "ST":
            for r in range(1, 9):
                for c in range(1, 5):
                    if rng.random() < 0.7:
                        to = f"{rng.choice(['', '', 'S!', 'T!'])}{rng.choice('ABCD')}{rng.randint(1, 8)}"
                        rows.append((wb, sheet, r, c, "n", None, None, rng.choice([None, to, to + "+B2"]), False, None, None, None))
    x = spark.createDataFrame(rows, schema.CELLS)
    blocks, e = layout.segment(x).localCheckpoint(), graph.edges(x).localCheckpoint()
    edges, up = e.collect(), {}
    loops = {tuple(r) for r in graph.cycles(e).collect()}
    hop = lambda r: (r["wb"], r["target_sheet"] or r["sheet"], r["r1"], r["c1"])
    of = lambda r: (r["wb"], r["sheet"], r["row"], r["col"])
    for r in edges:
        up.setdefault(of(r), set()).add((r["ref"], r["edge_type"]))
        up[of(r)] |= {(n["ref"], n["edge_type"]) for n in edges if of(n) == hop(r)}
    for b, s in zip(blocks.orderBy("wb", "sheet", "block_index").collect(), graph.summary(blocks, e).orderBy("wb", "sheet", "block_index").collect(), strict=True):
        cells = {p for p in up if p[:2] == (b["wb"], b["sheet"]) and b["r1"] <= p[2] <= b["r2"] and b["c1"] <= p[3] <= b["c2"]}
        assert s["upstream"] == ",".join(sorted({t for p in cells for t, _ in up[p]})[:50])
        assert s["cross_sheet"] == ",".join(sorted({t for p in cells for t, k in up[p] if k == "cross_sheet"})[:20])
        assert s["downstream"] == ",".join(sorted({f"{r['sheet']}!{chr(64 + r['col'])}{r['row']}" for r in edges if hop(r) in cells})[:50])
        assert s["has_circular"] == bool(cells & loops)


@pytest.mark.parametrize("name", ["render_text", "render_html", "chunks", "vector_entries"])
def test_rendered_in_one_pass(spark, odd, name):
    from sheetloom.operators import chunk, graph, layout, render

    cells = grid.statements(spark, odd[0])
    flagged = layout.merge_flags(cells, grid.status_merges(spark, odd[0]))
    blocks = layout.segment(cells)
    want = {
        "render_text": lambda: render.text(blocks, cells), "render_html": lambda: render.html(blocks, flagged), "chunks": lambda: chunk.chunks(blocks, cells),
        "vector_entries": lambda: chunk.vector_entries(chunk.chunks(blocks, cells, with_html=False), graph.summary(blocks, graph.edges(cells))).select("id", "text", "metadata.*"),
    }[name]()
    df = catalog.QUERIES[name](spark, odd[0])
    assert sorted(map(str, df.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert moves(df) < moves(want)
