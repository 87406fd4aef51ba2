"""Derived facts: sheet summaries and purposes, entities, key cells, reading order; and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import a1
from .graph import in_degree
from .layout import KEY

MEASURES = "actual|amount|balance|budget|cost|count|ebitda|expense|fee|forecast|gross|growth|income|margin|net|percent|percentage|price|profit|qty|quantity|rate|revenue|roi|sales|score|sum|target|tax|total|value|variance|volume|yield"
PURPOSES = ("dashboard", "raw_data", "lookup", "calculation", "input", "report", "template", "config")


def labels(cells: DataFrame) -> DataFrame:
    """label: the text to the left, else above."""
    left = Window.partitionBy(*KEY, "row").orderBy("col")
    up = Window.partitionBy(*KEY, "col").orderBy("row")
    near = lambda w, c: F.when((F.lag(c).over(w) == F.col(c) - 1) & (F.lag("kind").over(w) == "s"), F.lag("raw").over(w))
    # in this order, so that the cells end in the order that joins on places ask for
    return cells.withColumn("_up", near(up, "row")).withColumn("label", F.coalesce(near(left, "col"), "_up")).drop("_up")


def kpis(cells: DataFrame, edges: DataFrame, chart_ranges: DataFrame | None = None, least: int = 3) -> DataFrame:
    """Key cells: scored by how many formulas use them (5, 3, 1: 4, 3, 1), charts (2), bold formulas (2), money (2) or percent (1), large type (1)."""
    x = labels(cells).join(in_degree(edges), [*KEY, "row", "col"], "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)).cast("long"))
    if chart_ranges is not None:  # wb, sheet, r1, c1, r2, c2
        c = chart_ranges.alias("g")
        hit = x.alias("x").join(c, (F.col("x.wb") == F.col("g.wb")) & (F.col("x.sheet") == F.col("g.sheet")) & a1.inside("x.row", "x.col", "g.r1", "g.c1", "g.r2", "g.c2"), "left_semi")
        x = x.join(hit.select(*KEY, "row", "col").withColumn("charted", F.lit(2)), [*KEY, "row", "col"], "left")
    else:
        x = x.withColumn("charted", F.lit(0))
    d, fmt = F.col("in_degree"), F.coalesce("number_format", F.lit(""))
    score = F.when(d >= 5, 4).when(d >= 3, 3).when(d >= 1, 1).otherwise(0) + F.coalesce("charted", F.lit(0)) + F.when(F.col("formula").isNotNull() & F.col("bold"), 2).otherwise(0)
    score = score + F.when(fmt.contains("$"), 2).when(fmt.contains("%"), 1).otherwise(0) + F.when(F.col("font_size") >= 14, 1).otherwise(0)
    return x.withColumn("score", score).where(F.col("score") >= least).select(*KEY, "row", "col", "label", "score", "in_degree", F.concat("sheet", F.lit("!"), a1.coord("row", "col")).alias("cell_ref"))


def drivers(found: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """Up to five references of each key cell's formula, in order of text."""
    x = found.select(*KEY, "row", "col").join(edges.select(*KEY, "row", "col", "ref"), [*KEY, "row", "col"])
    rank = F.row_number().over(Window.partitionBy(*KEY, "row", "col").orderBy("ref"))
    return x.withColumn("rank", rank.cast("int")).where(F.col("rank") <= most)


def purposes(cells: DataFrame, edges: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Counts of each sheet and its likeliest purpose.  facts (wb, sheet, tables, charts, validations, print_area, protected): what else is known."""
    x = cells.groupBy(*KEY).agg(F.count("*").alias("total_cells"), F.count("formula").alias("formula_count"))
    cross = edges.where("edge_type = 'cross_sheet' AND book IS NULL").groupBy("wb", F.col("target_sheet").alias("sheet")).agg(F.count("*").alias("cross_in"))
    x = x.join(cross, KEY, "left").withColumn("cross_in", F.coalesce("cross_in", F.lit(0)))
    if facts is None:
        for c in ("tables", "charts", "validations"):
            x = x.withColumn(c, F.lit(0))
        x = x.withColumn("print_area", F.lit(False)).withColumn("protected", F.lit(False))
    else:
        x = x.join(facts, KEY, "left").na.fill(0).na.fill(False)
    d, n = F.col("formula_count") / F.col("total_cells"), F.col("total_cells")
    chart, dv = F.col("charts") > 0, F.col("validations") > 0
    add = lambda *rules: sum((F.when(c, F.lit(v)).otherwise(0.0) for c, v in rules), F.lit(0.0))
    scores = {
        "dashboard": add((chart & (d < 0.3), 0.6), (chart, 0.2)),
        "raw_data": add(((d < 0.05) & (n > 20), 0.5), ((d < 0.01) & (n > 50), 0.3), ((d < 0.15) & (F.col("tables") > 0), 0.3)),
        "lookup": F.when(F.col("cross_in") > 3, 0.7).when(F.col("cross_in") > 0, 0.3).otherwise(0.0),
        "calculation": add((d > 0.3, 0.5), ((d > 0.5) & ~chart, 0.3)),
        "input": add((dv, 0.5), (dv & (d < 0.2), 0.3)),
        "report": add((F.col("print_area"), 0.4)),
        "template": add((F.col("protected") & dv, 0.5)),
        "config": add((n < 15, 0.3)),
    }
    best = F.array_max(F.array(*(F.struct(F.round(scores[p], 2).alias("s"), F.lit(-k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(PURPOSES))))
    x = x.withColumn("b", best)
    known = F.col("b.s") >= 0.1
    return x.select(*KEY, "total_cells", "formula_count", F.round(d, 4).alias("formula_density"), F.when(known, F.col("b.p")).otherwise("unknown").alias("purpose"), F.when(known, F.least(F.col("b.s"), F.lit(1.0))).otherwise(0.0).alias("confidence"))


def summary_text(found: DataFrame, key_cells: DataFrame) -> DataFrame:
    """A sentence for each sheet, with the three most used of its key cells."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("in_degree"), "row", "col"))
    top = key_cells.withColumn("k", rank).where("k <= 3").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce(F.concat("label", F.lit(" ("), "cell_ref", F.lit(")")), "cell_ref").alias("t")))).alias("top"))
    x = found.join(top, KEY, "left")
    name = F.initcap(F.replace("purpose", F.lit("_"), F.lit(" ")))
    head = F.concat(F.lit('Sheet "'), F.col("sheet"), F.lit('" ('), name, F.lit("): "), F.col("total_cells").cast("string"), F.lit(" cells, "), F.col("formula_count").cast("string"), F.lit(" formulas."))
    outs = F.when(F.col("top").isNotNull(), F.concat(F.lit("Key outputs: "), F.array_join(F.transform("top", lambda v: v["t"]), "; "), F.lit(".")))
    return x.select(*KEY, F.concat_ws(" ", head, outs).alias("summary_text"))


def entities(cells: DataFrame, table_columns: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Named things of a workbook: key (lower case), the spelling seen first (table columns, then headers, then defined names), category and number of places."""
    head = cells.where("bold AND kind = 's'").withColumn("name", F.trim("raw")).where("length(name) BETWEEN 2 AND 49")
    x = head.select("wb", "name", F.lit(1).alias("source"), "sheet", "row", "col")
    if table_columns is not None:
        x = x.unionByName(table_columns.select("wb", F.trim("name").alias("name"), F.lit(0).alias("source"), "sheet", F.lit(0).alias("row"), F.lit(0).alias("col")).where("length(name) > 1"))
    if names is not None:
        x = x.unionByName(names.select("wb", "name", F.lit(2).alias("source"), F.coalesce("scope_sheet", F.lit("(workbook)")).alias("sheet"), F.lit(0).alias("row"), F.lit(0).alias("col")).where("length(name) > 1 AND NOT startswith(name, '_')"))
    g = x.groupBy("wb", F.lower("name").alias("key")).agg(F.min_by("name", F.struct("source", "sheet", "row", "col")).alias("name"), F.count("*").alias("places"))
    return g.withColumn("category", F.when(F.col("key").rlike(MEASURES), "measure").otherwise("dimension"))


def linearize(cells: DataFrame) -> DataFrame:
    """A sheet's texts in reading order, a line for each row."""
    rows = cells.withColumn("t", F.coalesce("raw", F.concat(F.lit("="), F.col("formula")))).where("t IS NOT NULL")
    lines = rows.groupBy(*KEY, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "t"))), lambda v: v["t"]), " | ").alias("line"))
    return lines.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda v: v["line"]), "\n").alias("text"))


def scorecard(df: DataFrame, by: list[str], value: str) -> DataFrame:
    m, s = F.avg(value), F.stddev_pop(value)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(m, 6).alias("mean"), F.round(s, 6).alias("sd"), F.round(s / m, 6).alias("cv"))


def index_percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50, p95 and p99 by place: the value at floor(n * p) of the sorted values.  Ranks come from counts of equal values, which are aggregated before the window."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    c = c.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    pick = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col(value))).alias(f"p{int(p * 100)}")
    return c.groupBy(*by).agg(F.first("n").alias("n"), pick(0.5), pick(0.95), pick(0.99))


def drift(a: DataFrame, b: DataFrame, keys: list[str], value: str, absolute: float, relative: float) -> DataFrame:
    """Rows of two measurements that differ by more than either threshold allows; null isn't 0."""
    x = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys)
    d = F.abs(F.col("a") - F.col("b"))
    return x.where((d > absolute) & (d > relative * F.greatest(F.abs("a"), F.abs("b"))))


def invariants(cells: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Names of invariants and how many rows break them; all should be 0."""
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    flat = F.expr("r1 > r2 OR c1 > c2 OR r1 < 1 OR c1 < 1")
    of_cells = cells.groupBy(*KEY, "row", "col").agg(F.count("*").alias("c")).groupBy(*KEY).agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 1).alias("dup"))
    of_blocks = blocks.groupBy(*KEY).agg(F.sum("cell_count").alias("m"), F.count_if(flat).alias("flat"), (F.max("block_index") != F.count("*") - 1).cast("long").alias("index"))
    both = of_cells.join(of_blocks, KEY, "full").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("dup", "flat", "index")), n(F.expr("n IS DISTINCT FROM m")).alias("lost"))
    loose, book = F.expr("edge_type NOT IN ('external', 'structured_ref', 'named_range') AND r1 IS NULL"), F.expr("(edge_type = 'external') != (book IS NOT NULL)")
    found = both.crossJoin(edges.agg(n(loose).alias("loose"), n(book).alias("book")))
    names = {"unique_places": "dup", "ranges_ordered": "flat", "block_index_dense": "index", "edges_resolved": "loose", "external_has_book": "book", "cells_in_blocks": "lost"}
    return found.select(F.explode(F.array(*(F.struct(F.lit(k).alias("invariant"), F.col(v).alias("violations")) for k, v in names.items()))).alias("x")).select("x.*")


def stage_metrics(cells: DataFrame, annotated: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of each stage in one small table."""
    row = lambda stage, df, **m: df.agg(*(v.cast("double").alias(k) for k, v in m.items())).select(F.lit(stage).alias("stage"), F.explode(F.map_from_arrays(F.array(*map(F.lit, m)), F.array(*m))).alias("metric", "value"))
    of_cells = row("cells", annotated, cells=F.count("*"), formulas=F.count("formula"), labels=F.count_if(F.col("annotation") == "label"), confidence=F.round(F.avg("confidence"), 6))
    parts = [  # every annotated cell is a cell, so one pass counts both
        of_cells.withColumn("stage", F.when(F.col("metric").isin("cells", "formulas"), "parse").otherwise("annotate")),
        row("segment", blocks, blocks=F.count("*"), covered=F.sum("cell_count")),
        row("graph", edges, edges=F.count("*"), external=F.count("book")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
