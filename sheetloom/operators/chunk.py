"""Chunks: blocks and charts with text, HTML, tokens, citation and neighbours; and what is written of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import a1
from . import render
from .layout import KEY


def chart_summary(charts: DataFrame) -> DataFrame:
    """charts (wb, sheet, chart_index, chart_type, title, x_title, y_title, from_row, from_col, to_row, to_col counted from 0, series) with summary and its place."""
    one = lambda s: F.concat(F.lit("- "), F.coalesce(s["name"], F.lit("series")), F.when(s["values_ref"].isNotNull(), F.concat(F.lit(": "), s["values_ref"])).otherwise(""))
    n = F.size("series")
    parts = F.concat_ws(
        "\n", F.concat(F.lit("Chart: "), F.coalesce("title", F.lit("untitled")), F.lit(" ("), F.col("chart_type"), F.lit(")")),
        F.when(F.col("x_title").isNotNull(), F.concat(F.lit("X axis: "), F.col("x_title"))), F.when(F.col("y_title").isNotNull(), F.concat(F.lit("Y axis: "), F.col("y_title"))),
        F.when(n > 0, F.concat(F.lit("Series ("), n.cast("string"), F.lit("):\n"), F.array_join(F.transform("series", one), "\n"))),
    )
    return charts.withColumn("summary", parts).withColumn("top_left", a1.coord(F.col("from_row") + 1, F.col("from_col") + 1)).withColumn("bottom_right", F.coalesce(a1.coord(F.col("to_row") + 1, F.col("to_col") + 1), "top_left"))


def chunks(blocks: DataFrame | None, cells: DataFrame, charts: DataFrame | None = None, path=None, with_html: bool = True, sheets: DataFrame | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """One row for each block, charts last, in the order of sheets and blocks: ids, uri, text, tokens, previous and next.

    The order of sheets is that of sheets (wb, sheet, sheet_index) if given, else by name.  Without blocks, those that segment finds.
    """
    path = F.col("wb") if path is None else path
    x = render.rendered(blocks, cells, hidden, with_html=with_html)
    where = a1.rect("r1", "c1", "r2", "c2")
    note = F.concat(F.lit("[block without visible cells: "), where, F.lit("]"))
    x = x.select("wb", "sheet", "block_index", F.lit(0).alias("is_chart"), "block_type", where.alias("range"), F.coalesce("render_text", note).alias("render_text"), "render_html")
    if charts is not None:
        c = chart_summary(charts)
        html = F.concat(F.lit('<div class="chart-summary" data-chart-type="'), F.col("chart_type"), F.lit('"><h4>'), a1.html_escape(F.substring_index("summary", "\n", 1)), F.lit("</h4><pre>"), a1.html_escape("summary"), F.lit("</pre></div>"))
        x = x.unionByName(c.select("wb", "sheet", F.col("chart_index").alias("block_index"), F.lit(1).alias("is_chart"), F.lit("chart_anchor").alias("block_type"), F.concat("top_left", F.lit(":"), "bottom_right").alias("range"), F.col("summary").alias("render_text"), html.alias("render_html")))
    order = ["is_chart", "sheet", "block_index"]
    if sheets is not None:
        x, order = x.join(sheets.select("wb", "sheet", "sheet_index"), KEY, "left"), ["is_chart", "sheet_index", *order[1:]]
    w = Window.partitionBy("wb").orderBy(*order)
    x = x.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("int")).withColumn("source_uri", F.concat(path, F.lit("#"), F.col("sheet"), F.lit("!"), F.col("range")))
    x = x.withColumn("content_hash", F.md5("render_text")).withColumn("chunk_id", a1.identity("wb", "sheet", "range", "block_type", "content_hash")).withColumn("token_count", a1.tokens("render_text"))
    return x.withColumn("prev_id", F.lag("chunk_id").over(w)).withColumn("next_id", F.lead("chunk_id").over(w)).drop("is_chart", "sheet_index")


def vector_entries(chunked: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """id, text and metadata for a vector store; has_formulas where a block's formulas refer to something."""
    x = chunked if summaries is None else chunked.join(summaries.select(*KEY, "block_index", (F.col("upstream") != "").alias("has_formulas")), [*KEY, "block_index"], "left")
    formulas = F.lit(False) if summaries is None else F.coalesce("has_formulas", F.lit(False))
    return x.select(F.col("chunk_id").alias("id"), F.col("render_text").alias("text"), F.struct("wb", "sheet", "range", "block_type", "token_count", "source_uri", formulas.alias("has_formulas")).alias("metadata"))


def workbook_json(chunked: DataFrame, edges: DataFrame, cells: DataFrame) -> DataFrame:
    """wb and json: totals, edges and chunks of a workbook in one document."""
    n = cells.groupBy("wb").agg(F.count("*").alias("total_cells"), F.count("formula").alias("total_formulas"), F.count_distinct("sheet").alias("total_sheets"))
    e = edges.groupBy("wb").agg(F.array_sort(F.collect_list(F.struct("sheet", "row", "col", "ref", "edge_type"))).alias("edges"))
    c = chunked.groupBy("wb").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "source_uri", "block_type", "token_count", "render_text"))).alias("chunks"), F.sum("token_count").alias("total_tokens"))
    x = n.join(e, "wb", "left").join(c, "wb", "left")
    return x.select("wb", F.to_json(F.struct("wb", "total_sheets", "total_cells", "total_formulas", "total_tokens", "edges", "chunks")).alias("json"))
