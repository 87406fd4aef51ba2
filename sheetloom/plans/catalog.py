"""Queries over the grid operators, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import a1, formats, refs
from ..operators import annotate, artifacts, chunk, graph, layout, render, tables, template
from ..sources import grid
from . import sql

QUERIES, ORACLE = {}, {}


def query(select: str | None = None, recursive: bool = False, **extra: str):
    """Registers a query by its function's name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if select:
            ORACLE[f.__name__] = sql.build(select, recursive, **extra)
        return f

    return add


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# ---- notation and cells


@query(f"SELECT p_partkey, {sql.letters('(p_partkey % 16384 + 1)')} AS letters, (p_partkey % 16384 + 1)::INT AS back, {sql.coord('p_size', '(p_partkey % 16384 + 1)')} AS address FROM part")
def a1_roundtrip(spark, sf):
    n = (F.col("p_partkey") % 16384 + 1).cast("int")
    out = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", a1.letters(n).alias("letters"), a1.coord("p_size", n).alias("address"))
    return out.withColumn("back", a1.number("letters"))


@query("SELECT * FROM cells")
def grid_cells(spark, sf):
    return grid.statements(spark, sf)


@query("SELECT * FROM used")
def used_range(spark, sf):
    return layout.used_range(grid.statements(spark, sf))


@query("SELECT wb, sheet, count(*) AS cells, count(formula) AS formulas FROM cells GROUP BY GROUPING SETS ((wb, sheet), (wb))")
def workbook_totals(spark, sf):
    return layout.totals(grid.statements(spark, sf))


@query("""SELECT c.wb, c.sheet, c.row, c.col, m.wb IS NOT NULL AS merged, coalesce(c.row = m.r1 AND c.col = m.c1, false) AS is_master, coalesce(NOT (c.row = m.r1 AND c.col = m.c1), false) AS is_slave,
  CASE WHEN c.row = m.r1 AND c.col = m.c1 THEN m.r2 - m.r1 + 1 END AS row_span FROM cells c LEFT JOIN merges m ON m.wb = c.wb AND m.sheet = c.sheet AND c.row BETWEEN m.r1 AND m.r2 AND c.col BETWEEN m.c1 AND m.c2""")
def merge_flags(spark, sf):
    out = layout.merge_flags(grid.statements(spark, sf), grid.status_merges(spark, sf))
    return out.select("wb", "sheet", "row", "col", "merged", "is_master", "is_slave", "row_span")


@query("""SELECT c.wb, c.sheet, c.row, c.col, coalesce(c.raw, r.v) AS raw FROM (SELECT c.wb, c.sheet, c.row, c.col, CASE WHEN m.wb IS NULL THEN c.raw END AS raw, c.formula FROM cells c LEFT JOIN merges m ON m.wb = c.wb AND m.sheet = c.sheet AND m.r1 = c.row AND m.c1 = c.col) c
  LEFT JOIN (SELECT m.wb, m.sheet, m.r1, m.c1, arg_min(v.raw, struct_pack(a := v.row = m.r1 AND v.col = m.c1, b := v.row, c := v.col)) AS v FROM merges m JOIN cells v ON v.wb = m.wb AND v.sheet = m.sheet AND v.row BETWEEN m.r1 AND m.r2 AND v.col BETWEEN m.c1 AND m.c2
    WHERE v.raw IS NOT NULL GROUP BY m.wb, m.sheet, m.r1, m.c1) r ON r.wb = c.wb AND r.sheet = c.sheet AND r.r1 = c.row AND r.c1 = c.col AND c.formula IS NULL""")
def merge_recovery(spark, sf):
    cells, merges = grid.statements(spark, sf), grid.status_merges(spark, sf)
    flagged = layout.merge_flags(cells, merges)
    blank = flagged.withColumn("raw", F.when(~F.col("is_master"), F.col("raw"))).select(*cells.columns)
    return layout.recover_masters(blank, merges, cells).select("wb", "sheet", "row", "col", "raw")


@query("SELECT c.wb, c.sheet, c.row, c.col FROM free c")
def anti_table_cells(spark, sf):
    return layout.outside_tables(grid.statements(spark, sf), grid.finished_tables(spark, sf)).select("wb", "sheet", "row", "col")


@query("SELECT * FROM tstats")
def table_block_stats(spark, sf):
    return layout.table_blocks(grid.statements(spark, sf), grid.finished_tables(spark, sf)).drop("has_merges")


# ---- layout


@query("SELECT wb, sheet, row_island, min(row) AS r1, max(row) AS r2, count(*) AS cells FROM isl GROUP BY ALL")
def row_islands(spark, sf):
    return layout.islands(grid.statements(spark, sf)).groupBy("wb", "sheet", "row_island").agg(F.min("row").alias("r1"), F.max("row").alias("r2"), F.count("*").alias("cells"))


@query("SELECT wb, sheet, row_island, col_island, min(col) AS c1, max(col) AS c2, count(*) AS cells FROM isl GROUP BY ALL")
def col_islands(spark, sf):
    return layout.islands(grid.statements(spark, sf)).groupBy("wb", "sheet", "row_island", "col_island").agg(F.min("col").alias("c1"), F.max("col").alias("c2"), F.count("*").alias("cells"))


@query("SELECT wb, sheet, row_island, col_island, style_part, min(row) AS r1, max(row) AS r2, count(*) AS cells FROM styled GROUP BY ALL")
def style_split(spark, sf):
    return layout.style_split(layout.islands(grid.statements(spark, sf))).groupBy("wb", "sheet", "row_island", "col_island", "style_part").agg(F.min("row").alias("r1"), F.max("row").alias("r2"), F.count("*").alias("cells"))


@query("SELECT * FROM comps")
def classify_blocks(spark, sf):
    return layout.classified(grid.statements(spark, sf))


@query("SELECT wb, sheet, block_index, table_name, r1, c1, r2, c2, cell_count, formula_count, has_formatting, block_type, key_cells FROM blocks")
def segment_sheet(spark, sf):
    return layout.segment(grid.statements(spark, sf), grid.finished_tables(spark, sf)).drop("has_merges")


@query("SELECT wb, sheet, count(*) AS absorbed FROM fold WHERE took GROUP BY ALL")
def title_merge(spark, sf):
    return layout.absorbed(grid.statements(spark, sf), grid.finished_tables(spark, sf))


@query("SELECT wb, sheet, block_index, (c1 - 1) * 63.225 AS x, (r1 - 1) * 15.0::DOUBLE AS y, (c2 - c1 + 1) * 63.225 AS w, (r2 - r1 + 1) * 15.0::DOUBLE AS h FROM (SELECT wb, sheet, block_index, c1::DOUBLE AS c1, r1::DOUBLE AS r1, c2::DOUBLE AS c2, r2::DOUBLE AS r2 FROM blocks)")
def bounding_boxes(spark, sf):
    return layout.bounding_boxes(layout.segment(grid.statements(spark, sf), grid.finished_tables(spark, sf))).select("wb", "sheet", "block_index", *(F.round(c, 6).alias(c) for c in "xywh"))


# ---- annotation and tables


def annotated(spark, sf):
    return annotate.annotate(grid.statements(spark, sf))


def regions(spark, sf):
    return annotate.regions(annotated(spark, sf))


@query("SELECT wb, sheet, row, col, base FROM scored")
def annotate_pass1(spark, sf):
    return annotate.intrinsic(grid.statements(spark, sf)).select("wb", "sheet", "row", "col", "base")


@query("SELECT wb, sheet, row, col, annotation, confidence FROM ann")
def annotate_cells(spark, sf):
    return annotated(spark, sf).select("wb", "sheet", "row", "col", "annotation", "confidence")


@query("SELECT wb, sheet, block_index, annotation, r1, c1, r2, c2, cell_count, formula_count, key_cells, density FROM regions", recursive=True)
def flood_fill_blocks(spark, sf):
    return regions(spark, sf).select("wb", "sheet", "block_index", "annotation", "r1", "c1", "r2", "c2", "cell_count", "formula_count", "key_cells", "density")


def _candidates(role):
    def f(spark, sf):
        return tables.candidates(regions(spark, sf)).where(F.col("role") == role).select("wb", "sheet", "l_block_index", "d_block_index")

    f.__name__ = f"{role}_candidates"
    return query(f"SELECT wb, sheet, l_block_index, d_block_index FROM cand WHERE role = '{role}'", recursive=True)(f)


for _role in ("header", "row_label", "footer"):
    _candidates(_role)


@query()
def assemble_tables(spark, sf):
    return tables.assembled(annotated(spark, sf))


@query("SELECT wb, sheet, block_index, density FROM regions WHERE density < 0.8", recursive=True)
def light_blocks(spark, sf):
    return tables.light(regions(spark, sf)).select("wb", "sheet", "block_index", "density")


_BODIES = "SELECT wb, sheet, block_index AS structure, r1, c1, r2, c2 FROM regions WHERE annotation = 'data'"


@query("""SELECT wb, sheet, block_index, m.d::INT AS distance, m.s AS structure, m.r AS role FROM (
  SELECT wb, sheet, block_index, min(struct_pack(d := distance, s := structure, r := CASE WHEN ar1 > br2 THEN 'footer' WHEN ar2 < br1 THEN 'header' WHEN ac2 < bc1 THEN 'row_label' ELSE 'footer' END)) AS m FROM (
    SELECT a.wb, a.sheet, a.block_index, b.structure, a.r1 AS ar1, a.r2 AS ar2, a.c2 AS ac2, b.r1 AS br1, b.r2 AS br2, b.c1 AS bc1,
      greatest(0, greatest(a.r1 - b.r2, b.r1 - a.r2) - 1) + greatest(0, greatest(a.c1 - b.c2, b.c1 - a.c2) - 1) AS distance
    FROM regions a JOIN bodies b ON a.wb = b.wb AND a.sheet = b.sheet AND a.block_index != b.structure AND a.density < 0.8) WHERE distance <= 3 GROUP BY wb, sheet, block_index)""", recursive=True, bodies=_BODIES)
def nearest_structure(spark, sf):
    blocks = regions(spark, sf)
    bodies = blocks.where("annotation = 'data'").withColumn("structure", F.col("block_index"))
    return tables.nearest(tables.light(blocks), bodies)


@query()
def attach_light_blocks(spark, sf):
    return tables.attached(annotated(spark, sf))


@query()
def table_similarity(spark, sf):
    return tables.similar(annotated(spark, sf))


@query()
def table_groups(spark, sf):
    return tables.grouped(annotated(spark, sf))


@query()
def structure_tree(spark, sf):
    return tables.trees(annotated(spark, sf))


# ---- patterns: each conversation is a sheet with the role in its first column


def talks(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    row = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("int")
    x = c.withColumn("row", row)
    cells = x.select(F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("wb"), F.lit("talk").alias("sheet"), F.explode(F.array(grid.text(F.col("row"), 1, F.col("role")), grid.text(F.col("row"), 2, F.col("text")))).alias("c")).select("wb", "sheet", "c.*")
    bodies = layout.used_range(cells).select("wb", "sheet", F.lit(0).alias("body"), "r1", "c1", "r2", "c2")
    return cells, bodies


_TALK = {
    "turns": "SELECT 't' || conv_id AS wb, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS row, lower(trim(role)) AS v FROM conversations",
    "heights": "SELECT wb, max(row) AS n FROM turns GROUP BY wb HAVING max(row) >= 4",
    "factors": "SELECT wb, n, unnest(list_filter(range(2, n), lambda k: n % k = 0))::INT AS factor FROM heights",
    "stab": """SELECT wb, factor, round(avg((v = f)::INT), 6) AS stability FROM (
      SELECT t.wb, factor, v, (t.row - 1) // factor AS period, first_value(v) OVER (PARTITION BY t.wb, factor, (t.row - 1) % factor ORDER BY t.row) AS f FROM turns t JOIN factors USING (wb)) WHERE period > 0 GROUP BY wb, factor""",
    "best": "SELECT wb, arg_max(factor, struct_pack(s := stability, f := -factor)) AS factor, max(stability) AS s FROM stab GROUP BY wb HAVING max(stability) >= 0.8",
    "parts": "SELECT b.wb, b.factor, unnest(range(0, n // b.factor))::INT AS part FROM best b JOIN heights USING (wb)",
}


@query("SELECT wb, factor, stability FROM stab", **_TALK)
def pattern_stability(spark, sf):
    cells, bodies = talks(spark, sf)
    return tables.stability(bodies, cells).select("wb", "factor", "stability")


@query("SELECT wb, factor, part, (1 + part * factor)::INT AS r1, ((part + 1) * factor)::INT AS r2 FROM parts", **_TALK)
def pattern_split(spark, sf):
    cells, bodies = talks(spark, sf)
    return tables.pattern_split(bodies, cells).select("wb", "factor", "part", "r1", "r2")


@query("""SELECT t.wb, t.row FROM turns t JOIN best b USING (wb) JOIN (SELECT t.wb, (t.row - 1) % b.factor AS o FROM turns t JOIN best b USING (wb) GROUP BY ALL HAVING count(DISTINCT v) > 1) x
  ON x.wb = t.wb AND x.o = (t.row - 1) % b.factor""", **_TALK)
def reclassify_labels(spark, sf):
    cells, bodies = talks(spark, sf)
    return tables.varying_labels(tables.pattern_split(bodies, cells), cells).select("wb", "row")


# ---- formulas


@query("SELECT * FROM frefs")
def formula_refs(spark, sf):
    c = grid.statements(spark, sf).where("formula IS NOT NULL")
    return c.select("wb", "sheet", "row", "col", F.explode(refs.references("formula")).alias("ref"))


def _edges(spark, sf):
    return graph.edges(grid.statements(spark, sf))


@query("SELECT wb, sheet, row, col, ref, book, table_name, target_sheet, is_range, r1, c1, edge_type FROM edges")
def dependency_edges(spark, sf):
    return _edges(spark, sf).drop("r2", "c2")


@query("SELECT edge_type, count(*) AS n FROM edges GROUP BY ALL")
def edge_type_counts(spark, sf):
    return _edges(spark, sf).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("SELECT * FROM up2")
def upstream_2hop(spark, sf):
    return graph.upstream(_edges(spark, sf), 2)


@query("SELECT wb, to_sheet AS sheet, to_row AS row, to_col AS col, sheet AS user_sheet, row AS user_row, col AS user_col FROM hops")
def downstream_1hop(spark, sf):
    return graph.downstream(_edges(spark, sf), 1).drop("step")


@query("SELECT * FROM loops", recursive=True)
def circular_cells(spark, sf):
    return graph.cycles(_edges(spark, sf))


@query("SELECT * FROM degree")
def in_degree(spark, sf):
    return graph.in_degree(_edges(spark, sf))


@query()
def dependency_summary(spark, sf):
    cells = grid.statements(spark, sf)
    return graph.summary(layout.segment(cells), graph.edges(cells))


# ---- rendering and chunks


@query()
def render_text(spark, sf):
    cells = grid.statements(spark, sf)
    return render.text(None, cells)


@query()
def render_html(spark, sf):
    cells = layout.merge_flags(grid.statements(spark, sf), grid.status_merges(spark, sf))
    return render.html(None, cells)


@query()
def chunks(spark, sf):
    cells = grid.statements(spark, sf)
    return chunk.chunks(None, cells)


@query("SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn, (row_number() OVER w - 1)::INT AS chunk_index FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def chunk_nav(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return c.select("conv_id", "turn", F.lag("turn").over(w).alias("prev_turn"), F.lead("turn").over(w).alias("next_turn"), (F.row_number().over(w) - 1).cast("int").alias("chunk_index"))


@query("SELECT doc_id, greatest(length(text) // 4, 1) AS token_count, md5(text) AS content_hash, 'documents#' || source || '!' || doc_id AS source_uri FROM documents")
def chunk_tokens(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", a1.tokens("text").alias("token_count"), F.md5("text").alias("content_hash"), F.concat(F.lit("documents#"), "source", F.lit("!"), F.col("doc_id").cast("string")).alias("source_uri"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages")
def html_escape(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.md5(a1.html_escape("html")).alias("escaped"))


def _charts(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    r = spark.read.parquet(f"{sf}/region.parquet").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    series = F.array(F.struct(F.lit("nations").alias("name"), F.concat(F.lit("data!B2:B"), (F.col("n") + 1).cast("string")).alias("values_ref"), F.lit(None).cast("string").alias("categories_ref")))
    return r.select(F.lit("world").alias("wb"), F.lit("data").alias("sheet"), F.col("r_regionkey").cast("int").alias("chart_index"), F.lit("bar").alias("chart_type"), F.col("r_name").alias("title"), F.lit("nation").alias("x_title"), F.lit(None).cast("string").alias("y_title"), F.col("r_regionkey").cast("int").alias("from_row"), F.lit(3).alias("from_col"), (F.col("r_regionkey") + 10).cast("int").alias("to_row"), F.lit(9).alias("to_col"), series.alias("series"))


@query("SELECT r_regionkey::INT AS chart_index, 'Chart: ' || r_name || ' (bar)' || chr(10) || 'X axis: nation' || chr(10) || 'Series (1):' || chr(10) || '- nations: data!B2:B' || (count(*) + 1) AS summary, 'D' || (r_regionkey + 1) AS top_left, 'J' || (r_regionkey + 11) AS bottom_right FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def chart_chunks(spark, sf):
    return chunk.chart_summary(_charts(spark, sf)).select("chart_index", "summary", "top_left", "bottom_right")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, printf('%.0f%%', l_discount * 100) AS percent, format('{:,.2f}', l_extendedprice) AS money, printf('%.1f', l_tax) AS fixed FROM lineitem")
def display_format(spark, sf):
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    show = lambda c, f: formats.display(F.col(c), F.lit(f))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", show("l_discount", "0%").alias("percent"), show("l_extendedprice", "#,##0.00").alias("money"), show("l_tax", "0.0").alias("fixed"))


@query("SELECT vec_id AS id, label, len(embedding) AS dim FROM embeddings")
def vector_dims(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.size("embedding").cast("long").alias("dim"))


@query()
def vector_entries(spark, sf):
    cells = grid.statements(spark, sf)
    x = chunk.vector_entries(chunk.chunks(None, cells, with_html=False), graph.summary(layout.segment(cells), graph.edges(cells)))
    return x.select("id", "text", "metadata.*")


@query("SELECT wb, count(DISTINCT sheet) AS sheets, count(*) AS cells, count(formula) AS formulas FROM cells GROUP BY wb")
def workbook_record(spark, sf):
    return grid.statements(spark, sf).groupBy("wb").agg(F.count_distinct("sheet").alias("sheets"), F.count("*").alias("cells"), F.count("formula").alias("formulas"))


@query(f"SELECT u.wb, u.sheet, {sql.rect('u.')} AS used_range, u.cells, coalesce(string_agg({sql.rect('m.')}, ',' ORDER BY m.r1), '') AS merged FROM used u LEFT JOIN merges m ON m.wb = u.wb AND m.sheet = u.sheet GROUP BY ALL")
def sheet_records(spark, sf):
    u = layout.used_range(grid.statements(spark, sf))
    m = grid.status_merges(spark, sf).groupBy("wb", "sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r1", a1.rect("r1", "c1", "r2", "c2").alias("t")))), lambda v: v["t"]), ",").alias("merged"))
    return u.join(m, ["wb", "sheet"], "left").select("wb", "sheet", a1.rect("r1", "c1", "r2", "c2").alias("used_range"), "cells", F.coalesce("merged", F.lit("")).alias("merged"))


# ---- templates: every customer's workbook is a document


_SPECS = {
    "specs": """SELECT wb, sheet, row, col, CASE WHEN formula IS NOT NULL THEN 'formula' WHEN annotation = 'label' THEN 'constant' ELSE 'dof' END AS dof_type,
      CASE WHEN formula IS NULL AND annotation = 'label' THEN raw END AS constant, formula, CASE WHEN formula IS NULL AND annotation != 'label' THEN CASE WHEN kind IN ('i', 'f') THEN 'number' WHEN kind = 'b' THEN 'boolean' ELSE 'string' END END AS hint FROM ann""",
    "cmp": """SELECT *, CASE WHEN documents = 1 THEN least WHEN types = 1 AND least = 'constant' AND lowest IS NOT DISTINCT FROM highest THEN 'constant' WHEN types = 1 AND least = 'formula' THEN 'formula' ELSE 'dof' END AS dof_type,
      documents > 1 AND NOT any_dof AND ((types = 1 AND least = 'constant' AND lowest IS DISTINCT FROM highest) OR types > 1) AS conflict FROM (
      SELECT sheet, row, col, count(DISTINCT wb) AS documents, count(DISTINCT dof_type) AS types, bool_or(dof_type = 'dof') AS any_dof, min(dof_type) AS least, min(constant) AS lowest, max(constant) AS highest,
        arg_min(coalesce(formula, '~'), wb) AS f FROM specs GROUP BY sheet, row, col)""",
    "tpl": "SELECT sheet, row, col, documents, dof_type, CASE WHEN dof_type = 'constant' THEN lowest END AS constant, CASE WHEN dof_type = 'formula' THEN f END AS formula, conflict FROM cmp",
}


@query("SELECT * FROM specs", **_SPECS)
def template_specs(spark, sf):
    return template.specs(annotated(spark, sf))


def _template(spark, sf):
    return template.compare(template.specs(annotated(spark, sf)))


@query("SELECT * FROM tpl", **_SPECS)
def template_compare(spark, sf):
    return _template(spark, sf)


@query("SELECT s.sheet, s.row, s.col, coalesce(s.constant, s.dof_type) AS value, count(*) AS documents FROM specs s JOIN tpl t ON t.sheet = s.sheet AND t.row = s.row AND t.col = s.col WHERE t.conflict GROUP BY ALL", **_SPECS)
def template_conflicts(spark, sf):
    return template.conflicts(template.specs(annotated(spark, sf)))


@query("SELECT sheet, 'used' AS node, 'row_count' AS constraint, CASE WHEN a = b THEN a END AS expected, CASE WHEN a != b THEN a END AS least, CASE WHEN a != b THEN b END AS most FROM (SELECT sheet, min(r2 - r1 + 1)::BIGINT AS a, max(r2 - r1 + 1)::BIGINT AS b FROM used GROUP BY sheet) UNION ALL SELECT sheet, 'used', 'col_count', CASE WHEN a = b THEN a END, CASE WHEN a != b THEN a END, CASE WHEN a != b THEN b END FROM (SELECT sheet, min(c2 - c1 + 1)::BIGINT AS a, max(c2 - c1 + 1)::BIGINT AS b FROM used GROUP BY sheet)")
def constraint_merge(spark, sf):
    nodes = layout.used_range(grid.statements(spark, sf)).withColumn("node", F.lit("used"))
    return template.merge_constraints(template.constraints(nodes))


@query("SELECT wb, sheet, 'row_count' AS constraint, (r2 - r1 + 1)::BIGINT AS expected FROM used UNION ALL SELECT wb, sheet, 'col_count', (c2 - c1 + 1)::BIGINT FROM used")
def template_constraints(spark, sf):
    nodes = layout.used_range(grid.statements(spark, sf)).withColumn("node", F.lit("used"))
    return template.constraints(nodes).drop("node")


@query("""SELECT b.wb, t.sheet, t.row, t.col, t.constant AS expected, c.raw AS found, CASE WHEN c.raw IS NULL THEN 'missing_cell' ELSE 'mismatch' END AS problem
  FROM (SELECT DISTINCT wb FROM cells) b CROSS JOIN (SELECT * FROM tpl WHERE dof_type = 'constant') t LEFT JOIN cells c ON c.wb = b.wb AND c.sheet = t.sheet AND c.row = t.row AND c.col = t.col WHERE c.raw IS DISTINCT FROM t.constant""", **_SPECS)
def template_validate(spark, sf):
    return template.validate(_template(spark, sf), grid.statements(spark, sf))


@query("SELECT c.wb, c.sheet, c.row, c.col, c.kind, c.raw FROM cells c JOIN tpl t ON t.sheet = c.sheet AND t.row = c.row AND t.col = c.col WHERE t.dof_type = 'dof'", **_SPECS)
def template_extract(spark, sf):
    return template.extract(_template(spark, sf), grid.statements(spark, sf))


# ---- artefacts and quality


_KPI = {
    "named": """SELECT *, coalesce(CASE WHEN lag(col) OVER l = col - 1 AND lag(kind) OVER l = 's' THEN lag(raw) OVER l END, CASE WHEN lag(row) OVER u = row - 1 AND lag(kind) OVER u = 's' THEN lag(raw) OVER u END) AS label
      FROM cells WINDOW l AS (PARTITION BY wb, sheet, row ORDER BY col), u AS (PARTITION BY wb, sheet, col ORDER BY row)""",
    "kpi": f"""SELECT wb, sheet, row, col, label, score::INT AS score, d AS in_degree, sheet || '!' || {sql.coord('row', 'col')} AS cell_ref FROM (SELECT n.*, d, CASE WHEN d >= 5 THEN 4 WHEN d >= 3 THEN 3 WHEN d >= 1 THEN 1 ELSE 0 END
      + CASE WHEN formula IS NOT NULL AND bold THEN 2 ELSE 0 END + CASE WHEN number_format LIKE '%$%' THEN 2 WHEN number_format LIKE '%\\%%' ESCAPE '\\' THEN 1 ELSE 0 END + CASE WHEN font_size >= 14 THEN 1 ELSE 0 END AS score
      FROM (SELECT n.*, coalesce(g.in_degree, 0) AS d FROM named n LEFT JOIN degree g USING (wb, sheet, row, col)) n) WHERE score >= 3""",
}


def _kpis(spark, sf):
    cells = grid.statements(spark, sf)
    return artifacts.kpis(cells, graph.edges(cells))


@query("SELECT * FROM kpi", **_KPI)
def kpi_catalog(spark, sf):
    return _kpis(spark, sf)


@query("SELECT * FROM (SELECT k.wb, k.sheet, k.row, k.col, e.ref, row_number() OVER (PARTITION BY k.wb, k.sheet, k.row, k.col ORDER BY e.ref)::INT AS rank FROM kpi k JOIN edges e USING (wb, sheet, row, col)) WHERE rank <= 5", **_KPI)
def kpi_drivers(spark, sf):
    return artifacts.drivers(_kpis(spark, sf), _edges(spark, sf))


@query("""SELECT wb, sheet, n AS total_cells, f AS formula_count, round(d, 4) AS formula_density, CASE WHEN b.s >= 0.1 THEN b.p ELSE 'unknown' END AS purpose, CASE WHEN b.s >= 0.1 THEN least(b.s, 1) ELSE 0 END::DOUBLE AS confidence FROM (
  SELECT *, list_max([struct_pack(s := round((d < 0.05 AND n > 20)::INT * 0.5 + (d < 0.01 AND n > 50)::INT * 0.3, 2)::DOUBLE, k := -1, p := 'raw_data'), struct_pack(s := CASE WHEN x > 3 THEN 0.7 WHEN x > 0 THEN 0.3 ELSE 0 END::DOUBLE, k := -2, p := 'lookup'),
    struct_pack(s := round((d > 0.3)::INT * 0.5 + (d > 0.5)::INT * 0.3, 2)::DOUBLE, k := -3, p := 'calculation'), struct_pack(s := CASE WHEN n < 15 THEN 0.3 ELSE 0 END::DOUBLE, k := -7, p := 'config')]) AS b FROM (
    SELECT c.wb, c.sheet, count(*) AS n, count(formula) AS f, count(formula) / count(*)::DOUBLE AS d, any_value(coalesce(x, 0)) AS x FROM cells c LEFT JOIN (SELECT wb, target_sheet AS sheet, count(*) AS x FROM edges WHERE edge_type = 'cross_sheet' GROUP BY ALL) e USING (wb, sheet) GROUP BY c.wb, c.sheet))""")
def sheet_purpose(spark, sf):
    cells = grid.statements(spark, sf)
    return artifacts.purposes(cells, graph.edges(cells))


@query()
def sheet_summary(spark, sf):
    cells = grid.statements(spark, sf)
    return artifacts.summary_text(artifacts.purposes(cells, graph.edges(cells)), _kpis(spark, sf))


@query(f"SELECT wb, lower(trim(raw)) AS key, arg_min(trim(raw), struct_pack(s := sheet, r := row, c := col)) AS name, count(*) AS places, CASE WHEN regexp_matches(lower(trim(raw)), '{artifacts.MEASURES}') THEN 'measure' ELSE 'dimension' END AS category FROM cells WHERE bold AND kind = 's' AND length(trim(raw)) BETWEEN 2 AND 49 GROUP BY ALL")
def entity_index(spark, sf):
    return artifacts.entities(grid.statements(spark, sf))


@query("SELECT wb, sheet, string_agg(line, chr(10) ORDER BY row) AS text FROM (SELECT wb, sheet, row, string_agg(coalesce(raw, '=' || formula), ' | ' ORDER BY col) AS line FROM cells GROUP BY ALL) GROUP BY ALL")
def linearize_sheet(spark, sf):
    return artifacts.linearize(grid.statements(spark, sf))


@query("SELECT block_type, sheet, count(*) AS n FROM comps GROUP BY GROUPING SETS ((block_type), (block_type, sheet))")
def block_type_counts(spark, sf):
    x = layout.classified(grid.statements(spark, sf))
    x.createOrReplaceTempView("_components")
    return spark.sql("SELECT block_type, sheet, count(*) AS n FROM _components GROUP BY GROUPING SETS ((block_type), (block_type, sheet))")


@query()
def stage_metrics(spark, sf):
    cells = grid.statements(spark, sf)
    return artifacts.stage_metrics(cells, annotate.annotate(cells), layout.segment(cells), graph.edges(cells))


@query("SELECT unnest(['unique_places', 'ranges_ordered', 'block_index_dense', 'edges_resolved', 'external_has_book', 'cells_in_blocks']) AS invariant, 0::BIGINT AS violations")
def invariants(spark, sf):
    cells = grid.statements(spark, sf)
    return artifacts.invariants(cells, layout.segment(cells), graph.edges(cells))


@query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS sd, round(stddev_pop(n_chars) / avg(n_chars), 6) AS cv FROM documents GROUP BY ALL")
def scorecard(spark, sf):
    return artifacts.scorecard(spark.read.parquet(f"{sf}/documents.parquet"), ["lang", "source"], "n_chars")


@query("SELECT event_type, count(*) AS n, list_sort(list(value))[floor(count(*) * 0.5)::INT + 1] AS p50, list_sort(list(value))[floor(count(*) * 0.95)::INT + 1] AS p95, list_sort(list(value))[floor(count(*) * 0.99)::INT + 1] AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def perf_percentiles(spark, sf):
    return artifacts.index_percentiles(spark.read.parquet(f"{sf}/events.parquet"), ["event_type"], "value")


@query("SELECT p_partkey, a, b FROM (SELECT l_partkey AS p_partkey, avg(l_extendedprice / l_quantity) AS a, any_value(p_retailprice) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey) WHERE abs(a - b) > 1 AND abs(a - b) > 0.05 * greatest(abs(a), abs(b))")
def drift(spark, sf):
    a = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    b = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_retailprice").alias("v"))
    return artifacts.drift(a, b, ["p_partkey"], "v", 1.0, 0.05)
