"""Templates: what is fixed, filled in or computed in a document's cells; comparison over documents; validation and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import a1
from .layout import KEY

MOST_DOFS = 50


def specs(annotated: DataFrame) -> DataFrame:
    """Each cell as formula, constant (labels) or dof (with the type of what is filled in)."""
    dof = F.when(F.col("formula").isNotNull(), "formula").when(F.col("annotation") == "label", "constant").otherwise("dof")
    hint = F.when(dof == "dof", F.when(F.col("kind").isin("i", "f"), "number").when(F.col("kind") == "b", "boolean").otherwise("string"))
    return annotated.select(*KEY, "row", "col", dof.alias("dof_type"), F.when(dof == "constant", F.col("raw")).alias("constant"), F.when(dof == "formula", F.col("formula")).alias("formula"), hint.alias("hint"))


def node_specs(nodes: DataFrame, annotated: DataFrame) -> DataFrame:
    """Specs of the cells in each node's range (wb, sheet, node, r1, c1, r2, c2)."""
    return nodes.join(specs(annotated), KEY).where(a1.inside("row", "col", "r1", "c1", "r2", "c2")).select(*KEY, "node", "row", "col", "dof_type", "constant", "formula", "hint")


def constraints(nodes: DataFrame, sub_tables: DataFrame | None = None) -> DataFrame:
    """Expected rows and columns of each node, and tables in a group (wb, sheet, node, n)."""
    pairs = F.array(F.struct(F.lit("row_count").alias("constraint"), (F.col("r2") - F.col("r1") + 1).cast("long").alias("expected")), F.struct(F.lit("col_count").alias("constraint"), (F.col("c2") - F.col("c1") + 1).cast("long").alias("expected")))
    out = nodes.select(*KEY, "node", F.explode(pairs).alias("x")).select(*KEY, "node", "x.*")
    return out if sub_tables is None else out.unionByName(sub_tables.select(*KEY, "node", F.lit("sub_table_count").alias("constraint"), F.col("n").cast("long").alias("expected")))


def compare(spec: DataFrame) -> DataFrame:
    """Consensus for each place over all documents: only counts and extremes are kept, so a place may be in every document."""
    bit = F.when(F.col("dof_type") == "dof", 1).when(F.col("dof_type") == "constant", 2).otherwise(4)
    # first each document's places, which lie together and sorted, then places over documents: no row for each document is moved
    own = spec.groupBy(*KEY, "row", "col").agg(F.bit_or(bit).alias("bits"), F.min("dof_type").alias("least"), F.min("constant").alias("lowest"), F.max("constant").alias("highest"), F.min(F.struct("formula")).alias("f"))
    g = own.groupBy("sheet", "row", "col").agg(
        F.count("wb").alias("documents"), F.bit_or("bits").alias("bits"), F.min("least").alias("least"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.min(F.struct("wb", "f.formula")).alias("first"),
    )
    g = g.withColumn("types", F.bit_count("bits")).withColumn("any_dof", F.col("bits").bitwiseAND(1) > 0)
    same = (F.col("types") == 1) & (F.col("least") == "constant") & F.col("lowest").eqNullSafe(F.col("highest"))
    kind = F.when(F.col("documents") == 1, F.col("least")).when(same, "constant").when((F.col("types") == 1) & (F.col("least") == "formula"), "formula").otherwise("dof")
    clash = (F.col("documents") > 1) & ~F.col("any_dof") & (((F.col("types") == 1) & (F.col("least") == "constant") & ~same) | (F.col("types") > 1))
    return g.select("sheet", "row", "col", "documents", kind.alias("dof_type"), F.when(kind == "constant", F.col("lowest")).alias("constant"), F.when(kind == "formula", F.col("first.formula")).alias("formula"), clash.alias("conflict"))


def conflicts(spec: DataFrame) -> DataFrame:
    """The different values of each place that lost its consensus, one row for each, with how many documents have it."""
    lost = compare(spec).where("conflict").select("sheet", "row", "col")
    counted = spec.groupBy("sheet", "row", "col", F.coalesce("constant", "dof_type").alias("value")).agg(F.count("*").alias("documents"))
    return counted.join(lost, ["sheet", "row", "col"])


def merge_constraints(found: DataFrame) -> DataFrame:
    """Over documents: one expected value if all agree, else least and most."""
    g = found.groupBy("sheet", "node", "constraint").agg(F.min("expected").alias("low"), F.max("expected").alias("high"))
    same = F.col("low") == F.col("high")
    return g.select("sheet", "node", "constraint", F.when(same, F.col("low")).alias("expected"), F.when(~same, F.col("low")).alias("least"), F.when(~same, F.col("high")).alias("most"))


def validate(template: DataFrame, cells: DataFrame) -> DataFrame:
    """For every workbook: template constants whose sheet is missing, whose cell is missing or whose text differs."""
    const = template.where("dof_type = 'constant'").select("sheet", "row", "col", F.col("constant").alias("expected"))
    place = F.struct("sheet", "row", "col", "expected")
    found = cells.select(*KEY, "row", "col", "raw").join(F.broadcast(const.withColumn("wanted", F.lit(True))), ["sheet", "row", "col"], "left")
    books = found.groupBy("wb").agg(F.collect_list(F.when(F.col("wanted"), F.struct("sheet", "row", "col", "expected", F.col("raw").alias("found")))).alias("has"), F.collect_set("sheet").alias("sheets"))
    x = books.crossJoin(F.broadcast(const.agg(F.collect_list(place).alias("all"))))  # one document's places
    as_place = lambda v: F.struct(v["sheet"].alias("sheet"), v["row"].alias("row"), v["col"].alias("col"), v["expected"].alias("expected"))
    missing = F.transform(F.array_except("all", F.transform("has", as_place)), lambda v: v.withField("found", F.lit(None).cast("string")))
    x = x.select("wb", "sheets", F.explode(F.concat(F.col("has"), missing)).alias("x")).select("wb", "sheets", "x.*").where("found IS DISTINCT FROM expected")
    problem = F.when(~F.array_contains("sheets", F.col("sheet")), "missing_sheet").when(F.col("found").isNull(), "missing_cell").otherwise("mismatch")
    return x.select(*KEY, "row", "col", "expected", "found", problem.alias("problem"))


def extract(template: DataFrame, cells: DataFrame) -> DataFrame:
    """What each workbook has at the places that are filled in; those, one document's at most, go to the cells."""
    dof = template.where("dof_type = 'dof'").select("sheet", "row", "col")
    return cells.join(F.broadcast(dof), ["sheet", "row", "col"]).select(*KEY, "row", "col", "kind", "raw")


def importer_source(template: DataFrame, name: str = "Importer") -> str:
    """A Python class that holds a template's constants, places to fill and formulas; templates are as small as one document."""
    rows = template.orderBy("sheet", "row", "col").collect()
    part = lambda kind, value: {(r["sheet"], r["row"], r["col"]): value(r) for r in rows if r["dof_type"] == kind}
    body = {"constants": part("constant", lambda r: r["constant"]), "dofs": [*part("dof", lambda r: None)], "formulas": part("formula", lambda r: r["formula"])}
    return f"class {name}:\n" + "".join(f"    {k} = {v!r}\n" for k, v in body.items())
