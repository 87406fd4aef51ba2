"""DataFrames as sheets.

``sheet_of`` turns any DataFrame into cells: a bold header in row 1, a row for each record in the order of a key.  ``statements`` makes one workbook for each
customer, with a sheet of orders in runs of one status and a summary sheet with formulas; all work is partitioned by workbook, so no sheet grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats

GAP = 2
#: Bytes of the orders table (stored) for a partition of workbooks at most: about 50 000 orders.
PART_BYTES = 1 << 20
_FIELDS = ("row", "col", "kind", "raw", "num", "formula", "bold", "fill", "font_size", "number_format")
_TYPES = {"row": "int", "col": "int", "num": "double", "bold": "boolean", "font_size": "double"}


def cell(**values) -> Column:
    """One cell; what isn't given is null, and not bold."""
    values = {"bold": F.lit(False), **values}
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*(as_column(values.get(f)).cast(_TYPES.get(f, "string")).alias(f) for f in _FIELDS))


def text(row, col, value, **more) -> Column:
    return cell(row=row, col=col, kind="s", raw=value, **more)


def sheet_of(df: DataFrame, order: list[str], wb: Column | str = "book", sheet: str = "data", by: list[str] | None = None) -> DataFrame:
    """Cells of a DataFrame; by: columns whose values make separate workbooks (else all is one sheet)."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    n = F.row_number().over(w) + 1
    kind = {"string": "s", "bigint": "i", "int": "i", "double": "f", "float": "f", "boolean": "b"}
    columns = [c for c in df.columns if c not in (by or [])]
    body = df.withColumn("_r", n)
    cells = []
    for k, c in enumerate(columns, 1):
        t = kind.get(dict(df.dtypes)[c], "s")
        cells.append(cell(row=F.col("_r"), col=k, kind=t, raw=F.col(c).cast("string"), num=F.col(c).cast("double") if t in "if" else None))
    head = [text(1, k, c, bold=True) for k, c in enumerate(columns, 1)]
    every = F.concat(F.array(*cells), F.when(F.col("_r") == 2, F.array(*head)).otherwise(F.array().cast("array<struct<row:int,col:int,kind:string,raw:string,num:double,formula:string,bold:boolean,fill:string,font_size:double,number_format:string>>")))
    name = wb if isinstance(wb, Column) else F.lit(wb)
    return body.select(name.alias("wb"), F.lit(sheet).alias("sheet"), F.explode(every).alias("c")).select("wb", "sheet", "c.*").where("raw IS NOT NULL")


def by_workbook(df: DataFrame) -> DataFrame:
    """df (with wb) in as many partitions of whole workbooks as its size asks for, so that a task's share doesn't grow with the data.

    What is made of it stays where it is: windows and aggregates by (wb, ...) need no exchange, and with the setting below joins on (wb, ...) need none either.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)), "wb")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their row in the customer's sheet: runs of one status, GAP blank rows between runs."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    o = by_workbook(o.withColumn("wb", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))))
    w = Window.partitionBy("wb").orderBy("o_orderkey")
    o = o.withColumn("rn", F.row_number().over(w)).withColumn("new", (F.col("o_orderstatus") != F.lag("o_orderstatus").over(w)).cast("int"))
    o = o.withColumn("run", F.coalesce(F.sum("new").over(w), F.lit(0)).cast("int"))
    o = o.withColumn("first", (F.coalesce(F.col("new"), F.lit(1)) == 1)).withColumn("row", (1 + F.col("rn") + GAP * F.col("run")).cast("int"))
    return o.withColumn("last", F.coalesce(F.lead("new").over(w), F.lit(1)) == 1)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of one workbook for each customer with orders: sheets orders and summary.

    All cells of a workbook are made beside its orders in one pass: those of the whole workbook with its last order.
    """
    r, fill = F.col("row"), F.when(F.col("o_orderstatus") == "F", "FFC7CE").when(F.col("o_orderstatus") == "O", "C6EFCE")
    money, at = "$#,##0.00", F.col("row").cast("string")
    data = [
        cell(row=r, col=1, kind="i", raw=F.col("o_orderkey").cast("string"), num=F.col("o_orderkey"), fill=fill),
        text(r, 2, F.col("o_orderstatus"), fill=fill),
        cell(row=r, col=3, kind="f", raw=formats.fixed2("o_totalprice"), num=formats.round2("o_totalprice"), fill=fill, number_format="#,##0.00"),
        text(r, 4, F.date_format("o_orderdate", "yyyy-MM-dd"), fill=fill),
        text(r, 5, F.col("o_orderpriority"), fill=fill),
        cell(row=r, col=7, kind="n", formula=F.concat(F.lit("C"), at, F.lit("*summary!B4")), number_format=money),
        cell(row=r, col=8, kind="n", formula=F.when(F.col("first"), F.concat(F.lit("C"), at)).otherwise(F.concat(F.lit("H"), (r - 1).cast("string"), F.lit("+C"), at)), bold=F.col("last"), number_format=money),
    ]
    head = [text(1, k, t, bold=True) for k, t in ((1, "order id"), (2, "status"), (3, "price"), (4, "date"), (5, "priority"), (7, "tax"), (8, "total"))]
    total = F.concat(F.lit("SUM(orders!C2:C"), at, F.lit(")"))

    def about(c):
        loop = [cell(row=1, col=4, kind="n", formula="D2+1"), cell(row=2, col=4, kind="n", formula="E2"), cell(row=2, col=5, kind="n", formula="D1"), cell(row=3, col=4, kind="n", formula="D3")]
        loop = F.when(c["bal"] < 0, F.array(*loop)).when(c["bal"] >= 0, F.array(cell(row=1, col=4, kind="n", formula="B2*2"))).otherwise(F.slice(F.array(loop[0]), 1, 0))
        return F.concat(F.array(
            text(1, 1, "customer name", bold=True), text(1, 2, c["c_name"], font_size=14.0),
            text(2, 1, "account balance", bold=True), cell(row=2, col=2, kind="f", raw=c["raw"], num=c["bal"], number_format=money),
            text(3, 1, "orders total", bold=True), cell(row=3, col=2, kind="n", formula=total, bold=True, number_format=money),
            text(4, 1, "tax rate assumption", bold=True), cell(row=4, col=2, kind="f", raw="0.1", num=0.1, number_format="0.0%"),
            text(5, 1, "exchange rate", bold=True), cell(row=5, col=2, kind="n", formula="[rates.xlsx]Daily!B2+SUM(Sales[price])"),
            text(6, 1, "segment", bold=True), text(6, 2, c["c_mktsegment"]),
        ), loop)

    rows = order_rows(spark, sf_dir).withColumn("final", F.lead(F.lit(1)).over(Window.partitionBy("wb").orderBy("o_orderkey")).isNull())
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("bal", formats.round2("c_acctbal"))
    customer = customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("wb"), F.struct("c_name", "bal", formats.fixed2("bal").alias("raw"), "c_mktsegment").alias("c"))
    rows = rows.join(customer.groupBy("wb").agg(F.collect_list("c").alias("customers")), "wb", "left")
    tagged = lambda sheet, cells: F.struct(F.lit(sheet).alias("sheet"), cells.alias("cells"))
    whole = F.when(F.col("final"), F.array(tagged("orders", F.array(*head)), tagged("summary", F.coalesce(F.flatten(F.transform("customers", about)), F.slice(F.array(*head), 1, 0)))))
    every = F.concat(F.array(tagged("orders", F.array(*data))), F.coalesce(whole, F.slice(F.array(tagged("orders", F.array(*head))), 1, 0)))
    return rows.select("wb", F.explode(every).alias("s")).select("wb", "s.sheet", F.explode("s.cells").alias("c")).select("wb", "sheet", "c.*")


def status_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status column's cells of every run of two rows or more are merged."""
    runs = order_rows(spark, sf_dir).groupBy("wb", "run").agg(F.min("row").alias("r1"), F.max("row").alias("r2")).where("r2 > r1")
    return runs.select("wb", F.lit("orders").alias("sheet"), "r1", F.lit(2).alias("c1"), "r2", F.lit(2).alias("c2"))


def finished_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of status F as declared tables over columns A to E."""
    runs = order_rows(spark, sf_dir).where("o_orderstatus = 'F'").groupBy("wb", "run").agg(F.min("row").alias("r1"), F.max("row").alias("r2"))
    return runs.select("wb", F.lit("orders").alias("sheet"), F.concat(F.lit("done"), F.col("run").cast("string")).alias("table_name"), "r1", F.lit(1).alias("c1"), "r2", F.lit(5).alias("c2"))
