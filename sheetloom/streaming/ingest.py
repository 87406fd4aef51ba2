"""A drop folder of workbook files as a stream: each file is parsed once, and chunks are written by key."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunk, layout
from ..sources.ooxml import TABLES, _columns, parse


def stream_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of files as they arrive; no state is kept but the list of files seen."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.xls[xm]").load(path).select("path", "content")
    names = _columns(TABLES["cells"])

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(parse(content, p)["cells"], columns=names, dtype=object)

    return files.mapInPandas(run, TABLES["cells"])


def write_chunks(cells: DataFrame, target: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Segments and renders each batch of whole workbooks; chunk ids are hashes, so a batch that runs again writes the same folder again."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch = batch.dropDuplicates(["wb", "sheet", "row", "col"])
        made = chunk.chunks(layout.segment(batch), batch)
        made.write.mode("overwrite").parquet(f"{target}/batch={epoch}")
        if then:
            then(made, epoch)

    return cells.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
