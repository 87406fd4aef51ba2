"""Exact top-k search: block-at-a-time pruning.

Vectors are packed in document ranges, a range in blocks of ``BLOCK`` rows with the least and the greatest value of each term.  A query bounds its
score in a block by summing, term by term, what the block's extremes allow; it takes blocks by falling bound and scores them through the block's
forward index (a small matrix), until the next bound is below its k-th score.  Equal bounds are still scored, so ties come out right.

Ranges meet query blocks by an equi-join on buckets of ranges, to each of which the stated queries go; each range returns k rows a query, and these are ranked.  The work is queries times rows
at worst, as exact search has it.

Defined results: rows with a null id, or a null vector, or a null or non-finite component, take no part; shorter vectors count as padded with zeros;
a query's own row is left out, another row of the same id isn't; ties go to smaller ids, then to the row read first; extra columns are ignored; fewer
than k candidates give fewer rows, an empty table none.  Scores are 64-bit integers; components are clipped to 63 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, store

RANGE, BLOCK, QUERY_BLOCK = 8192, 256, 4096


def _packed(df: DataFrame, size: int) -> DataFrame:
    """id, row, v (array<long>) to rows of up to size vectors: ids, rows, values (packed 64-bit), dim."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = batch.column(2)
            sizes = np.diff(np.asarray(vectors.offsets))
            flat, dim = np.asarray(vectors.flatten()), int(sizes.max(initial=0))
            matrix = np.zeros((len(ids), dim), np.int64)
            matrix[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            step = max(BLOCK, min(size, (32 << 20) // (8 * max(1, dim))))
            for k in range(0, len(ids), step):
                yield pa.RecordBatch.from_arrays([pa.array([ids[k : k + step].tobytes()]), pa.array([rows[k : k + step].tobytes()]), pa.array([matrix[k : k + step].tobytes()]), pa.array([dim])], ["ids", "rows", "values", "dim"])

    return df.select("id", "row", "v").mapInArrow(run, "ids binary, rows binary, values binary, dim long")


def search(q: np.ndarray, q_rows: np.ndarray, v: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query index, place of the vector and score of the best k of v for every query, by (score desc, id, row)."""
    dim = max(q.shape[1], v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, v))
    order = np.lexsort((rows, ids))
    v, ids, rows = v[order], ids[order], rows[order]
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * dim
    if top < 2.0**52:  # exact in doubles
        q, v = q.astype(np.float64), v.astype(np.float64)
    firsts = np.arange(0, len(v), block)
    high, low = np.maximum.reduceat(v, firsts, axis=0), np.minimum.reduceat(v, firsts, axis=0)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T if top < 2.0**52 else np.full((len(q), len(firsts)), np.iinfo(np.int64).max)
    turn = np.argsort(-bounds, axis=1, kind="stable")
    least = np.full(len(q), -np.inf)
    none = np.zeros(0, np.int64)
    who, at, got = none, none, np.zeros(0, v.dtype)
    for step in range(len(firsts)):
        following = turn[:, step]
        on = np.flatnonzero(bounds[np.arange(len(q)), following] >= least)
        if not len(on):
            break
        new = [(who, at, got)]
        by = on[np.argsort(following[on], kind="stable")]
        for part in np.split(by, np.flatnonzero(np.diff(following[by])) + 1):
            first = firsts[following[part[0]]]
            scores = q[part] @ v[first : first + block].T
            mine = (scores >= least[part, None]) & (rows[first : first + block] != q_rows[part, None])
            a, b = np.nonzero(mine)
            new.append((part[a], first + b, scores[a, b]))
        who, at, got = (np.concatenate(x) for x in zip(*new, strict=True))
        best = np.lexsort((at, -got, who))
        who, at, got = who[best], at[best], got[best]
        start = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
        place = np.arange(len(who)) - np.maximum.accumulate(np.where(start, np.arange(len(who)), 0)) if len(who) else none
        keep = place < k
        last = place == k - 1
        least[who[last]] = got[last]
        who, at, got = who[keep], at[keep], got[keep]
    return who, order[at], got.astype(np.int64)


def top_k(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for every row that is_query says (a column) against all rows."""
    spark = df.sparkSession
    top = float((1 << 63) - 1024)
    whole = F.transform(F.col(vector_col), lambda x: F.greatest(F.lit(-top), F.least(F.lit(top), F.floor(x.cast("double") * scale).cast("double"))).cast("long"))
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.withColumn("row", F.monotonically_increasing_id()).where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    rows = store(rows.select(F.col(id_col).cast("long").alias("id"), "row", whole.alias("v"), is_query.alias("q")), "vectors")
    ranges = store(_packed(rows, RANGE).withColumn("range", F.monotonically_increasing_id()), "ranges")
    asked = _packed(rows.where("q").coalesce(1) if rows.where("q").limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK else rows.where("q"), QUERY_BLOCK).select(F.col("ids").alias("qids"), F.col("rows").alias("qrows"), F.col("values").alias("qvalues"), F.col("dim").alias("qdim"))
    buckets = max(1, ranges.count())  # one for each range, about
    asked = asked.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    ranges = ranges.withColumn("bucket", F.pmod(F.xxhash64("range"), F.lit(buckets)).cast("int"))
    pairs = ranges.join(asked, "bucket").select("ids", "rows", "values", "dim", "qids", "qrows", "qvalues", "qdim")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, rs, values, dim, qids, qrs, qvalues, qdim = (batch.column(c)[r].as_py() for c in range(8))
                ids, rs, qids, qrs = (np.frombuffer(x, np.int64) for x in (ids, rs, qids, qrs))
                v = np.frombuffer(values, np.int64).reshape(len(ids), dim)
                q = np.frombuffer(qvalues, np.int64).reshape(len(qids), qdim)
                who, at, got = search(q, qrs, v, ids, rs, k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[who]), pa.array(qrs[who]), pa.array(ids[at]), pa.array(rs[at]), pa.array(got)], ["query_id", "qrow", "vec_id", "row", "score"])

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    found = pairs.mapInArrow(run, "query_id long, qrow long, vec_id long, row long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "qrow").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op2_topk": op2_topk}
ORACLE = {
    "op2_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id != q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
