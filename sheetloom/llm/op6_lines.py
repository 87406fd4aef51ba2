"""Line dedup: deletion-neighbourhood join within edit distance 1.

A line of at least ``min_chars`` characters goes if it occurred before, or if an earlier line of another text is within one insertion, deletion or
substitution.  Earlier: by (doc_id, row, line).  Other lines stay as they are.

Lines that differ by one edit agree on all that is left when the block that holds the edit is deleted.  So deletions go from coarse to fine, as
hashed keys: first each half is deleted, and lines that share no such variant with any other line are done; then each of 16 blocks; then, only in the
blocks that lines share a variant of, each single character.  Equal variants are joined, hits are verified by edit distance, the earliest line stays.
Among lines that are equal but for the same deleted place all are one edit apart, so the earliest of a key stands for all pairs of it: groups are
only aggregated, never expanded or capped.

Defined results: null text stays null, an empty text stays empty; a text of which no line stays becomes empty; repeated rows lose their lines as
any later copy; extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, bounded_batches, by_part, mix, powers, read, store
from .op5_bpe import slices

MIN_CHARS = 24
HALVES, BLOCKS = 2, 16
_M = np.uint64(0xC2B2AE3D27D4EB4F)


class Hashed:
    """Prefix sums over the characters of some lines, which give the hash of any stretch of a line at once."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.codes)
        self.one = np.zeros(n + 1, np.uint64)
        np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * powers(n), out=self.one[1:])

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sum over [a, b) of (code + 1) * BASE**(place - a)."""
        return (self.one[b] - self.one[a]) * powers(len(self.one), inverse=True)[a]

    def without(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> np.ndarray:
        """Hash of [a, b) without [cut_a, cut_b)."""
        left, right = self.stretch(a, cut_a), self.stretch(cut_b, b)
        size = (cut_a - a + b - cut_b).astype(np.uint64)
        return mix(left + right * powers(len(self.one))[cut_a - a] + size * _M)


def block_keys(h: Hashed, a: np.ndarray, b: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """For lines [a, b): keys [lines, 2 * blocks] and whether it is for a partner of one character less.

    Partners have lengths m and m or m + 1.  Block j lies between places m*j//blocks and m*(j+1)//blocks, the second counted from the line's end.
    """
    n, keys = b - a, []
    for less in (0, 1):
        m = n - less
        for j in range(blocks):
            head, tail = m * j // blocks, m - m * (j + 1) // blocks
            keys.append(mix(h.without(a, b, a + head, b - tail) ^ mix((m * (2 * blocks) + j).astype(np.uint64))))
    return np.stack(keys, axis=1) if len(a) else np.zeros((0, 2 * blocks), np.uint64), np.repeat([0, 1], blocks)


def variant_keys(h: Hashed, a: int, b: int, block: int, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one line with each character of a block deleted, and roles.

    Role 0: the whole line, as a partner of longer ones; 1: without a character, as a partner of shorter ones; 2: without the character at a given
    place, as a partner of others without theirs at the same place.
    """
    less, j = divmod(block, blocks)
    m = b - a - less
    first, last = a + m * j // blocks, b - (m - m * (j + 1) // blocks)
    at = np.arange(first, last)
    start, end = np.full(len(at), a), np.full(len(at), b)
    deleted = h.without(start, end, at, at + 1)
    if less:
        return deleted, np.ones(len(at), np.int64)
    whole = h.without(np.array([a]), np.array([b]), np.array([a]), np.array([a]))
    return np.r_[mix(deleted ^ mix((at - a + 7).astype(np.uint64))), whole], np.r_[np.full(len(at), 2), 0]


def _lines_of(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one string with a line feed after each; begin and end of every line, its text's index and its number in it."""
    whole = "\n".join(t or "" for t in texts) + "\n"
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 10)
    starts = np.r_[0, ends[:-1] + 1]
    sizes = np.array([len(t or "") + 1 for t in texts])
    firsts = np.cumsum(sizes) - sizes
    owner = np.searchsorted(firsts, starts, "right") - 1
    first_line = np.searchsorted(starts, firsts)
    return whole, starts, ends, owner, np.arange(len(starts)) - first_line[owner]


def lines(numbered: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, row, line, h1, h2 and keys (with either half deleted) of every line of at least min_chars characters."""
    names = ["doc_id", "row", "line", "h1", "h2", "keys"]

    def run(batches):
        for batch in batches:
            ids, rows, texts = (batch.column(k).to_pylist() for k in range(3))
            done = 0
            for part in slices([t or "" for t in texts], 1_000_000):
                whole, a, b, owner, line = _lines_of(part)
                keep = b - a >= min_chars
                a, b, owner, line = a[keep], b[keep], owner[keep], line[keep]
                h = Hashed(whole)
                h1 = h.without(a, b, a, a)
                h2 = mix(h.stretch(a, b) * _M ^ h.stretch(a + (b - a) // 3, b) ^ mix(h.stretch(a + (b - a) // 2, b)))
                keys, _ = block_keys(h, a, b, HALVES)
                flat = pa.array(keys.ravel().view(np.int64))
                keys_list = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * keys.shape[1], pa.int32()), flat)
                who = pa.array(owner + done)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(who), pa.array(rows, pa.int64()).take(who), pa.array(line), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), keys_list], names)
                done += len(part)

    bounded_batches(numbered.sparkSession)
    return numbered.select(F.col("doc_id").cast("long").alias("doc_id"), "row", "text").mapInArrow(run, "doc_id long, row long, line long, h1 long, h2 long, keys array<long>")


def _shared(keys: DataFrame) -> DataFrame:
    """Rows of keys (key, ...) whose key other rows have, too."""
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key", "left_semi")


def near(distinct: DataFrame, numbered: DataFrame) -> DataFrame:
    """h1, h2 of those lines of distinct (h1, h2, first, keys) that have an earlier one within one edit."""
    halves = _shared(distinct.select(F.explode("keys").alias("key"), "h1", "h2", "first")).select("h1", "h2", "first").distinct()
    wanted = by_part(halves.groupBy(F.col("first.row").alias("row")).agg(F.collect_list(F.struct("first.line", "h1", "h2")).alias("lines")), "row", "lines-halves")
    of_line = pa.list_(pa.struct([("line", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]))

    def cut(batches):
        for batch in attach(batches, wanted, "row", "lines", of_line):
            batch, out = batch.filter(batch.column(3).is_valid()), []
            for doc, row, text, wants in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                parts = (text or "").split("\n")
                out += [(w["h1"], w["h2"], doc, row, w["line"], parts[w["line"]]) for w in wants]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*out, strict=True)] or [()] * 6, [pa.int64()] * 5 + [pa.string()], strict=True)], ["h1", "h2", "doc_id", "row", "line", "text"])

    rows = numbered.select(F.col("doc_id").cast("long").alias("doc_id"), "row", "text")
    lined = store(rows.mapInArrow(cut, "h1 long, h2 long, doc_id long, row long, line long, text string"), "lines-texts")

    def blocked(batches):
        for batch in batches:
            at = 0
            for part in slices(batch.column(2).to_pylist(), 1_000_000):
                sizes = np.array([*map(len, part)])
                b = np.cumsum(sizes)
                keys, _ = block_keys(Hashed("".join(part)), b - sizes, b, BLOCKS)
                n, k = keys.shape
                who = pa.array(np.repeat(np.arange(at, at + n), k))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(k), n)), batch.column(0).take(who), batch.column(1).take(who)], ["key", "block", "h1", "h2"])
                at += n

    blocks = _shared(lined.select("h1", "h2", "text").mapInArrow(blocked, "key long, block long, h1 long, h2 long"))
    todo = store(lined.join(blocks.groupBy("h1", "h2").agg(F.collect_set("block").alias("blocks")), ["h1", "h2"]), "lines-blocks")

    def varied(batches):
        for batch in batches:
            ids = [batch.column(k) for k in range(5)]
            keys, roles, who = [], [], []
            for k, (text, which) in enumerate(zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)):
                h = Hashed(text)
                made = [variant_keys(h, 0, len(text), x) for x in which]
                both = np.unique(np.stack([np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]).astype(np.uint64)]), axis=1)
                keys.append(both[0])
                roles.append(both[1].astype(np.int64))
                who.append(np.full(both.shape[1], k))
            if keys:
                take = pa.array(np.concatenate(who))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(roles)), *(c.take(take) for c in ids)], ["key", "role", "h1", "h2", "doc_id", "row", "line"])

    variants = todo.select("h1", "h2", "doc_id", "row", "line", "text", "blocks").mapInArrow(varied, "key long, role long, h1 long, h2 long, doc_id long, row long, line long")
    variants = store(variants.select("key", "role", F.struct("doc_id", "row", "line", "h1", "h2").alias("at")), "lines-variants")
    of = lambda role: F.min(F.when(F.col("role") == role, F.col("at"))).alias(f"m{role}")
    least = variants.groupBy("key").agg(of(0), of(1), of(2), F.count("*").alias("n")).where("n > 1").drop("n")
    partner = F.when(F.col("role") == 0, F.col("m1")).when(F.col("role") == 1, F.col("m0")).otherwise(F.col("m2"))
    pairs = variants.join(least, "key").withColumn("partner", partner).where("partner < at").select("at.h1", "at.h2", F.col("partner.h1").alias("p1"), F.col("partner.h2").alias("p2")).distinct()
    text = todo.select("h1", "h2", "text")
    other = text.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("text").alias("other"))
    return pairs.join(text, ["h1", "h2"]).join(other, ["p1", "p2"]).where(F.levenshtein("text", "other", 1) >= 0).select("h1", "h2").distinct()


def dropped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """The input with its row numbers (_sl_row), and (_sl_row, _sl_lines array<long>) of the lines to drop."""
    numbered, path = _dropped(df, id_col, text_col, min_chars)
    return numbered, df.sparkSession.read.schema("_sl_row long, _sl_lines array<long>").parquet(path)


def _dropped(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> tuple[DataFrame, str]:
    """The input with its row numbers (_sl_row), and where (_sl_row, _sl_lines array<long>) of the lines to drop is stored by parts."""
    numbered = store(df.withColumn("_sl_row", F.monotonically_increasing_id()), "lines-numbered")
    slim = numbered.select(F.col(id_col).alias("doc_id"), F.col("_sl_row").alias("row"), F.col(text_col).alias("text"))
    every = lines(slim, min_chars)
    distinct = store(every.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys")), "lines")
    close = store(near(distinct.select("h1", "h2", "first", "keys"), slim), "lines-near").withColumn("near", F.lit(True))
    gone = distinct.select("h1", "h2", "n", "first").join(close, ["h1", "h2"], "left").where("n > 1 OR near")
    out = every.drop("keys", "doc_id").join(gone.select("h1", "h2", "near", F.col("first.row").alias("frow"), F.col("first.line").alias("fline")), ["h1", "h2"])
    out = out.where("near OR row != frow OR line != fline").groupBy(F.col("row").alias("_sl_row")).agg(F.collect_list("line").alias("_sl_lines"))
    return numbered, by_part(out, "_sl_row", "lines-dropped")


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of df, with n_lines and n_dropped (which replace columns of these names); the text has lost its repeated lines."""
    df = df.drop("n_lines", "n_dropped")
    numbered, gone = _dropped(df, id_col, text_col, min_chars)
    parts = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.expr(f"transform(filter(transform(split(`{text_col}`, '\\n', -1), (x, i) -> struct(x, cast(i AS long) AS i)), s -> NOT array_contains(_sl_lines, s.i)), s -> s.x)"), "\n")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema) + ", _sl_lines array<bigint>"
    joined = numbered.mapInArrow(lambda batches: attach(batches, gone, "_sl_row", "_sl_lines", pa.list_(pa.int64())), schema)
    return joined.select(
        *(F.when(F.col("_sl_lines").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in df.columns),
        F.when(F.coalesce(F.col(text_col), F.lit("")) == "", F.lit(0)).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_sl_lines"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


QUERIES = {"op6_lines": op6_lines}
_LINES_SQL = f"""
doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM doc),
uniq AS (SELECT line, min(struct_pack(d := doc_id, k := k)) AS first, length(line) AS n FROM split WHERE length(line) >= {MIN_CHARS} GROUP BY line),
half AS (SELECT line, first, n, m, left(line, (m // 2)::INT) AS l, right(line, (m - m // 2)::INT) AS r FROM (SELECT *, unnest([n, n - 1]) AS m FROM uniq)),
cand AS (SELECT a.line AS x, b.line AS y FROM half a JOIN half b ON a.m = b.m AND a.l = b.l AND b.first < a.first
         UNION SELECT a.line, b.line FROM half a JOIN half b ON a.m = b.m AND a.r = b.r AND b.first < a.first),
near AS (SELECT DISTINCT x FROM cand WHERE levenshtein(x, y) <= 1),
mark AS (SELECT s.doc_id, s.line, s.k, length(s.line) >= {MIN_CHARS} AND (n.x IS NOT NULL OR u.first != struct_pack(d := s.doc_id, k := s.k)) AS gone
         FROM split s LEFT JOIN uniq u ON u.line = s.line LEFT JOIN near n ON n.x = s.line)
"""
ORACLE = {
    "op6_lines": f"""WITH {_LINES_SQL}
SELECT doc_id, CASE WHEN sum(length(line)) + count(*) = 1 THEN 0 ELSE count(*) END::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       md5(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM mark GROUP BY doc_id"""
}
