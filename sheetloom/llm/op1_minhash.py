"""MinHash near-dedup: DartMinHash.

A text is a weighted set of word n-grams (weight: how often it occurs).  Darts fall on the plane of weight and rank as a Poisson process that
hashes alone decide, so every text that holds a region of an element sees the same darts in it.  Per text only the darts of the lowest ranks
are thrown, about k ln k + 2k whatever its length; each hits one of k coordinates, and the earliest per coordinate is the signature.  Equal
coordinates estimate the weighted Jaccard similarity.

Equal texts become one first (with a count), and so do texts of equal signatures.  Bands of the signature are keys; every two texts of a key are
compared, hot keys block by block, and those whose signatures agree enough are links.  Classes are the connected components of the links.  No
pairs of a hot key are emitted but those that connect it, and no key is cut.  Two texts of which a share s of the coordinates agree have a band
in common with probability 1 - (1 - s^4)^32: 95.4 % at 0.55, 99.98 % at 0.7.

Defined results: a null text counts as empty; empty texts are copies of each other; a text of fewer words than n is one element; the first of a class is
the smallest (doc_id, row), a null id first; repeated rows are copies; extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, bounded_batches, by_part, components, mix, read, store, text_bytes, word_hashes

K, NGRAM = 128, 2
SHORT = 4
THRESHOLD = 0.55
#: Texts of a block of a large band, and of a band whose pairs are compared one by one.
BLOCK, SMALL = 4096, 32


def elements(data: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all unit cells (element, occurrence) of all texts, and how many each text has."""
    words, at = word_hashes(data, offsets)
    counts = at[1:] - at[:-1]
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), sizes)
    first = at[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = np.zeros(len(owner), np.uint64)
    padded = np.r_[words, np.zeros(n, np.uint64)]
    for k in range(n):
        inside = first + k < at[1:][owner]
        grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, padded[first + k], np.uint64(k)))
    order = np.argsort(mix(grams ^ mix(owner.astype(np.uint64))), kind="stable")
    g, o = grams[order], owner[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (o[1:] != o[:-1])] if len(g) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0)) if len(g) else np.zeros(0, np.int64)
    cells = np.empty_like(grams)
    cells[order] = mix(g + (np.arange(len(g)) - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return cells, sizes


def signatures(cells: np.ndarray, sizes: np.ndarray, k: int = K) -> np.ndarray:
    """[texts, k] of 16-bit values (two coordinates that aren't equal look so once in 65 536 times); a text without cells has zeros."""
    texts = len(sizes)
    best = np.full(texts * k, np.iinfo(np.uint64).max, np.uint64)
    limit = np.full(texts, k * math.log(k) + 2 * k) / np.maximum(sizes, 1)
    owner = np.repeat(np.arange(texts), sizes)
    todo = sizes > 0
    while todo.any():
        on = todo[owner]
        cell, who = cells[on], owner[on]
        rank, turn = np.zeros(len(cell)), 0
        while len(cell):
            turn += 1
            u = mix(cell + np.uint64(turn * 0xA0761D6478BD642F & (1 << 64) - 1))
            rank = rank - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            go = rank <= limit[who]
            cell, who, rank, u = cell[go], who[go], rank[go], u[go]
            dart = mix(u)
            value = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | dart >> np.uint64(32)
            np.minimum.at(best, who * k + (dart & np.uint64(0xFFFFFFFF)).astype(np.int64) % k, value)
        todo = todo & (best.reshape(texts, k) == np.iinfo(np.uint64).max).any(axis=1)
        limit[todo] *= 2
    return np.where(sizes[:, None] > 0, best.reshape(texts, k), 0).astype(np.uint16)


def sketch(df: DataFrame, text_col: str = "text", k: int = K, n: int = NGRAM) -> DataFrame:
    """All columns but the text, row (unique), h (hash of the text) and signature (k 16-bit values, packed)."""
    at, names = df.columns.index(text_col), [c for c in df.columns if c != text_col]

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            hashes = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts.to_pylist()]
            packed: list[bytes] = []
            data, offsets = text_bytes(texts)
            first = 0
            while first < len(texts):  # about 4 MB of text at a time
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (4 << 20), "right")) - 1)
                part = signatures(*elements(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], n), k)
                packed += [x.tobytes() for x in part]
                first = last
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(hashes, pa.binary()), pa.array(packed, pa.binary())], [*names, "h", "signature"])

    bounded_batches(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col) + ", h binary, signature binary"
    return df.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def bands(distinct: DataFrame, k: int = K, width: int = SHORT) -> DataFrame:
    """key and row, for every band; a key ends in the number of its band."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, k)
            keys = band_keys(s, width)
            keys = keys & ~np.uint64(0xFF) | np.arange(keys.shape[1], dtype=np.uint64)
            rows = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(rows)], ["key", "row"])

    return distinct.select("row", "signature").mapInArrow(run, "key long, row long")


def band_keys(s: np.ndarray, width: int = SHORT) -> np.ndarray:
    """[texts, bands] of 64-bit hashes."""
    keys = []
    for first in range(0, s.shape[1] - width + 1, width):
        key = np.full(len(s), width << 32 | first, np.uint64)
        for j in range(first, first + width):
            key = mix(key * np.uint64(31) + s[:, j].astype(np.uint64))
        keys.append(key)
    return np.stack(keys, axis=1)


def few(s: np.ndarray, band: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of many small groups (places in s), each pair in the first band that both are in."""
    left = np.arange(len(s)) - np.repeat(starts, sizes)
    ahead = np.repeat(sizes, sizes) - 1 - left
    a = np.repeat(np.arange(len(s)), ahead)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
    keep = np.zeros(len(a), bool)
    for k in range(0, len(a), 4096):
        same = s[a[k : k + 4096]] == s[b[k : k + 4096]]
        shared = same[:, : same.shape[1] // SHORT * SHORT].reshape(len(same), -1, SHORT).all(axis=2)
        keep[k : k + 4096] = (same.mean(axis=1) >= least) & (shared.argmax(axis=1) == band[a[k : k + 4096]])
    return a[keep], b[keep]


def many(s: np.ndarray, t: np.ndarray, band: int, least: float) -> np.ndarray:
    """[s, t]: whether two texts are linked and no band before this one has both."""
    out = np.zeros((len(s), len(t)), bool)
    x, y, u, v = np.ascontiguousarray(s.T), np.ascontiguousarray(t.T), band_keys(s).T, band_keys(t).T
    for k in range(0, len(s), 128):
        same = np.zeros((min(128, len(s) - k), len(t)), np.uint16)
        for i in range(len(x)):
            same += x[i, k : k + 128, None] == y[i]
        hit = same / len(x) >= least
        for i in range(band):
            hit &= u[i, k : k + 128, None] != v[i]
        hit &= u[band, k : k + 128, None] == v[band]
        out[k : k + 128] = hit
    return out


def forest(hit: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Pairs (row, column) of a spanning forest of the graph that has the rows and columns of a matrix as nodes; same: they are the same nodes."""
    back = hit if same else np.ascontiguousarray(hit.T)
    new = [np.ones(n, bool) for n in hit.shape]
    if same:
        new[1] = new[0]
    out = []
    for root in range(len(hit)):
        if not new[0][root]:
            continue
        new[0][root] = False
        todo = [(0, root)]
        while todo:
            side, at = todo.pop()
            more = np.flatnonzero((back if side else hit)[at] & new[1 - side])
            new[1 - side][more] = False
            out += [(x, at) if side else (at, x) for x in more.tolist()]
            todo += [(1 - side, x) for x in more.tolist()]
    return out


def links(distinct: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """Of linked texts (signatures agree in at least threshold of the coordinates, and a band is common): a, b, as many pairs as connect all that
    are, with null as n; and a, n with null as b, the n of one text to be summed: the weights of all that it is linked with.  distinct: row, signature, weight.

    Every pair of a band's texts is compared, in the first band that both are in.  The pairs of a large band aren't emitted but for a spanning
    forest; a band of more than BLOCK texts is cut into blocks, and each two blocks are a group of their own.
    """
    of = bands(distinct, k)
    # bands of exactly the same texts are compared once, in the first of them, which is also the first that any two of them are both in
    sets = of.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")).where("n > 1")
    first = sets.groupBy("n", "x", "y").agg(F.min(F.struct((F.col("key").bitwiseAND(0xFF)).alias("band"), "key")).alias("m"))
    blocks = first.select("m.key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    member = of.join(blocks, "key").select("key", "row", "blocks", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"))
    member = member.join(distinct.select("row", "signature", "weight"), "row").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = member.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "row", "signature", "weight")
    group = group.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def compare(table: pa.Table):
        """Of whole groups."""
        weight = table.column(6).to_numpy()
        key, p, q, block, row = (table.column(c).to_numpy() for c in range(5))
        s = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint16).reshape(-1, k)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
        sizes = np.diff(np.r_[starts, len(key)])
        band = key & 0xFF
        small = (sizes <= SMALL) & (p[starts] == q[starts])
        some = np.repeat(small, sizes)
        a, b = few(s[some], band[some], np.r_[0, np.cumsum(sizes[small])[:-1]].astype(np.int64)[: small.sum()], sizes[small], threshold)
        pairs, n = [(row[some][a], row[some][b])], np.zeros(len(row), np.int64)
        place = np.flatnonzero(some)
        np.add.at(n, place[a], weight[place[b]])
        np.add.at(n, place[b], weight[place[a]])
        for start, size in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
            at = slice(start, start + size)
            left, right = (np.flatnonzero(block[at] == x) + start for x in (p[start], q[start]))
            if not len(left) or not len(right):
                continue
            hit = many(s[left], s[right], int(band[start]), threshold)
            same = p[start] == q[start]
            if same:
                np.fill_diagonal(hit, False)
            for i in range(0, len(left), 256):  # sums by part, so that no matrix of numbers is made
                n[left[i : i + 256]] += hit[i : i + 256] @ weight[right]
                if not same:
                    n[right] += weight[left[i : i + 256]] @ hit[i : i + 256]
            tree = np.array(forest(hit, same), np.int64).reshape(-1, 2)
            pairs.append((row[left[tree[:, 0]]], row[right[tree[:, 1]]]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        some = np.flatnonzero(n)
        columns = [pa.array(np.r_[a, row[some]]), pa.concat_arrays([pa.array(b), pa.nulls(len(some), pa.int64())]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(n[some])])]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[-1].as_py() for c in range(3)]
            ends = np.logical_or.reduce([batch.column(c).to_numpy() != last[c] for c in range(3)])
            n = int(ends.sum())  # rows before the last group
            if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in range(3)):
                yield compare(pa.concat_tables(held))
                held = []
            whole = pa.Table.from_batches([batch])
            if n:
                yield compare(pa.concat_tables([*held, whole.slice(0, n)]))
                held = []
            held.append(whole.slice(n))
        if held:
            yield compare(pa.concat_tables(held))

    bounded_batches(distinct.sparkSession)
    return group.mapInArrow(run, "a long, b long, n long")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For every row: row, id, class (row of the class's first), class_id (its id), n_links (how many other texts its text is linked with), n_copies (rows with its text), first (whether it is the class's first).

    The row numbers are those of ``sketch``.
    """
    drawn = store(sketch(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "sketch")
    # texts of equal signatures are one for the links; a text without words has no signature to compare, and copies of it are one text already
    same = F.when(F.col("signature") == F.lit(bytes(2 * K)), F.col("h")).otherwise(F.unhex(F.md5("signature")))
    texts = store(drawn.select("row", "h", same.alias("same")).groupBy("h", "same").agg(F.min("row").alias("head"), F.count("*").alias("n_copies")), "texts")
    alike = store(texts.groupBy("same").agg(F.min("head").alias("rep"), F.count("*").alias("n_alike")), "alike")
    distinct = drawn.join(alike.select(F.col("rep").alias("row"), F.col("n_alike").alias("weight")), "row")
    distinct = store(distinct.where(F.col("signature") != F.lit(bytes(2 * K))).select("row", "signature", "weight"), "distinct")
    found = store(links(distinct, threshold), "links")
    label = components(found.where("b is not null").select("a", "b"), "classes")
    degree = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    known = alike.join(label.withColumnRenamed("node", "rep"), "rep", "left").join(degree.withColumnRenamed("a", "rep"), "rep", "left")
    known = known.withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("n_alike") - 1)
    known = texts.join(known.select("same", F.coalesce("label", "rep").alias("label"), "n_links"), "same").drop("same", "head")
    every = store(drawn.select("row", "id", "h").join(known, "h").drop("h"), "labelled")
    heads = every.groupBy("label").agg(F.min(F.struct("id", "row")).alias("m"))
    out = every.join(heads, "label")
    return out.select("row", "id", F.col("m.row").alias("class"), F.col("m.id").alias("class_id"), "n_links", "n_copies", (F.col("row") == F.col("m.row")).alias("first"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies", F.col("first").alias("kept"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, one of each class: that with the smallest id (of rows with that id, the first that was read)."""
    numbered = store(df.withColumn("_sl_row", F.monotonically_increasing_id()), "numbered")
    keep = classes(numbered.select(F.struct(F.col(id_col).alias("id"), "_sl_row").alias("id"), F.col(text_col).alias("text")), "id", "text").where("first")
    path = by_part(keep.select(F.col("id._sl_row").alias("_sl_row"), F.lit(True).alias("_sl_kept")), "_sl_row", "kept")

    def run(batches):
        for batch in attach(batches, path, "_sl_row", "_sl_kept", pa.bool_()):
            yield batch.filter(batch.column(batch.num_columns - 1)).select(df_columns)

    df_columns = df.columns
    return numbered.mapInArrow(run, df.schema)


QUERIES = {"op1_minhash": op1_minhash}
#: Hashed sketches of texts can't be said in SQL.
ORACLE: dict[str, str] = {}
