"""LM scoring: unbounded n-grams over corpus suffixes, sharded by key range.

A context is the words before a place, read backwards, so it is a prefix of a backward suffix of a text.  Every place finds, by binary search, the longest
context that occurs in the training corpus and how often.  A context of length l that continues with word w is the context of length l + 1 one place
further, so the longest matches and their counts at neighbouring places give all continuation counts.

P(w | context) = (c(context w) + m(l) * base(w)) / (c(context) + m(l)), with base(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)) and m falling in the length
l: a distribution over V words and one unknown.

The suffixes are searched in two steps, like a suffix array that is sorted by longer and longer prefixes and only where anyone asks.

1. *Windows.*  The most frequent words have codes of one to three bytes (no code begins another; other words: 56 bits of their hash), and the first
   eight bytes of each suffix, cut to whole codes, are its window: about four words.  Windows are aggregated in each block of texts and go to shards by
   their first two words, so each shard's sorted windows hold every suffix of its key range, each query meets one shard, and counts need no sum over
   shards.  Work and traffic are proportional to the corpus.  What matches less than a window ends here (three quarters of the places of new text).
2. *Longer contexts, in rounds.*  Only where a text to score, or the begin of a training text, has the whole window of another training text can it match
   deeper.  These places, and the training places with their windows, meet again, by a key of what they have in common so far, in one shard for each key:
   first with the pair of their window and the next one, then with hashes of longer and longer contexts (a ladder of ``LADDER`` ** k more words), then
   with steps between the last rung that was found and the next, smaller in each round.  A round's answer tells each asking place how far it goes
   and how often that occurs, and each training place whether anyone still agrees with it; the others drop out.  The number of rounds is logarithmic in the longest
   repeated context, each round's work is at most proportional to the corpus, and no task reads more than its blocks and its shard.

As a place moves on, the begin of its longest context never moves back, and the count of a context with a fixed begin only falls.  So where a context of up to
two windows occurs as often as it does without its last word, the place has the begin and the count of the one before (``begin_search``) and isn't searched
further: of a copied passage mostly its first places are.  In a training document the longest context is all that precedes, so only the count is asked for.

Defined results: a null or empty text is the single end token; equal rows have equal scores; without training documents N and V are 0, every base
probability is 1 and so is every probability; extra columns are ignored; an empty table gives an empty result.  The input must give the same rows in the
same order when a partition is read again, as a stored table does.
"""

from __future__ import annotations

import uuid
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, mix, powers, read, settle, shared_folder, store, text_bytes, word_hashes

BLOCK_TOKENS = 1 << 20
#: Windows of a shard of step 1, words of the corpus for each shard of step 2.
SHARD_WINDOWS = 1 << 21
SHARD_TOKENS = 4 << 20
#: Longer contexts are tried with LADDER, LADDER**2, ... more words, then in steps of which STEPS are a larger one.
LADDER = 16
STEPS = 4
#: Words that have short codes, at most; all tasks read this table (16 bytes a word).
DICTIONARY = 1 << 21
END = np.uint64(0x1F3D5B79A6C8E0D1)


def weight(length: np.ndarray) -> np.ndarray:
    """How much the base distribution counts beside a context of so many words."""
    return np.maximum(0.02, 20000.0 * 0.15 ** np.maximum(length - 1.0, 0))


# ---- files in the shared folder


def drop(path: str) -> None:
    """Removes a file, if there is one."""
    from pyarrow import fs

    if path:
        system, place = fs.FileSystem.from_uri(path)
        if system.get_file_info(place).type != fs.FileType.NotFound:
            system.delete_file(place)


def put(path: str, *arrays: np.ndarray) -> None:
    """Arrays, compressed; writing the same again changes nothing."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    with system.open_output_stream(place) as f:
        for x in arrays:
            data = pack(x)
            f.write(np.int64(len(data)).tobytes())
            f.write(data)


def get(path: str) -> list[np.ndarray]:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    out = []
    with system.open_input_stream(place) as f:
        while len(head := f.read(8)):
            out.append(unpack(f.read(int(np.frombuffer(head, np.int64)[0]))))
    return out


def pack(x: np.ndarray) -> bytes:
    """An array as bytes: type, length, then its bytes by significance, compressed."""
    x = np.ascontiguousarray(x.astype(np.uint8) if x.dtype == bool else x)
    head = x.dtype.str.encode().ljust(8) + np.int64(len(x)).tobytes()
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T) if x.itemsize > 1 else x
    return head + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    kind, n = data[:8].decode().strip(), int(np.frombuffer(data, np.int64, 1, 8)[0])
    kind = np.dtype(kind)
    raw = np.frombuffer(pa.decompress(memoryview(data)[16:], n * kind.itemsize, "zstd"), np.uint8)
    if kind.itemsize == 1:
        return raw.view(kind)
    planes, whole = raw.reshape(kind.itemsize, n), np.dtype(f"u{kind.itemsize}")
    if n < 1 << 12:
        return planes.T.ravel().view(kind)
    out = planes[0].astype(whole)
    for k in range(1, kind.itemsize):
        if planes[k].any():
            out |= planes[k].astype(whole) << whole.type(8 * k)
    return out.view(kind)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    x = unpack(data)
    return np.cumsum(x, dtype=x.dtype)


# ---- sorting and searching


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (np.unique hashes where only values are asked for, which takes many times as long as a sort)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def look_up(table: np.ndarray, x: np.ndarray, side: str = "left", order: np.ndarray | None = None) -> np.ndarray:
    """np.searchsorted for x in any order; sorting x costs less than the cache misses of an unsorted search.  order: one that sorts x, if known."""
    order = np.argsort(x) if order is None else order
    out = np.empty(len(x), np.int64)
    out[order] = np.searchsorted(table, x[order], side)
    return out


def joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def pieces(parts: list[np.ndarray]) -> list[slice]:
    """Where each part is in joined(parts)."""
    ends = np.cumsum([0, *map(len, parts)]).tolist()
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def by_shard(to: np.ndarray, shards: int) -> np.ndarray:
    """Order of shards, stable."""
    return np.argsort(to.astype(np.uint16) if shards <= 1 << 16 else to, kind="stable")


def new_folder(spark: SparkSession) -> str:
    path = f"{shared_folder(spark)}/sheetloom/ngram-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path if "://" in path else "file://" + path


# ---- tokens


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """64-bit token hashes of all texts, the end token after each, and the texts' offsets, len + 1."""
    words, at = word_hashes(*text_bytes(column))
    n = len(at) - 1
    out = np.empty(len(words) + n, np.uint64)
    ends = at[1:] + np.arange(n)
    out[ends] = END
    rest = np.ones(len(out), bool)
    rest[ends] = False
    out[rest] = words
    return out, np.r_[0, ends + 1]


class Block:
    """Some texts: ids, held flags, words (sorted hashes) and local (the number of its word for each token), offsets of the texts."""

    def __init__(self, ids, held, words, local, offsets):
        self.ids, self.held, self.words, self.local, self.offsets = ids, held.astype(bool), words, local, offsets
        self.sizes = np.diff(offsets)

    @cached_property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @cached_property
    def ordinal(self) -> np.ndarray:
        return np.arange(len(self.local)) - np.repeat(self.offsets[:-1], self.sizes)

    @cached_property
    def in_held(self) -> np.ndarray:
        return np.repeat(self.held, self.sizes)

    def left(self, at: np.ndarray) -> np.ndarray:
        """Words of a place's text up to and with it."""
        return at - self.offsets[np.searchsorted(self.offsets, at, "right") - 1] + 1


def _blocks(batches, size: int):
    """Runs of documents (ids with nulls marked, flags, hashes, offsets) of about size tokens."""
    ids, flags, parts, sizes, n = [], [], [], [], 0
    for batch in batches:
        h, offsets = tokens(batch.column(2))
        ids += batch.column(0).to_pylist()
        flags += batch.column(1).to_pylist()
        parts.append(h)
        sizes.append(np.diff(offsets))
        n += len(h)
        if n >= size:
            yield ids, flags, np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(sizes))]
            ids, flags, parts, sizes, n = [], [], [], [], 0
    if ids:
        yield ids, flags, np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(sizes))]


# ---- windows


class Codes:
    """Codes of the words of a dictionary (sorted hashes, ranks by falling count from 0, counts)."""

    def __init__(self, hashes: np.ndarray, ranks: np.ndarray, counts: np.ndarray):
        self.hashes, self.ranks, self.counts = hashes, ranks, counts

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code (in the high bytes of 64 bits), its size in bytes, and count (-1: not in the dictionary) of each word."""
        code, size = words >> np.uint64(8) | np.uint64(0xFF << 56), np.full(len(words), 8, np.uint8)
        count = np.full(len(words), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            known = np.flatnonzero(self.hashes[at] == words)
            r = self.ranks[at[known]].astype(np.uint64)
            one, two = r < 127, r < 127 + 16384
            code[known] = np.where(one, (r + np.uint64(1)) << np.uint64(56), np.where(two, (r - np.uint64(127) + np.uint64(0x8000)) << np.uint64(48), (r - np.uint64(127 + 16384) + np.uint64(0xC00000)) << np.uint64(40)))
            size[known] = np.where(one, 1, np.where(two, 2, 3))
            count[known] = self.counts[at[known]]
        return code, size, count


def windows(block: Block, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token the window of the words that end with it, and how many they are."""
    most = 8
    codes, sizes = np.zeros(len(block.local) + most, np.uint64), np.full(len(block.local) + most, 99, np.uint8)
    codes[most:], sizes[most:] = code[block.local], size[block.local]
    out, n = codes[most:].copy(), np.ones(len(block.local), np.uint8)
    for first in range(0, len(out), 1 << 15):  # what the processor's cache holds at a time
        here = slice(first, min(first + (1 << 15), len(out)))
        w, words, ordinal = out[here], n[here], np.minimum(block.ordinal[here], most).astype(np.uint8)
        used, on = sizes[most:][here].copy(), np.ones(len(w), bool)
        for k in range(1, most):
            back = slice(here.start + most - k, here.stop + most - k)
            on &= (ordinal >= k) & (used + sizes[back] <= 8)
            if not on.any():
                break
            w |= np.where(on, codes[back] >> (used.astype(np.uint64) << np.uint64(3)), np.uint64(0))
            used += sizes[back] * on
            words += on
    return out, n


_SIZES = np.array([0] + [1] * 127 + [2] * 64 + [3] * 63 + [8], np.uint8)
_MASKS = np.array([0] + [(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9)], np.uint64)


def code_ends(w: np.ndarray, most: int = 8) -> np.ndarray:
    """[windows, most]: bytes up to the end of each of its codes; 99 where there is none."""
    at, out = np.zeros(len(w), np.uint8), np.full((len(w), most), 99, np.uint8)
    for k in range(most):
        size = np.where(at < 8, _SIZES[(w << (np.minimum(at, 7).astype(np.uint64) * np.uint64(8)) >> np.uint64(56)).astype(np.uint8)], 0).astype(np.uint8)
        on = (size > 0) & (at + size <= 8)
        at = np.where(on, at + size, np.uint8(8))
        out[:, k] = np.where(on, at, np.uint8(99))
        if not on.any():
            break
    return out


def shard_of(w: np.ndarray, shards: int) -> np.ndarray:
    """By the first two words, or by the only one."""
    ends = code_ends(w, 2)
    two = np.where(ends[:, 1] < 99, ends[:, 1], np.minimum(ends[:, 0], 8))
    return (mix(w & _MASKS[two]) >> np.uint64(33)).astype(np.int64) * shards >> 31


def search_windows(corpus: np.ndarray, sums: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows q: words of the longest prefix among the sorted windows of the corpus, how often (sums: counts summed, from 0), and whether the whole is there."""
    length, times, found = np.zeros(len(q), np.uint8), np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    for first in range(0, len(q) if len(corpus) else 0, 1 << 17):
        part = q[first : first + (1 << 17)]
        ends = code_ends(part)
        at = np.searchsorted(corpus, part)
        best, whole = np.zeros(len(part), np.int64), np.zeros(len(part), bool)
        for k in (at - 1, at):
            there = (k >= 0) & (k < len(corpus))
            x = corpus[np.clip(k, 0, len(corpus) - 1)] ^ part
            alike = np.zeros(len(part), np.uint8)
            for b in range(1, 9):
                alike += (x & _MASKS[b]) == 0
            best = np.maximum(best, np.where(there, (ends <= alike[:, None]).sum(axis=1), 0))
            whole |= there & (x == 0)
        mask = _MASKS[np.where(best > 0, ends[np.arange(len(part)), np.maximum(best - 1, 0)], 0)]
        low = part & mask
        n = sums[np.searchsorted(corpus, low | ~mask, "right")] - sums[np.searchsorted(corpus, low, "left")]
        at = slice(first, first + len(part))
        length[at], times[at], found[at] = best, np.where(best > 0, n, 0), whole
    return length, times, found


def search_pairs(corpus: np.ndarray, sums: np.ndarray, seconds: np.ndarray, first: np.ndarray, q: np.ndarray, known: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As search_windows, for second windows q behind first windows (numbers): corpus holds the number of the first and of the second window among seconds.

    How often is given for the longest prefix, and for those a word and two words shorter.  known: all are in the corpus.
    """
    n = len(q)
    length, times, found = np.zeros(n, np.uint8), np.zeros((3, n), np.int64), np.zeros(n, bool)
    if not len(corpus):
        return length, times, found
    base, low32 = first.astype(np.uint64) << np.uint64(32), np.uint64(0xFFFFFFFF)
    for begin in range(0, n, 1 << 17):
        here = slice(begin, begin + (1 << 17))
        part, group = q[here], base[here]
        ends, order = code_ends(part), np.argsort(part)
        best, whole = ((ends < 99).sum(axis=1) if known else np.zeros(len(part), np.int64)), np.full(len(part), known)
        at = None if known else np.searchsorted(corpus, group | look_up(seconds, part, order=order).astype(np.uint64))
        for k in () if known else (at - 1, at):
            pair = corpus[np.clip(k, 0, len(corpus) - 1)]
            there = (k >= 0) & (k < len(corpus)) & (pair >> np.uint64(32) == group >> np.uint64(32))
            x = seconds[(pair & low32).astype(np.int64)] ^ part
            alike = np.zeros(len(part), np.uint8)
            for b in range(1, 9):
                alike += (x & _MASKS[b]) == 0
            best = np.maximum(best, np.where(there, (ends <= alike[:, None]).sum(axis=1), 0))
            whole |= there & (x == 0)
        for less in range(3):
            some = best > less
            mask = _MASKS[np.where(some, ends[np.arange(len(part)), np.maximum(best - 1 - less, 0)], 0)]
            a = np.searchsorted(corpus, group | look_up(seconds, part & mask, "left", order).astype(np.uint64))
            b = np.searchsorted(corpus, group + look_up(seconds, part & mask | ~mask, "right", order).astype(np.uint64))
            times[less, here] = np.where(some, sums[b] - sums[a], 0)
        length[here], found[here] = best, whole
    return length, times, found


# ---- longer contexts


class Stretches:
    """Rolling hashes of an array of tokens."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.sums = np.zeros(n + 1, np.uint64)
        self.back = powers(n + 1, inverse=True)
        h = x.astype(np.uint64)
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
        h *= powers(n)
        np.cumsum(h, out=self.sums[1:])

    def of(self, a: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[a + size] - self.sums[a]) * self.back[a]


# ---- jobs

_ROWS = "shard long, block string, kind int, data binary, extra binary"
CORPUS, HELD, RARE, ASKED, HERE, BEGIN, FIRST, OWN = range(8)
#: What a shard says of a window of the corpus: a held text has it; it occurs again; it is the first of a training text that doesn't hold all before it.
IN_HELD, AGAIN, IS_FIRST = 1, 2, 4


def _row(rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "block", "kind", "data", "extra"])


def count_words(docs: DataFrame, folder: str, dictionary: int) -> tuple[DataFrame, str, int, int, int]:
    """Table of training words (h, n); file of the dictionary; the least count in it; N; V."""

    def each(batches):
        for _, _, h, _ in _blocks(batches, BLOCK_TOKENS):
            words, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["h", "n"])

    words = store(docs.where(~F.col("held")).mapInArrow(each, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "ngram-words")
    sizes = words.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).orderBy(F.desc("b")).collect()  # 63 rows at most
    least, have = 1, 0
    for r in sizes:
        have += r["v"]
        if have > dictionary:
            least = 1 << r["b"] + 1
            break
    path = f"{folder}/dictionary"

    def write(batches):
        table = pa.Table.from_batches(list(batches))
        h, n = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
        rank = np.empty(len(h), np.uint32)
        rank[np.lexsort((h, -n))] = np.arange(len(h), dtype=np.uint32)
        order = np.argsort(h)
        put(path, h[order], rank[order], n[order])
        yield pa.RecordBatch.from_arrays([pa.array([len(h)])], ["v"])

    if sizes and least <= 1 << sizes[0]["b"]:
        words.where(F.col("n") >= least).select("h", "n").repartition(1).mapInArrow(write, "v long").count()
    else:
        path = ""
    return words, path, least, sum(r["n"] for r in sizes), sum(r["v"] for r in sizes)


def _codes(path: str) -> Codes:
    return Codes(*get(path)) if path else Codes(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))


def asked(block: Block, codes: Codes, shards: int, least: int):
    """Windows of a block and what it sends: for each kind the places (tokens), the sorted distinct values, each place's value and each value's shard.

    Returns also the size of each token's window and the counts of the block's words (-1: not in the dictionary).
    """
    code, size, count = codes.of(block.words)
    w, n = windows(block, code, size)
    out = {}
    behind = np.flatnonzero(~block.in_held & (block.ordinal >= n))
    first = behind[np.r_[True, block.owner[behind[1:]] != block.owner[behind[:-1]]]] if len(behind) else behind
    for kind, at in ((CORPUS, np.flatnonzero(~block.in_held)), (HELD, np.flatnonzero(block.in_held)), (BEGIN, np.flatnonzero(~block.in_held & (block.ordinal < n))), (FIRST, first)):
        values, inverse = np.unique(w[at], return_inverse=True)
        out[kind] = at, values, inverse, shard_of(values, shards)
    if least > 1:
        rare = block.words[count < 0]
        out[ASKED] = None, rare, None, (mix(rare) >> np.uint64(33)).astype(np.int64) * shards >> 31
    return out, n, count, w


def send(docs: DataFrame, folder: str, dictionary: str, least: int, shards: int) -> DataFrame:
    """Writes the blocks and sends their windows and rare words to the shards."""

    def run(batches):
        codes = _codes(dictionary)
        for k, (ids, flags, h, offsets) in enumerate(_blocks(batches, BLOCK_TOKENS)):
            words, local = np.unique(h, return_inverse=True)
            block = Block(ids, np.array(flags, bool), words, local, offsets)
            path = f"{folder}/block-{TaskContext.get().partitionId()}-{k}"
            put(path, np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], bool), block.held, words, local.astype(np.uint32), offsets)
            rows = [(0, path, HERE, b"", b"")]
            for kind, (_, values, inverse, to) in asked(block, codes, shards, least)[0].items():
                counts = np.bincount(inverse, minlength=len(values)).astype(np.uint32) if kind == CORPUS else None
                order = by_shard(to, shards)
                edges = np.searchsorted(to[order], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(edges)).tolist():
                    part = order[edges[s] : edges[s + 1]]
                    rows.append((s, path, kind, pack_sorted(values[part]), pack(counts[part]) if kind == CORPUS else b""))
            yield _row(rows)

    return docs.mapInArrow(run, _ROWS)


def load(path: str) -> Block:
    ids, null, held, words, local, offsets = get(path)
    block = Block(ids, held, words, local, offsets)
    block.null = null.astype(bool)
    return block


def answer(table: pa.Table) -> pa.Table:
    """One shard: which windows of each block occur again, how far the asked ones go and how often; counts of rare words."""
    rows = [*zip(*(c.to_pylist() for c in table.columns), strict=True)]
    del table
    of = lambda kind: [(k, unpack_sorted(r[3])) for k, r in enumerate(rows) if r[2] == kind]
    out, parts = [], of(CORPUS)
    every, counts = joined([w for _, w in parts]), joined([unpack(rows[k][4]) for k, _ in parts], np.int64)
    order = np.argsort(every)
    every, counts = every[order], counts[order]
    new = np.r_[True, every[1:] != every[:-1]] if len(every) else np.zeros(0, bool)
    head, number = np.flatnonzero(new), np.empty(len(every), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    corpus, n = every[head], np.add.reduceat(counts, head) if len(head) else counts
    del every, order, counts, new, head
    sums = np.r_[0, np.cumsum(n)]
    says = np.where(n > 1, AGAIN, 0).astype(np.uint8)
    says[np.searchsorted(corpus, distinct(joined([w for _, w in of(FIRST)])))] |= IS_FIRST  # they are windows of the corpus

    def each(kind: int):
        """Distinct values that blocks ask for; for each block its row and the places among these.  Of all blocks at once, as few in a large table cost a cache miss each."""
        parts = of(kind)
        values, which = np.unique(joined([w for _, w in parts]), return_inverse=True)
        return values, [(rows[k], which[here]) for (k, _), here in zip(parts, pieces([w for _, w in parts]), strict=True)]

    for kind in (HELD, BEGIN):
        values, blocks = each(kind)
        length, times, whole = search_windows(corpus, sums, values)
        if kind == HELD:
            says[np.searchsorted(corpus, values[whole])] |= IN_HELD
        length |= whole.astype(np.uint8) << 7
        out += [(r[0], r[1], kind, pack(length[at]), pack(times[at])) for r, at in blocks]
    for (k, _), here in zip(parts, pieces([w for _, w in parts]), strict=True):
        out.append((rows[k][0], rows[k][1], CORPUS, pack(says[number[here]]), b""))
    rare, n = [joined([unpack(r[c]) for r in rows if r[2] == RARE], x) for c, x in ((3, np.uint64), (4, np.int64))]
    order = np.argsort(rare)
    rare, n = rare[order], n[order]
    values, blocks = each(ASKED)
    at = np.minimum(np.searchsorted(rare, values), len(rare) - 1)
    n = np.where(rare[at] == values, n[at], 0) if len(rare) else np.zeros(len(values), np.int64)
    out += [(r[0], r[1], ASKED, pack(n[at]), b"") for r, at in blocks]
    out += [(r[0], r[1], HERE, b"", b"") for r in rows if r[2] == HERE]
    return pa.Table.from_batches([_row(out)])


def merge(block: Block, codes: Codes, rows, shards: int, least: int, total: int):
    """From the shards' answers (shard, kind, data, extra): length and count of each place as far as windows go; whether a held place may go deeper, or the
    longer contexts need a training one; whether its window occurs again; sizes of the windows; counts of the block's words; windows; what the shards say of
    the windows of training places."""
    what, size, count, w = asked(block, codes, shards, least)
    left = block.ordinal + 1
    length, times = np.where(block.in_held, 0, left).astype(np.int32), np.ones(len(left), np.int64)
    deep, again, says = np.zeros(len(left), bool), np.zeros(len(left), bool), np.zeros(len(left), np.uint8)
    if least > 1:
        got = np.zeros(len(what[ASKED][1]), np.int64)
        order = by_shard(what[ASKED][3], shards)
        edges = np.searchsorted(what[ASKED][3][order], np.arange(shards + 1))
        for s, _, data, _ in (r for r in rows if r[1] == ASKED):
            got[order[edges[s] : edges[s + 1]]] = unpack(data)
        count[count < 0] = got
    count = np.maximum(count, 0)
    known = count[block.local]
    for kind in (CORPUS, HELD, BEGIN):
        at, values, inverse, to = what[kind]
        l, n, flag = np.zeros(len(values), np.int32), np.zeros(len(values), np.int64), np.zeros(len(values), np.uint8)
        order = by_shard(to, shards)
        edges = np.searchsorted(to[order], np.arange(shards + 1))
        for s, _, data, extra in (r for r in rows if r[1] == kind):
            here = order[edges[s] : edges[s + 1]]
            if kind == CORPUS:
                flag[here] = unpack(data)
            else:
                x = unpack(data)
                l[here], flag[here], n[here] = x & 0x7F, x >> 7, unpack(extra)
        l, n, flag = l[inverse], n[inverse], flag[inverse]
        if kind == CORPUS:
            says[at] = flag
            beyond = left[at] > size[at]
            again[at] = (flag & AGAIN > 0) & beyond
            deep[at] = (flag & IN_HELD > 0) & beyond
            # contexts that are the begin of a training text occur only in runs of such places, behind its first window
            here, mark = np.arange(len(left)), np.zeros(len(left), bool)
            mark[at] = flag & IS_FIRST > 0
            run = np.maximum.accumulate(np.where(again, 0, here + 1))
            deep |= again & (np.maximum.accumulate(np.where(mark & again, here, -1)) >= run)
            continue
        one = l < 2
        if kind == HELD:
            length[at] = np.where(one, known[at] > 0, l)
            deep[at] = (flag > 0) & (left[at] > size[at])
        times[at] = np.where(one, known[at], n)
    times[length == 0] = total
    return length, times, deep, again, size, count, w, says


def send_parts(path: str, kind: int, to: np.ndarray, shards: int, columns) -> list[tuple]:
    """A row for each shard that has some; to: rising, columns: what a row's data and extra are, from the places of a slice."""
    edges = np.searchsorted(to, np.arange(shards + 1))
    return [(s, path, kind, *columns(slice(edges[s], edges[s + 1]))) for s in np.flatnonzero(np.diff(edges)).tolist()]


def pack_all(arrays: list[np.ndarray]) -> bytes:
    parts = [pack(x) for x in arrays]
    return b"".join([np.array([len(parts), *map(len, parts)], np.int64).tobytes(), *parts])


def unpack_all(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = np.cumsum(np.r_[8 * (n + 1), np.frombuffer(data, np.int64, n, 8)]).tolist()
    return [unpack(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def own_places(block: Block, times: np.ndarray, again: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of training texts that may have deep copies of all before: from the first that its windows don't tell to the last that occurs again."""
    left = block.ordinal + 1
    behind = np.flatnonzero(~block.in_held & (size < left) & (block.ordinal > 0))
    first = behind[np.r_[True, block.owner[behind[1:]] != block.owner[behind[:-1]]]] if len(behind) else behind
    first = first[again[first] & (times[first - 1] > 1)] if len(first) else first
    stops = np.r_[np.flatnonzero(~again), len(again)]
    n = np.minimum(stops[np.searchsorted(stops, first)], block.offsets[1:][block.owner[first]]) - first
    return np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def pairs(at: np.ndarray, size: np.ndarray, w: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
    """Distinct pairs of windows, first and second, of places whose text goes on before the first, by shard; their shards; each place's pair."""
    one, two = w[at], w[at - size[at]]
    order = np.lexsort((two, one))
    head = np.r_[True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)] if len(at) else np.zeros(0, bool)
    a, b = one[order][head], two[order][head]
    to = shard_of(a, shards)
    by = by_shard(to, shards)
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    which = np.empty(len(at), np.int64)
    which[order] = place[np.cumsum(head) - 1]
    return a[by], b[by], to[by], which


def send_pairs(path: str, at: np.ndarray, held: np.ndarray, own: np.ndarray, size: np.ndarray, w: np.ndarray, shards: int) -> tuple[list[tuple], list[np.ndarray]]:
    """Rows of the pairs of training places at, some of which are their texts' own, and of held places; to keep: shards and pairs of either."""
    one, two, to, which = pairs(at, size, w, shards)
    counts = np.bincount(which, minlength=len(one)).astype(np.uint32)
    mine = np.zeros(len(one), bool)
    mine[which[np.searchsorted(at, own)]] = True
    rows = send_parts(path, CORPUS, to, shards, lambda k: (pack_sorted(one[k]), pack_all([two[k], counts[k], mine[k]])))
    asked_one, asked_two, asked_to, asked_which = pairs(held, size, w, shards)
    rows += send_parts(path, HELD, asked_to, shards, lambda k: (pack_sorted(asked_one[k]), pack_all([asked_two[k]])))
    return rows, [to, which, asked_to, asked_which]


def answer_pairs(table: pa.Table) -> pa.Table:
    """One shard: how far and how often pairs go that are asked for, or are of a training text's own begin; which pairs of the corpus are asked for as a whole."""
    rows = [*zip(*(c.to_pylist() for c in table.columns), strict=True)]
    del table
    out = [(r[0], r[1], HERE, b"", b"") for r in rows if r[2] == HERE]
    corpus, held = ([(r, unpack_sorted(r[3]), *unpack_all(r[4])) for r in rows if r[2] == kind] for kind in (CORPUS, HELD))
    del rows
    low32, by32 = np.uint64(0xFFFFFFFF), np.uint64(32)
    firsts, every = np.unique(joined([p[1] for p in corpus]), return_inverse=True)
    seconds, second = np.unique(joined([p[2] for p in corpus]), return_inverse=True)
    every = every.astype(np.uint64) << by32 | second.astype(np.uint64)
    del second
    order = np.argsort(every)
    counts = joined([p[3] for p in corpus], np.int64)[order]
    every = every[order]
    new = np.r_[True, every[1:] != every[:-1]] if len(every) else np.zeros(0, bool)
    head, number = np.flatnonzero(new), np.empty(len(every), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    known, n = every[head], np.add.reduceat(counts, head) if len(head) else counts
    del every, order, counts, new, head
    sums, says = np.r_[0, np.cumsum(n)], np.zeros(len(known), bool)
    tell = lambda r, kind, said, times, at: (r[0], r[1], kind, pack(said[at]), pack_all([*times[:, at]]))

    asked_firsts, one = np.unique(joined([p[1] for p in held]), return_inverse=True)
    asked_seconds, two = np.unique(joined([p[2] for p in held]), return_inverse=True)
    wanted, which = np.unique(one.astype(np.uint64) << by32 | two.astype(np.uint64), return_inverse=True)
    one, two = asked_firsts[(wanted >> by32).astype(np.int64)], asked_seconds[(wanted & low32).astype(np.int64)]
    at = np.searchsorted(firsts, one)
    there = firsts[np.minimum(at, len(firsts) - 1)] == one if len(firsts) else np.zeros(len(one), bool)
    length, times, whole = search_pairs(known, sums, seconds, np.where(there, at, 0xFFFFFFFE), two)
    says[np.searchsorted(known, at[whole].astype(np.uint64) << by32 | look_up(seconds, two[whole]).astype(np.uint64))] = True
    length |= whole.astype(np.uint8) << 7
    out += [tell(p[0], HELD, length, times, which[here]) for p, here in zip(held, pieces([p[1] for p in held]), strict=True)]

    own = np.zeros(len(known), bool)
    own[number[joined([p[4] for p in corpus], np.uint8) > 0]] = True
    at = np.flatnonzero(own)
    says[at[n[at] > 1]] = True
    length, times, whole = search_pairs(known, sums, seconds, (known[at] >> by32).astype(np.int64), seconds[(known[at] & low32).astype(np.int64)], known=True)
    length |= whole.astype(np.uint8) << 7
    place = np.cumsum(own) - 1
    for p, here in zip(corpus, pieces([p[1] for p in corpus]), strict=True):
        out.append(tell(p[0], OWN, length, times, place[number[here][p[4] > 0]]))
        out.append((p[0][0], p[0][1], CORPUS, pack(says[number[here]]), str(len(p[1])).encode()))
    return pa.Table.from_batches([_row(out)])


def within(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of n places are in any of the ranges, which are equal or apart, and not empty."""
    edge = np.zeros(n + 1, np.int8)
    edge[low] = 1
    edge[distinct(high)] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def answer_ladder(table: pa.Table) -> pa.Table:
    """One shard: how many rungs (hashes of longer and longer contexts; 0: none) of each asked place the corpus has, and how often the last; on which rungs,
    as bits, places stopped that agree with a place of the corpus."""
    rows = [*zip(*(c.to_pylist() for c in table.columns), strict=True)]
    del table
    out = [(r[0], r[1], HERE, b"", b"") for r in rows if r[2] == HERE]
    corpus, held = ([(r, unpack_rungs(r[3])) for r in rows if r[2] == kind] for kind in (CORPUS, HELD))
    weights = np.concatenate([np.zeros(0, np.int64), *(unpack(r[4]) for r, _ in corpus)]).astype(np.int64)
    del rows
    rungs = max([0, *(len(p[1]) for p in corpus + held)])
    cat = lambda parts, k: np.concatenate([np.zeros(0, np.uint64), *(p[k] if k < len(p) else np.zeros(len(p[0]), np.uint64) for _, p in parts)])
    n, m = (sum(len(p[0]) for _, p in parts) for parts in (corpus, held))
    last, times, bits = np.zeros(m, np.uint8), np.zeros(m, np.int64), np.zeros(n, np.uint32)
    # places that agree so far, and by rung who has it in common: one without a rung has none above
    on, there, low, high = np.arange(m), np.arange(n), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(rungs):
        have, ask, before = cat(corpus, k)[there], cat(held, k)[on], there
        order = np.argsort(have)
        order = order[np.searchsorted(have[order], 1) if k else 0 :]  # 0: none
        have, there = have[order], there[order]
        order = np.argsort(ask)
        ask = ask[order]
        a, b = np.searchsorted(have, ask, "left"), np.searchsorted(have, ask, "right")
        some = a < b
        if k:
            stopped = order[~some]
            bits[before[within(len(before), low[stopped], high[stopped])]] |= np.uint32(1 << k - 1)
            sums = np.r_[0, np.cumsum(weights[there])]
            times[on[order[some]]] = sums[b[some]] - sums[a[some]]
            last[on[order[some]]] = k
        on, low, high = on[order[some]], a[some], b[some]
        agree = within(len(there), low, high)
        moved = np.cumsum(agree) - agree
        there, low, high = there[agree], moved[low], moved[high - 1] + 1
    bits[there[within(len(there), low, high)]] |= np.uint32(1 << max(rungs - 1, 0))
    at = 0
    for r, p in corpus:
        out.append((r[0], r[1], CORPUS, pack(bits[at : at + len(p[0])]), str(len(p[0])).encode()))
        at += len(p[0])
    at = 0
    for r, p in held:
        here = slice(at, at + len(p[0]))
        out.append((r[0], r[1], HELD, pack(last[here]), pack(times[here])))
        at += len(p[0])
    return pa.Table.from_batches([_row(out)])


def _answers(table: pa.Table) -> tuple[str, list[tuple]]:
    """A block's path, and what the shards answer it."""
    return table.column("block")[0].as_py(), [*zip(*(table.column(c).to_pylist() for c in ("shard", "kind", "data", "extra")), strict=True)]


def unpack_rungs(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return [*unpack(data[8:]).reshape(-1, n)]


class Search:
    """What a block keeps between rounds, of places that go on only.

    who: numbers among the places asked for, at, length and times: the places, their context so far, gap: what is left of their steps (0: the first
    ladder); place, size, step: the same of training places, with lengths; to, which, place_to, place_which: of either, the shards of the distinct ladders,
    and each place's ladder.
    """

    FIELDS = ("who", "at", "length", "times", "gap", "place", "size", "step", "to", "which", "place_to", "place_which")

    def __init__(self, *values: np.ndarray):
        for k, v in zip(self.FIELDS, values, strict=True):
            setattr(self, k, v)

    def save(self, path: str) -> None:
        put(path, *(getattr(self, k) for k in self.FIELDS))

    @classmethod
    def load(cls, path: str) -> Search:
        return cls(*get(path))


def take(rows, kind: int, to: np.ndarray, kinds: list) -> list[np.ndarray]:
    """What the shards answer for values that are ordered by shard: data, then extra, as arrays of these types."""
    out = [np.zeros(len(to), t) for t in kinds]
    for s, _, data, extra in (r for r in rows if r[1] == kind):
        here = slice(*np.searchsorted(to, (s, s + 1)))
        more = [] if len(kinds) == 1 else [unpack(extra)] if len(kinds) == 2 else unpack_all(extra)
        for o, x in zip(out, [unpack(data), *more], strict=True):
            o[here] = x
    return out


def begin_search(block: Block, rows, kept: list[np.ndarray], shards: int) -> tuple[list[np.ndarray], Search]:
    """From the answers on pairs: the places asked for, lengths and counts of their contexts of up to two windows, the places (numbers among these) that they
    follow, and whether they are of a training text's own begin; then which go on.

    All training places with a held place's window, and all behind it in a run from a text's first window, were sent.  So if the place before occurs as often with
    a word less as this one with two windows, it always goes on with this word: same begin, same count.  For places of a training text's own begin that holds
    where no place before can be missing: its window is no text's first, and is a held text's only if that of the place before is.
    """
    at, held, own, size, says, times, to, which, held_to, held_which = kept
    size = size.astype(np.int64)
    left = block.ordinal + 1
    at_own = np.searchsorted(at, own)
    asked_at = np.r_[held, own]
    mine = np.r_[np.zeros(len(held), bool), np.ones(len(own), bool)]
    kinds = [np.uint8, np.int64, np.int64, np.int64]
    a = [x[held_which] for x in take(rows, HELD, held_to, kinds)]
    is_own = np.zeros(len(to), bool)
    is_own[which[at_own]] = True
    b = [np.zeros(len(to), k) for k in kinds]
    for x, y in zip(b, take(rows, OWN, to[is_own], kinds), strict=True):
        x[is_own] = y
    said, now, one_less, two_less = (np.r_[x, y[which[at_own]]] for x, y in zip(a, b, strict=True))
    order = np.argsort(asked_at, kind="stable")
    asked_at, mine, said, now, one_less, two_less = (x[order] for x in (asked_at, mine, said, now, one_less, two_less))
    whole, words_ = said >> 7 > 0, (said & 0x7F).astype(np.int64)
    length = size[asked_at] + words_
    often = np.where(words_ > 0, now, times[asked_at])
    if len(asked_at):  # what precedes a place of a text's own begin and occurs once does so further on
        k = np.arange(len(asked_at))
        begin = np.maximum.accumulate(np.where(np.r_[True, block.owner[asked_at[1:]] != block.owner[asked_at[:-1]]], k, 0))
        often = np.where(mine & (np.maximum.accumulate(np.where(mine & (often == 1), k, -1)) >= begin), 1, often)
    goes_on = whole & (left[asked_at] > length) & ~(mine & (often == 1))
    linked = np.zeros(len(asked_at), bool)
    if len(asked_at):
        j = np.flatnonzero((asked_at[1:] == asked_at[:-1] + 1) & (block.ordinal[asked_at[1:]] > 0) & whole[1:] & whole[:-1]) + 1
        i, want = j - 1, length[j] - 1
        have = np.where(want == length[i], now[i], np.where(want == length[i] - 1, one_less[i], np.where(want == length[i] - 2, two_less[i], -1)))
        same = (want > size[asked_at[i]]) & (have == now[j])
        flags, before = says[asked_at[j]], says[asked_at[i]]
        same &= ~mine[j] | ((flags & IS_FIRST == 0) & ((flags & IN_HELD == 0) | (before & IN_HELD > 0)))
        linked[j[same]] = True
    head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(linked)))) if len(linked) else np.zeros(0, np.int64)
    who = np.flatnonzero(goes_on & ~linked)
    flagged = take(rows, CORPUS, to, [np.uint8])[0][which] > 0
    two = size[at] + size[at - size[at]]
    on = flagged & (left[at] > two)
    place = at[on]
    none = np.zeros(0, np.int64)
    search = Search(who, asked_at[who], length[who], often[who], np.zeros(len(who), np.int64), place, two[on], np.zeros(len(place), np.int64), none, none, none, none)
    return [asked_at, length, often, head, mine], search


def go_on(block: Block, search: Search, rows) -> list[np.ndarray]:
    """Takes a ladder's answers: contexts grow by the rungs that were found, and steps shrink; places that are done, and training places nobody needs, go.

    Returns the numbers, lengths and counts of those that are done.
    """
    last, times = (x[search.which] for x in take(rows, HELD, search.to, [np.uint8, np.int64]))
    bits = take(rows, CORPUS, search.place_to, [np.uint32])[0][search.place_which]

    def moved(gap, rung):
        rung = rung.astype(np.int64)
        first = gap == 0
        top = np.where(first, np.int64(LADDER) ** rung, 1)
        return np.where(first, np.where(rung > 0, top, 0), gap * rung), np.where(first, top * LADDER // STEPS, gap // STEPS)

    more, gap = moved(search.gap, last)
    length, often = search.length + more, np.where(last > 0, times, search.times)
    keep = (gap > 0) & (block.left(search.at) > length)
    done = [search.who[~keep], length[~keep], often[~keep]]
    search.who, search.at, search.length, search.times, search.gap = (x[keep] for x in (search.who, search.at, length, often, gap))
    place, size, step, left = [], [], [], block.left(search.place)
    for k in range(int(bits.max(initial=0)).bit_length()):
        on = np.flatnonzero(bits >> np.uint32(k) & np.uint32(1))
        more, gap = moved(search.step[on], np.full(len(on), k))
        grown = search.size[on] + more
        keep = (gap > 0) & (left[on] > grown)
        place.append(search.place[on][keep])
        size.append(grown[keep])
        step.append(gap[keep])
    search.place, search.size, search.step = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (place, size, step))
    return done


def send_ladder(path: str, block: Block | None, search: Search, shards: int) -> list[tuple]:
    """Rows of the distinct ladders of all places that go on, and of the training places that may agree with how many have each."""
    rows = [(0, path, HERE, b"", b"")]
    if not len(search.who) and not len(search.place):
        search.to = search.which = search.place_to = search.place_which = np.zeros(0, np.int64)
        return rows
    last, hashes = len(block.local) - 1, Stretches(block.words[block.local[::-1]])

    def ladder(place, size, step) -> list[np.ndarray]:
        salt = mix((size << 32 | step).astype(np.uint64))
        out = [mix(hashes.of(last - place, size) ^ salt)]
        left = block.left(place)
        most = int((left - size).max(initial=0))
        first = bool(len(step)) and step[0] == 0
        for k in range(1, STEPS) if not first else range(1, 32):
            if first and LADDER**k > most:
                break
            grown = size + (LADDER**k if first else step * k)
            some = np.flatnonzero(left >= grown)
            rung = np.zeros(len(place), np.uint64)
            rung[some] = mix(hashes.of(last - place[some], grown[some]) ^ salt[some]) | np.uint64(1)
            out.append(rung)
        return out

    for kind, place, size, step in ((HELD, search.at, search.length, search.gap), (CORPUS, search.place, search.size, search.step)):
        rungs = ladder(place, size, step)
        same = rungs[0].copy()
        for k, x in enumerate(rungs[1:]):
            same += x * np.uint64(2 * k + 3)
        order = np.argsort(same)
        new = np.r_[True, np.diff(same[order]) != 0] if len(same) else np.zeros(0, bool)
        which, index = np.empty(len(same), np.int64), order[new]
        which[order] = np.cumsum(new) - 1
        n = np.bincount(which, minlength=len(index))
        to = (rungs[0][index] >> np.uint64(33)).astype(np.int64) * shards >> 31
        order = by_shard(to, shards)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        to, which, table, n = to[order], back[which], np.stack(rungs)[:, index[order]], n[order].astype(np.uint32)
        if kind == HELD:
            search.to, search.which = to, which
        else:
            search.place_to, search.place_which = to, which
        extra = lambda k, kind=kind, n=n: pack(n[k]) if kind == CORPUS else b""
        rows += send_parts(path, kind, to, shards, lambda k, table=table, extra=extra: (np.int64(k.stop - k.start).tobytes() + pack(table[:, k].ravel()), extra(k)))
    return rows


def found(block: Block, at: np.ndarray, size: np.ndarray, often: np.ndarray, head: np.ndarray, own: np.ndarray, length: np.ndarray, times: np.ndarray) -> None:
    """Sets the lengths and counts of the places asked for; places that follow another have its begin and count, those of a text's own begin all before."""
    length[at] = np.where(own, block.left(at), size[head] + at - at[head])
    times[at] = often[head]


def score_block(block: Block, length: np.ndarray, times: np.ndarray, count: np.ndarray, total: int, vocabulary: int):
    """n_tokens, n_known, base_score, score of every text of a block."""
    base = (count + 0.5) / (total + 0.5 * (vocabulary + 1))
    c, base, log_base = count[block.local], base[block.local], np.log10(base)[block.local]
    start = block.ordinal == 0
    before = np.where(start, 0, np.arange(len(c)) - 1)
    l, n = np.where(start, 0, length[before]), np.where(start, total, times[before]).astype(np.float64)
    m = weight(np.arange(1 + int(l.max(initial=0))))[l]
    p = (np.where(length == l + 1, times, 0) + m * base) / (n + m)
    add = lambda x: np.add.reduceat(x, block.offsets[:-1]) if len(block.sizes) else x
    return block.sizes, add((c > 0).astype(np.int64)), add(log_base), add(np.log10(p))


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=None, shard_tokens: int = SHARD_TOKENS, shard_windows: int = SHARD_WINDOWS, dictionary: int = DICTIONARY) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score; held: a column, true for rows not to learn from."""
    spark = df.sparkSession
    bounded_batches(spark)
    held = crc_mod(F.col(id_col), 5) == 1 if held is None else held
    docs = df.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    folder = new_folder(spark)
    words, codes_path, least, total, vocabulary = count_words(docs, folder, dictionary)
    shards = max(1, -(-total // shard_windows))
    sent = send(docs, folder, codes_path, least, shards)
    if least > 1:

        def deal(batches):
            for batch in batches:
                h, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
                to = (mix(h) >> np.uint64(33)).astype(np.int64) * shards >> 31
                yield _row([(s, "", RARE, pack(h[to == s]), pack(n[to == s])) for s in np.unique(to).tolist()])

        sent = sent.unionByName(words.where(F.col("n") < least).select("h", "n").mapInArrow(deal, _ROWS))
    answers = store(sent.groupBy("shard").applyInArrow(answer, _ROWS), "ngram-answers")
    settle(spark)

    deep_shards = max(1, -(-total // shard_tokens))

    def join(table: pa.Table) -> pa.Table:
        path, rows = _answers(table)
        block = load(path)
        length, times, deep, again, size, count, w, says = merge(block, _codes(codes_path), rows, shards, least, total)
        corpus, held_at, own = np.flatnonzero(deep & ~block.in_held), np.flatnonzero(deep & block.in_held), own_places(block, times, again, size)
        out, kept = send_pairs(path, corpus, held_at, own, size.astype(np.int64), w, deep_shards)
        put(path + ".short", np.diff(length, prepend=np.int32(0)), times, count)
        put(path + ".pairs", corpus, held_at, own, size, says, times, *kept)
        return pa.Table.from_batches([_row([(0, path, HERE, b"", b""), *out])])

    def climb(k: int, shards: int):
        def each(table: pa.Table) -> pa.Table:
            path, rows = _answers(table)
            if k == 0:
                block = load(path)
                places, search = begin_search(block, rows, get(path + ".pairs"), deep_shards)
                put(path + ".asked", *places)
            else:
                search = Search.load(f"{path}.{k - 1}")
                some = len(search.who) or len(search.place)
                block = load(path) if some else None
                put(f"{path}.done.{k}", *(go_on(block, search, rows) if some else [search.who] * 3))
            out = send_ladder(path, block, search, shards)
            search.save(f"{path}.{k}")
            drop(path + ".pairs" if k == 1 else f"{path}.{k - 2}" if k > 1 else "")
            return pa.Table.from_batches([_row(out)])

        return each

    def by_block(table: DataFrame, f, kind: str = _ROWS) -> DataFrame:
        return table.where("block != ''").repartition(parts, "block").groupBy("block").applyInArrow(f, kind)

    parts, k = max(spark.sparkContext.defaultParallelism, -(-total // (4 * BLOCK_TOKENS))), 0
    answers = store(by_block(answers, join).groupBy("shard").applyInArrow(answer_pairs, _ROWS), "ngram-pairs")
    while True:
        settle(spark)
        state = answers.agg(F.sum(F.when(F.col("kind") == CORPUS, F.col("extra").cast("string").cast("long"))), F.max((F.col("kind") == HELD).cast("int"))).first()
        if k and not state[1]:  # no place went on
            break
        shards_now = max(1, -(-(state[0] or 0) // max(1, shard_tokens // 4)))
        answers = store(by_block(answers, climb(k, shards_now)).groupBy("shard").applyInArrow(answer_ladder, _ROWS), "ngram-ladder")
        k += 1

    def score(table: pa.Table) -> pa.Table:
        path, _ = _answers(table)
        block, (length, times, count), (at, size, often, head, own) = load(path), get(path + ".short"), get(path + ".asked")
        length = np.cumsum(length, dtype=np.int64)
        for step in range(1, k):
            who, more, n = get(f"{path}.done.{step}")
            size[who], often[who] = more, n
        found(block, at, size, often, head, own.astype(bool), length, times)
        n, known, base, score = score_block(block, length, times, count, total, vocabulary)
        return pa.table([pa.array(block.ids, mask=block.null), pa.array(block.held), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), total)), pa.array(base), pa.array(score)], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return by_block(answers, score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)


def op9_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))


QUERIES = {"op9_ngram": op9_ngram}
ORACLE: dict[str, str] = {}
