"""Packing: hierarchical multi-length sequences.

Every document (its ids, then id 1) is routed to the smallest of several context sizes that holds it; longer ones give full long windows and a rest.
A window opens with the longest piece left and has that piece's tier; its gap is filled from shorter tiers, the largest piece that fits first, and
the last gap by a cut of the shortest piece.  So windows are full; only what is left at the end of a block is cut into sequences whose lengths
are powers of two, which need no padding.  Step groups of equal token counts take whole windows, largest first.

Blocks are runs of documents of one input partition of about ``block_tokens`` tokens: no shuffle, bounded memory, and the same result when a
task runs again.

Defined results: a null or empty text is the single id 1; repeated rows are packed each; ties between pieces of one length go to the later row;
extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, read
from .op5_bpe import byte_alphabet, default_path

TIERS = (256, 512, 1024, 2048)
END = 1
BLOCK_TOKENS = 1 << 18
STEP_TOKENS = 1 << 16
#: Words that a worker remembers at most; then only short ones stay. It changes speed only.
REMEMBERED = 500_000


class _Words(dict):
    """What a worker remembers; a new word is encoded when it is first looked up."""

    def __init__(self, encode, known=()):
        super().__init__(known)
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.encode(word)
        return ids


class WordBpe:
    """Encoder of a vocabulary with word ends: blanks separate words, so each blank-separated piece is encoded once and remembered as packed ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = _Words(self._encode_word)
        self.ranks = self._rank_coder(spec)
        letters = "".join(c for c in map(chr, range(128, 256)) if c.isalpha())
        numbers = "²³¹¼½¾"
        self.latin = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z{letters}]+|[0-9{numbers}]|[^\\s\\x85\\xa0a-zA-Z{letters}0-9{numbers}]+")
        self.odd = re.compile("[^\x20-\x7e\xa1-\xff]")

    @staticmethod
    def _rank_coder(spec: dict):
        """The merges as ranks over bytes, with byte 255 for the end of a word, and from these ranks to ids; None where the file has another form."""
        model = spec["model"]
        if model.get("end_of_word_suffix") != "</w>":
            return None
        alphabet = byte_alphabet()
        raw = lambda t: bytes(map(alphabet.__getitem__, t[:-4])) + b"\xff" if t.endswith("</w>") else bytes(map(alphabet.__getitem__, t))
        ranks = {bytes((b,)): b for b in range(256)}
        ids = [model["vocab"].get(c, 0) for c in sorted(alphabet, key=alphabet.get)]
        for c, b in sorted(alphabet.items(), key=lambda x: x[1]):
            if b < 255:
                ranks[bytes((b, 255))] = len(ids)
                ids.append(model["vocab"][c + "</w>"])
        for a, b in model["merges"]:
            ranks[raw(a + b)] = len(ids)
            ids.append(model["vocab"][a + b])
        if len(ranks) != len(ids):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece, [np.uint32(i).tobytes() for i in ids]

    def _encode_word(self, word: str) -> bytes:
        if self.ranks is None or len(word) > 400 or self.odd.search(word):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        one, packed = self.ranks
        word = word.lower()
        if word.isalpha():
            return b"".join(map(packed.__getitem__, one(word.encode() + b"\xff")))
        return b"".join([packed[i] for run in self.latin.findall(word) for i in one(run.encode() + b"\xff")])

    def _plain(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > REMEMBERED:
            few = {w: v for w, v in self.words.items() if len(w) <= 7}
            self.words = _Words(self._encode_word, few if len(few) < REMEMBERED // 2 else ())
        ids_of = self.words.__getitem__
        return [b"".join(map(ids_of, t.replace("\n", " ").split(" "))) for t in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, as the library gives them (strings of special tokens become these)."""
        parted = [self.specials.split(t) if "<|" in t else [t] for t in texts]
        plain = iter(self._plain([p for parts in parted for p in parts[::2]]))
        out = []
        for parts in parted:
            ids = next(plain)
            for special in parts[1::2]:
                ids += np.uint32(self.special[special]).tobytes() + next(plain)
            out.append(ids)
        return out


@cache
def coder(path: str) -> WordBpe:
    return WordBpe(path)


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every token once; each as long as a tier, but for lengths of powers of two at the end."""
    top = tiers[-1]
    out, pool = [], []
    for doc, n in enumerate(lengths):
        full = n // top * top
        out += [[(doc, k, top)] for k in range(0, full, top)]
        if n > full:
            pool.append((n - full, doc, full))
    pool.sort()
    while pool:
        n, doc, start = pool.pop()
        size = tiers[bisect_left(tiers, n)]
        window, gap = [(doc, start, n)], size - n
        while gap and pool:
            k = bisect_right(pool, (gap, len(lengths), 0)) - 1
            if k >= 0:
                n, doc, start = pool.pop(k)
                window.append((doc, start, n))
                gap -= n
            else:
                n, doc, start = pool.pop(0)
                window.append((doc, start, gap))
                insort(pool, (n - gap, doc, start + gap))
                gap = 0
        if not gap:
            out.append(window)
            continue
        left, held = size - gap, iter(window)
        doc, start, n = next(held)
        for size in (1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1):
            part = []
            while size:
                if not n:
                    doc, start, n = next(held)
                m = min(size, n)
                part.append((doc, start, m))
                start, n, size = start + m, n - m, size - m
            out.append(part)
    return out


def steps(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step for each sequence: largest first into the step that is being filled; sizes are powers of two, so all steps but the last are exactly full."""
    out, at, filled = [0] * len(sizes), 0, 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if filled + sizes[k] > step_tokens and filled:
            at, filled = at + 1, 0
        out[k] = at
        filled += sizes[k]
    return out


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
_SCHEMA = ", ".join(f"{n} long" for n in _NAMES)


def pack_documents(df: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: where it is in the document and in its sequence, and with_ids the ids themselves."""
    path = path or default_path("word_bpe_49k.json")
    if any(t & (t - 1) for t in tiers) or [*tiers] != sorted(set(tiers)):
        raise ValueError("tiers are increasing powers of two")

    def run(batches):
        part = TaskContext.get().partitionId() << 40
        sequences = groups = 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        waiting = 0

        def flush():
            nonlocal sequences, groups
            made = pack([*map(len, held)], tiers)
            sizes = [sum(n for _, _, n in s) for s in made]
            of = steps(sizes, step_tokens)
            rows, ids = [], []
            for k, s in enumerate(made):
                offset = 0
                for doc, start, n in s:
                    piece = held[doc][start : start + n]
                    rows.append((docs[doc], start, n, zlib.crc32(piece), len(held[doc]), part + sequences + k, offset, sizes[k], part + groups + of[k]))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
                    offset += n
            sequences, groups = sequences + len(made), groups + max(of, default=-1) + 1
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, _NAMES + ["ids"] * with_ids)

        bpe, end = coder(path), np.uint32(END).tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k in range(0, len(texts), 500):
                docs += batch.column(0).slice(k, 500).to_pylist()
                new = [np.frombuffer(x + end, "<u4") for x in bpe.encode([t or "" for t in texts[k : k + 500]])]
                held += new
                waiting += sum(map(len, new))
                if waiting >= block_tokens:
                    yield flush()
                    docs, held, waiting = [], [], 0
        if held:
            yield flush()

    bounded_batches(df.sparkSession)
    return df.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, _SCHEMA + ", ids array<int>" * with_ids)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
ORACLE: dict[str, str] = {}
