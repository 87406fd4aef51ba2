"""BPE encoding and decoding, long unsplit text by tree concatenation.

Texts in which the tokenizer splits often are encoded as they are.  A run that it doesn't split and that is longer than ``leaf`` characters
becomes a balanced tree: its leaves are encoded in one parallel batch, and
neighbours are joined level by level: a window of tokens on either side of the join is decoded and encoded anew, and grows until the first and
the last token agree with those of both sides.  Adjacent pairs of tokens decide whether a whole sequence is the encoding of its text, so the
result is exactly the library's.

Defined results: null counts as the empty text (no tokens, hashes of the empty string); ties can't occur; repeated rows are encoded each;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, read

LEAF = 1024


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(256 + k)] = b
    return table


class ByteBpe:
    """Encoder and decoder of a byte-level vocabulary file."""

    def __init__(self, path: str, leaf: int = LEAF):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        size = max(max(spec["model"]["vocab"].values()), *(t["id"] for t in spec["added_tokens"])) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token)
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.decimal = [str(i) for i in range(size)]
        self.leaf = leaf
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.fast = self._rank_coder(spec)

    def _rank_coder(self, spec: dict):
        """The same merges as ranks, where ids follow the order of the merges; None otherwise."""
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        if any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(merges)) or len(vocab) != 256 + len(merges):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=self.split.pattern, mergeable_ranks={self.bytes_of[i]: i for i in vocab.values()}, special_tokens={})._core_bpe

    def encode_all(self, pieces: list[str]) -> list[list[int]]:
        """Without the tree.  The rank coder takes what is all in Latin-1, where both libraries know the same classes of characters."""
        out: list[list[int] | None] = [None] * len(pieces)
        rest = []
        for k, piece in enumerate(pieces):
            try:
                piece.encode("latin-1")
                out[k] = self.fast.encode_ordinary(piece) if self.fast else None
            except UnicodeEncodeError:
                pass
            if out[k] is None:
                rest.append(k)
        if not rest:
            return out
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the text of both, from their encodings."""
        k = 4
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            raw = b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b]))
            while a > 0 and raw[0] & 0xC0 == 0x80:  # the window begins and ends between characters
                a -= 1
                raw = self.bytes_of[left[a]] + raw
            while b < len(right) and self.bytes_of[right[b]][0] & 0xC0 == 0x80:
                raw += self.bytes_of[right[b]]
                b += 1
            window = self.encode_all([raw.decode("utf-8")])[0]
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            k *= 2

    def encode_tree(self, run: str) -> list[int]:
        """A run that the tokenizer doesn't split."""
        parts = self.encode_all([run[k : k + self.leaf] for k in range(0, len(run), self.leaf)])
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]

    def unsplit(self, text: str) -> bool:
        """Whether some window of half a leaf has no blank or nothing else; every longer run without a split covers one."""
        h = self.leaf // 2
        if len(text) <= self.leaf:
            return False
        for k in range(0, len(text) - h + 1, h):
            if text.find(" ", k, k + h) < 0 or text[k : k + h].isspace():
                return True
        return False

    def encode(self, texts: list[str]) -> list[list[int]]:
        """As the library does: strings of special tokens become these, what is between them is encoded by itself."""
        parted = [self.specials.split(t) if any(s in t for s in self.special) else [t] for t in texts]
        plain = iter(self.encode_plain([p for parts in parted for p in parts[::2]]))
        out = []
        for parts in parted:
            ids = next(plain)
            for special in parts[1::2]:
                ids = [*ids, self.special[special], *next(plain)]
            out.append(ids)
        return out

    def encode_plain(self, texts: list[str]) -> list[list[int]]:
        long = [k for k, t in enumerate(texts) if self.unsplit(t)]
        hard = set(long)
        out = self.encode_all(["" if k in hard else t for k, t in enumerate(texts)])
        for k in long:
            ids: list[int] = []
            pending: list[str] = []  # neighbouring short runs are encoded at once
            for run in self.split.findall(texts[k]):
                if len(run) <= self.leaf:
                    pending.append(run)
                    continue
                for part in self.encode_all(pending):
                    ids += part
                pending = []
                ids += self.encode_tree(run)
            for part in self.encode_all(pending):
                ids += part
            out[k] = ids
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library decodes, special tokens included; ids outside the vocabulary have no text."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@cache
def coder(path: str) -> ByteBpe:
    return ByteBpe(path)


def slices(texts: list[str], characters: int = 2_000_000):
    """Consecutive runs of texts of about so many characters together."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= characters:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id and ids array<int> of every text."""
    path = path or default_path("byte_bpe_50k.json")

    def run(batches):
        for batch in batches:
            ids = [x for part in slices([t or "" for t in batch.column(1).to_pylist()]) for x in coder(path).encode(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    bounded_batches(df.sparkSession)
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_documents(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id and text of every array of ids."""
    path = path or default_path("byte_bpe_50k.json")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else coder(path).decode(x) for x in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    bounded_batches(df.sparkSession)
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path("byte_bpe_50k.json")

    def run(batches):
        bpe = coder(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for part in slices([t or "" for t in batch.column(1).to_pylist()]):
                for ids in bpe.encode(part):
                    n.append(len(ids))
                    ids_sha.append(sha(",".join(map(bpe.decimal.__getitem__, ids)).encode()))
                    text_sha.append(sha(bpe.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(spark)
    return read(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op5_bpe": op5_bpe}
ORACLE: dict[str, str] = {}
