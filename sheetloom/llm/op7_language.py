"""Language ID: a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample of labelled rows (about ``per_language`` rows a language,
whole texts).  A text's UTF-8 is cut into windows of ``WINDOW`` bytes; both directions read every window, every byte gets a distribution over the
languages, and the document's is the mean over all its bytes.

Defined results: ``und`` with score 0 for a null text, a text without a letter, and everything if there is nothing to learn from; ties go to
the language that sorts first; repeated rows are predicted each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, read, text_bytes

HIDDEN, WINDOW = 8, 64
PER_LANGUAGE = 400
_LETTER = re.compile(r"[^\W\d_]")
_LANES = 2048


class ByteGru:
    """Weights by direction: table [3H, 256] of what each byte adds, u [3H, H]; out [L, 2H], bias [L].  Gates: update, reset, new.

    x / (1 + |x|) stands for the hyperbolic tangent, and half of it plus a half for the logistic function; they cost a fraction.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[d + "table"] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
            self.w[d + "u"] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)
        self.w["out"] = rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32)
        self.w["bias"] = np.zeros((len(languages), 1), np.float32)

    def _walk(self, d: str, x: np.ndarray, keep: bool):
        """Hidden states [T, H, B] of one direction over bytes [T, B]; with keep also what backpropagation needs."""
        h, (steps, lanes) = self.hidden, x.shape
        table, u = self.w[d + "table"], self.w[d + "u"]
        states = np.empty((steps, h, lanes), np.float32)
        state = np.zeros((h, lanes), np.float32)
        a, g = np.empty((3 * h, lanes), np.float32), np.empty((3 * h, lanes), np.float32)
        below = np.empty((2 * h, lanes), np.float32)
        saved = [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, state, out=g)
            zr = g[: 2 * h]
            zr += a[: 2 * h]
            np.abs(zr, out=below)
            below += 1
            zr /= below
            zr *= 0.5
            zr += 0.5
            if keep:
                saved[t] = (state, zr.copy(), g[2 * h :].copy())
            new = g[2 * h :]
            new *= zr[h:]
            new += a[2 * h :]
            np.abs(new, out=below[:h])
            below[:h] += 1
            new /= below[:h]
            following = states[t]
            np.subtract(state, new, out=following)
            following *= zr[:h]
            following += new
            if keep:
                saved[t] += (new.copy(),)
            state = following
        return states, saved

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Distributions [T, L, B] over the languages for bytes [T, B]."""
        f, b = self._walk("f", x, False)[0], self._walk("b", x, False)[0]
        h = self.hidden
        p = np.matmul(self.w["out"][:, :h], f) + np.matmul(self.w["out"][:, h:], b) + self.w["bias"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over masked positions [T, B], labels y [B], and its gradients."""
        h, (steps, lanes) = self.hidden, x.shape
        walks = {d: self._walk(d, x, True) for d in "fb"}
        both = np.concatenate([walks["f"][0], walks["b"][0]], axis=1)
        p = np.matmul(self.w["out"], both) + self.w["bias"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        scale = mask.astype(np.float32) / max(1, mask.sum())
        loss = float(-(np.log(p[:, y, np.arange(lanes)] + 1e-9) * scale).sum())
        p[:, y, np.arange(lanes)] -= 1
        p *= scale[:, None, :]
        grads = {"out": np.einsum("tlb,thb->lh", p, both, optimize=True), "bias": p.sum(axis=(0, 2))[:, None]}
        into = np.matmul(self.w["out"].T, p)
        for k, d in enumerate("fb"):
            u, saved = self.w[d + "u"], walks[d][1]
            du, carried = np.zeros_like(u), np.zeros((h, lanes), np.float32)
            by_byte = np.empty((steps, 3 * h, lanes), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                before, zr, s, new = saved[t]
                z, r = zr[:h], zr[h:]
                up = carried + into[t, k * h : (k + 1) * h]
                dnew = up * (1 - z) * (1 - np.abs(new)) ** 2
                dz = up * (before - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dr = dnew * s * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                inner = np.concatenate([dz, dr, dnew * r])
                du += inner @ before.T
                carried = up * z + u.T @ inner
                by_byte[t, : 2 * h] = inner[: 2 * h]
                by_byte[t, 2 * h :] = dnew
            grads[d + "u"] = du
            flat = x.ravel()
            grads[d + "table"] = np.stack([np.bincount(flat, by_byte[:, j].ravel(), 256) for j in range(3 * h)]).astype(np.float32)
        return loss, grads

    def train(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rounds: int = 500, lanes: int = 192, rate: float = 0.02, seed: int = 11) -> "ByteGru":
        """Adam on batches in which all languages are equally frequent."""
        rng = np.random.default_rng(seed)
        pools = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for step in range(1, rounds + 1):
            pick = np.concatenate([rng.choice(p, max(1, lanes // len(pools))) for p in pools])
            mask = np.arange(windows.shape[1])[:, None] < lengths[pick]
            _, grads = self.gradients(windows[pick].T.copy(), labels[pick], mask)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            speed = rate * min(1.0, 1.0 / (norm + 1e-9)) * (1 - step / (rounds + 1))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] = (self.w[k] - speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean distribution [n, L] over all bytes of each text; zeros for empty ones."""
        n = len(offsets) - 1
        total = np.zeros((n, len(self.languages)))
        windows, lengths, owner = cut(data, offsets)
        for k in range(0, len(owner), _LANES):
            part = slice(k, k + _LANES)
            p = self.positions(np.ascontiguousarray(windows[part].T))
            full = lengths[part] == WINDOW
            sums = p.sum(axis=0)  # [L, B]
            if not full.all():
                some = np.flatnonzero(~full)
                mask = np.arange(WINDOW)[:, None] < lengths[part][some]
                sums[:, some] = np.einsum("tlb,tb->lb", p[:, :, some], mask.astype(np.float32))
            who = owner[part]
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            total[who[first]] += np.add.reduceat(sums.astype(np.float64), first, axis=1).T
        return total / np.maximum(offsets[1:] - offsets[:-1], 1)[:, None]


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows [n, WINDOW] of bytes (zeros after the end), their lengths, and the text each belongs to."""
    sizes = offsets[1:] - offsets[:-1]
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    ordinal = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][owner] + ordinal * WINDOW
    lengths = np.minimum(WINDOW, offsets[1:][owner] - starts)
    at = np.arange(WINDOW, dtype=np.int32)
    windows = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(WINDOW, np.uint8)], WINDOW)[starts]
    windows[at >= lengths[:, None]] = 0
    return windows, lengths, owner


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ByteGru | None:
    """Learns from rows with text and lang whose crc32 of the id as text, modulo 4, isn't 2.

    The sample: whole texts of rows whose hash falls under per_language / (rows of their language); of all these at most twice per_language times the
    languages, those of the least hashes.
    """
    rows = docs.where((crc_mod(F.col("doc_id"), 4) != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, per_language / n))), F.col("lang"))
    sample = (
        rows.withColumn("turn", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(3)), F.lit(1_000_003)))
        .where(F.col("turn") < share * 1_000_003)
        .select("turn", "doc_id", "lang", "text")
        .orderBy("turn", "doc_id", F.xxhash64("text"))
        .limit(2 * per_language * len(counts))
        .toArrow()
        .sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    )
    if not sample.num_rows:
        return None
    data, offsets = text_bytes(sample.column("text"))
    windows, lengths, owner = cut(data, offsets)
    found = sorted(set(sample.column("lang").to_pylist()))
    labels = np.array([found.index(x) for x in sample.column("lang").to_pylist()])[owner]
    if not len(labels):
        return None
    found_in = sorted(set(labels.tolist()))
    model = ByteGru([found[k] for k in found_in])
    return model.train(windows, lengths, np.searchsorted(found_in, labels))


def identify(df: DataFrame, model: ByteGru | None, text_col: str = "text") -> DataFrame:
    """All columns of df with lang_pred and score, which replace columns of these names."""
    df = df.drop("lang_pred", "score")
    k, names = df.columns.index(text_col), [*df.columns, "lang_pred", "score"]

    def run(batches):
        for batch in batches:
            texts = batch.column(k)
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            letters = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            if model is not None and letters.any():
                p = model.documents(*text_bytes(texts))
                best = p.argmax(axis=1)
                lang[letters] = np.array(model.languages, object)[best][letters]
                score[letters] = np.clip(p.max(axis=1), 0, 1)[letters].round(6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang.tolist(), pa.string()), pa.array(score)], names)

    bounded_batches(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", lang_pred string, score double"
    return df.mapInArrow(run, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out")), fit(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op7_language": op7_language}
ORACLE: dict[str, str] = {}
