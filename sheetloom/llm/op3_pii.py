"""PII: base patterns, and bootstrapped contextual extraction.

Base entities are the seeds.  Every identifier-like token (one with a digit or an @) is an instance; the words before and after it are its
lexical patterns.  Spark scores the pattern-instance graph in rounds: a pattern's confidence for a kind is the share of its distinct
instances that are known to be of that kind, an instance's is the noisy-or of its patterns' (seeds: 1).  Patterns of enough support and
confidence then discover identifiers that no base pattern fits; these come as kinds ``ctx_email`` and so on.

Defined results: null and empty texts have no spans; repeated rows are reported each; a token that touches a base span is no new instance;
ties between kinds go to the kind listed first; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read, store

KINDS = ("email", "ip", "card", "phone")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCALS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'()[]{}<>,;:!?."


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As finditer of the whole pattern, but each run of name characters is read once."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCALS:
            start -= 1
        m = _HOST.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", max(at + 1, floor if m else 0))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _ANY.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def _word(text: str, at: int, step: int, edge: int) -> tuple[str, int]:
    """The word that ends before at (step -1) or begins at it (1), lower case without marks at its edges, and its far end; nothing is read beyond edge."""
    k = at
    if step < 0:
        while at > edge and text[at - 1] in " \t":
            at -= 1
        k = at
        while k > edge and not text[k - 1].isspace():
            k -= 1
        return text[k:at].strip(_EDGE).lower(), k
    while at < edge and text[at] in " \t":
        at += 1
    k = at
    while k < edge and not text[k].isspace():
        k += 1
    return text[at:k].strip(_EDGE).lower(), k


def patterns(text: str, start: int, end: int, floor: int = 0, ceiling: int | None = None) -> list[str]:
    """Lexical patterns of a place: the word before, the two words before, the words before and after; long ones by a digest of the whole."""
    one, k = _word(text, start, -1, floor)
    two, _ = _word(text, k, -1, floor)
    after, _ = _word(text, end, 1, len(text) if ceiling is None else ceiling)
    found = [p for p, on in ((f"1 {one}", one), (f"2 {two} {one}", one and two), (f"3 {one} _ {after}", one and after)) if on]
    return [p if len(p) <= 64 else f"{p[0]} #" + hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for p in found]


def instances(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int, list[str]]]:
    """Seeds with their kind, and identifier-like tokens that touch no seed; with patterns."""
    taken = sorted((a, b) for _, a, b in base)
    # a seed's words end at its neighbours, so that a list of many identifiers without blanks is read once
    reach = dict(zip(taken, zip([0, *accumulate((b for _, b in taken), max)], [*(a for a, _ in taken[1:]), len(text)], strict=False), strict=False))
    out = [(kind, a, b, patterns(text, a, b, min(reach[a, b][0], a), max(reach[a, b][1], b))) for kind, a, b in base]
    if _ANY.search(text):
        k = 0
        for m in _TOKEN.finditer(text):
            if not _ANY.search(text, m.start(), m.end()):
                continue
            raw = m.group()
            a = m.start() + len(raw) - len(raw.lstrip(_EDGE))
            b = m.end() - (len(raw) - len(raw.rstrip(_EDGE)))
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if b <= a or any(x < b and a < y for x, y in taken[k : k + 2]):
                continue
            if p := patterns(text, m.start(), m.end()):
                out.append((None, a, b, p))
    return out


_FOUND = "array<struct<kind:string,start:long,end:long,value:string,patterns:array<string>>>"
_SCAN = f"doc_id long, base array<string>, found {_FOUND}"


def scan(df: DataFrame) -> DataFrame:
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches):
        for batch in batches:
            bases, founds = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                bases.append([f"{k}:{a}:{b}" for k, a, b in base])
                founds.append([{"kind": k, "start": a, "end": b, "value": hashlib.sha256(text[a:b].lower().encode("utf-8", "surrogatepass")).hexdigest()[:16], "patterns": p} for k, a, b, p in instances(text, base)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, pa.list_(pa.string())), pa.array(founds, found_type)], ["doc_id", "base", "found"])

    bounded_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCAN).withColumn("row", F.monotonically_increasing_id())


def bootstrap(edges: DataFrame, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """edges: pattern, value, kind (null: unknown), each pair once.  Returns value, kind, score of unknown instances worth reporting.

    Rounds go on until none finds anything new; what is found stays.  Hot patterns are only aggregated; what is joined by pattern are those of high
    confidence.
    """
    seeds = edges.where("kind IS NOT NULL").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    total = edges.groupBy("pattern").agg(F.countDistinct("value").alias("total")).where(F.col("total") >= support)
    known = store(seeds, "pii-known")
    pairs = edges.select("pattern", "value").distinct()
    unknown = edges.where("kind IS NULL").select("pattern", "value").distinct()
    while True:
        scored = (
            pairs.join(known, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("hits"))
            .join(total, "pattern")
            .withColumn("confidence", F.col("mass") / (F.col("total") + 0.1))
            .where((F.col("confidence") >= confidence) & (F.col("hits") >= support))
        )
        found = unknown.join(scored, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.99)))))).alias("score"))
        best = F.max_by(F.struct("kind", "score"), F.struct("score", -F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))))
        found = found.groupBy("value").agg(best.alias("best")).select("value", "best.kind", "best.score")
        new = store(found.join(known.select("value").distinct(), "value", "left_anti"), "pii-found")
        if new.limit(1).count() == 0:
            return known.join(seeds.select("value").distinct(), "value", "left_anti")
        known = store(known.unionByName(new), "pii-known")


def extract(df: DataFrame, **options) -> DataFrame:
    """doc_id, base (kind:start:end, ordered), extra (the same, discovered; ordered) for every row."""
    scanned = store(scan(df), "pii")
    spots = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    edges = spots.select(F.explode("patterns").alias("pattern"), "value", "kind").distinct()
    new = bootstrap(edges, **options).withColumnRenamed("kind", "as")
    order = F.array(*map(F.lit, KINDS))
    extra = (
        spots.where("kind IS NULL").join(new, "value")
        .groupBy("row").agg(F.sort_array(F.collect_set(F.struct(F.array_position(order, F.col("as")).alias("k"), "start", "end", "as"))).alias("x"))
        .select("row", F.transform("x", lambda s: F.concat(F.lit("ctx_"), s["as"], F.lit(":"), s["start"], F.lit(":"), s["end"])).alias("extra"))
    )
    return scanned.select("row", "doc_id", "base").join(extra, "row", "left").select("doc_id", "base", F.coalesce("extra", F.array().cast("array<string>")).alias("extra"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.startswith(kind + ":"))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join(F.concat("base", "extra"), ",").alias("spans"))


QUERIES = {"op3_pii": op3_pii}
ORACLE: dict[str, str] = {}
