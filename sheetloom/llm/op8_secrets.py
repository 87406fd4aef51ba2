"""Secret scans: base patterns, and assignment-aware lexing.

The lexer reads name-literal pairs from source and configuration syntax (``name = "x"``, ``"name": "x"``, ``name: x``, ``NAME := x + y``, calls,
lists and blocks of YAML, XML elements and attributes, strings over several lines), keeps an environment of constants (a later assignment of a name
counts for what follows), replaces names and sums of names by the literals they stand for, and scores each literal by how sensitive its
target's name is and how random the literal looks.  The literal's own place is reported, also where a later line gives it to a sensitive name.

Defined results: null and empty texts have no spans; equal spans are reported once; repeated rows are reported each; extra columns of the
input are ignored; an empty table gives an empty result.  Every step is linear in the text's length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "named")
_OPERATOR = re.compile(r":=|=>|[:=]")
_STRINGS = r"""(?:\b[rRbBfFuU]{1,2}(?=["']))?(?:\"\"\"((?:[^"\\]|\\.|"(?!""))*+)\"\"\"|\'\'\'((?:[^'\\]|\\.|'(?!''))*+)\'\'\'|"((?:[^"\n\\]|\\.)*+)"|'((?:[^'\n\\]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`"""
#: A quoted string with escapes (also over several lines), an identifier that is the whole token, or any bare token (whole).
_LITERAL = re.compile(r"[ \t]*(?:\\\n[ \t]*)?" + _STRINGS + r"""|([A-Za-z_][\w.-]*+)(?=[\s"',;(){}\[\]+<]|\Z)|([^\s"',;(){}\[\]`]+))""", re.S)
_QUOTED = re.compile(_STRINGS + ")", re.S)
#: What a call's parentheses hold, without further parentheses but in strings.
_ARGUMENTS = re.compile(r"""\((?:[^()"'`\n]|"(?:[^"\n\\]|\\.)*+"|'(?:[^'\n\\]|\\.)*+')*+\)""")
#: After a colon at a line's end: items of a list, or a block's lines.
_BLOCK = re.compile(r"[ \t]*(?:[|>][+-]?[ \t]*)?(\n)(?:[ \t]+-[ \t]+[^\n]*(?:\n|\Z))+|[ \t]*[|>][+-]?[ \t]*(?=\n)()(?:\n[ \t]+[^\n]*)+")
_ITEM = re.compile(r"[ \t]*(?:-[ \t]+)?([^\n]*)(?:\n|\Z)")
_SETTER = re.compile(r"""([A-Za-z_][\w.-]*+)\(\s*(?:"((?:[^"\n\\]|\\.)*+)"|'((?:[^'\n\\]|\\.)*+)')(?:\s*,\s*(?:"((?:[^"\n\\]|\\.)*+)"|'((?:[^'\n\\]|\\.)*+)'))?\s*\)""")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>\s*+([^<>\s](?:[^<>]*[^<>\s])?)\s*</\1>")
_KEYED = re.compile(r"""<[A-Za-z][\w.:-]*+\s[^<>]*?\b(?:key|name|id)=["']([^"'<>]*+)["'](?:[^<>]*?\bvalue=["']([^"'<>]*+)["']|[^<>/]*+>\s*+([^<>\s](?:[^<>]*[^<>\s])?))""")
_PLUS = re.compile(r"[ \t]*\+")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-.$")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Name parts and their weights; a name's sensitivity is the highest of its parts or of two that follow each other.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.75, "authorization": 0.8, "private": 0.7, "signing": 0.75, "salt": 0.75, "bearer": 0.8}
PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("client", "secret"): 1.0, ("connection", "string"): 0.7}
THRESHOLD = 0.6


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    return max([0.0, *(SENSITIVE.get(p, 0.0) for p in parts), *(PAIRS.get(x, 0.0) for x in zip(parts, parts[1:]))])


def randomness(literal: str | Counter) -> float:
    """0 to 1, from the entropy of the characters, the classes they belong to and the length."""
    counts = literal if isinstance(literal, Counter) else Counter(literal)
    n = sum(counts.values())
    if not n:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum(any(map(f, counts)) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, entropy / 4.0) * 0.6 + min(1.0, n / 16) * 0.2 + (classes - 1) / 3 * 0.2


class Value:
    """What a name stands for: places of literals and other values, shared and not copied, with the counts of all characters."""

    def __init__(self):
        self.places: list[tuple[int, int]] = []
        self.others: list[Value] = []
        self.counts: Counter = Counter()
        self.told = False

    def add(self, text: str, place: tuple[int, int]) -> None:
        self.places.append(place)
        self.counts.update(text[slice(*place)])

    def refer(self, other: "Value") -> None:
        self.others.append(other)
        self.counts.update(other.counts)
        if sum(self.counts.values()) > 1 << 40:  # names that double each other; shares are what counts
            self.counts = Counter({c: max(1, n >> 20) for c, n in self.counts.items()})

    def tell(self, found: set[tuple[int, int]]) -> None:
        """Adds all places; each value is told once."""
        todo = [self]
        while todo:
            v = todo.pop()
            if not v.told:
                v.told = True
                found.update(v.places)
                todo += v.others


def _name_before(text: str, at: int, floor: int) -> str:
    k = at
    while k > floor and text[k - 1] in " \t":
        k -= 1
    if k > floor and text[k - 1] in "\"'])":
        k -= 1
        if k > floor and text[k - 1] in "\"'":
            k -= 1
    end = k
    while k > floor and text[k - 1] in _NAME_CHARS:
        k -= 1
    return text[k:end]


def _expression(text: str, at: int, known: dict[str, Value]) -> tuple[Value, int]:
    """Literals and known names, joined by +, in a call's parentheses, or as the items of a YAML list or the lines of a block that follows."""
    value = Value()
    if m := _BLOCK.match(text, at):
        for item in _ITEM.finditer(text, m.end(1), m.end()):
            if item.group(1) and (v := _LITERAL.match(text, item.start(1), item.end())):
                k = next(i for i in range(1, 8) if v.group(i) is not None)
                value.add(text, v.span(k))
        return value, m.end()
    while v := _LITERAL.match(text, at):
        k = next(i for i in range(1, 8) if v.group(i) is not None)
        at = v.end()
        if k == 6 and v.group(6) in known:
            value.refer(known[v.group(6)])
        elif k == 6 and text[at : at + 1] == "(":
            m = _ARGUMENTS.match(text, at)
            if m:
                at = m.end()
                for q in _QUOTED.finditer(text, m.start(), m.end()):
                    value.add(text, q.span(next(i for i in range(1, 6) if q.group(i) is not None)))
        else:
            value.add(text, v.span(k))
        if not (plus := _PLUS.match(text, at)):
            break
        at = plus.end()
    return value, at


def lexed_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    known: dict[str, Value] = {}
    found: set[tuple[int, int]] = set()

    def judge(name: str, value: Value) -> None:
        weight = sensitivity(name)
        if weight and sum(value.counts.values()) >= 6 and weight * randomness(value.counts) >= threshold:
            value.tell(found)

    floor = 0
    for m in _OPERATOR.finditer(text) if "=" in text or ":" in text else ():
        if m.start() < floor:
            continue
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if before in ("=", "!", "<", ">", ":") or after in ("=", ":", "/"):
            continue
        name = _name_before(text, m.start(), floor)
        floor = m.end()
        if not name or not (name[0].isalpha() or name[0] in "_$"):
            continue
        value, at = _expression(text, m.end(), known)
        if not value.counts:
            continue
        known[name] = value
        judge(name, value)
        floor = max(floor, at if not value.places or at > value.places[-1][1] + 8 else value.places[-1][1])
    if "(" in text:  # set_password("x"), put("api_key", "x")
        for m in _SETTER.finditer(text):
            first = next((i for i in (2, 3) if m.group(i) is not None), None)
            second = next((i for i in (4, 5) if m.group(i) is not None), None)
            value = Value()
            value.add(text, m.span(second or first))
            judge(m.group(first) if second else m.group(1), value)
    if "</" in text or "/>" in text:  # <password>x</password>, <add key="password" value="x"/>
        for m in _ELEMENT.finditer(text):
            value = Value()
            value.add(text, m.span(2))
            judge(m.group(1), value)
        for m in _KEYED.finditer(text):
            value = Value()
            value.add(text, m.span(2) if m.group(2) is not None else m.span(3))
            judge(m.group(1), value)
    return [("named", a, b) for a, b in found if b > a]


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base with named ones that no base span holds; by start, then kind."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = base_spans(text)
    starts = sorted((a, b) for _, a, b in base)
    reach = [*accumulate((b for _, b in starts), max)]
    more = [s for s in lexed_spans(text) if not (k := bisect_right(starts, (s[1], 1 << 62))) or reach[k - 1] < s[2]]
    return sorted(base, key=order), sorted(base + more, key=order)


def redact(text: str) -> str:
    """The text with every secret replaced by [SECRET]; where spans overlap, their union."""
    out, at = [], 0
    for _, a, b in sorted(spans(text)[1], key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = b
    return "".join([*out, text[at:]]) if at else text


def redact_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns; secrets in the text column are replaced (null stays null)."""
    schema, k = df.schema, df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            new = [x if x is None else redact(x) for x in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == k else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each secret: id, kind, start, end (code points, end exclusive), value."""

    def run(batches):
        for batch in batches:
            rows = [(i, k, a, b, t[a:b]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for k, a, b in spans(t)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows, strict=True)] or [()] * 5, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["id", "kind", "start", "end", "value"])

    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, kind string, start long, end long, value string").withColumnRenamed("id", id_col)


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = spans(text or "")
                n = Counter(k for k, _, _ in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = [*zip(*rows, strict=True)] or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    bounded_batches(spark)
    return read(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


QUERIES = {"op8_secrets": op8_secrets}
ORACLE: dict[str, str] = {}
