"""Operators over many documents against brute force."""

import json
import math
import os
import random
import shutil
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sheetloom.llm import op1_minhash, op2_topk, op6_lines, op7_language, op9_ngram

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, v=400):
    return [f"w{rng.randrange(v)}" for _ in range(n)]


def jaccard(a, b, n=2):
    f = lambda t: Counter(zip(*(t.lower().split()[k:] for k in range(n)), strict=False)) or Counter([tuple(t.lower().split())])
    x, y = f(a), f(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (5, 60, 1000):
        errors = []
        for _ in range(20):
            a = [f"w{i}" for i in rng.integers(0, 300, n)]
            b = list(a)
            for i in rng.integers(0, n, max(1, n // 15)):
                b[i] = "zz"
            t = [" ".join(a), " ".join(b)]
            s = op1_minhash.signatures(*op1_minhash.elements(*op1_minhash.text_bytes(pa.array(t))))
            errors.append((s[0] == s[1]).mean() - jaccard(*t))
        assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.12


def test_near_duplicates(spark):
    rng = random.Random(1)
    rows, truth = [], {}
    for g in range(12):
        base = words(rng, 120, 5000)
        for c in range(rng.choice([1, 2, 4])):
            t = list(base)
            for _ in range(4 if c else 0):
                t[rng.randrange(120)] = f"edit{rng.random()}"
            truth[len(rows)] = g
            rows.append((len(rows), " ".join(t), "x", "y"))
    for extra in (None, "", None, rows[0][1]):
        rows.append((len(rows), extra, None, None))
    rows += [(None, "unlike everything else here", None, None), (500, "z " * 50_000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, class string")
    got = {r["id"]: r for r in op1_minhash.classes(df).collect()}
    for a in truth:
        for b in truth:
            assert (got[a]["class_id"] == got[b]["class_id"]) == (truth[a] == truth[b])
    n = len(truth)
    assert got[n]["class_id"] == got[n + 1]["class_id"] == got[n + 2]["class_id"] == n and got[n]["n_copies"] == 3
    assert got[n + 3]["class_id"] == 0 and got[0]["n_copies"] == 2 and got[None]["first"]
    kept = op1_minhash.keep_first(df)
    assert kept.columns == df.columns
    assert kept.count() == len({truth[a] for a in truth}) + 3
    assert op1_minhash.keep_first(df.limit(0)).count() == 0


def test_hot_template_is_one_class(spark):
    base = words(random.Random(2), 60, 5000)
    rows = [(k, " ".join(base[: k % 60] + [f"u{k}"] + base[k % 60 + 1 :])) for k in range(600)] + [(1000 + k, f"shared passage of many words here {k} " + " ".join(words(random.Random(k), 40, 90000))) for k in range(300)]
    got = op1_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got if r["id"] < 1000} == {0}
    assert all(r["class_id"] == r["id"] for r in got if r["id"] >= 1000)


def hot_passage():
    """Texts that share most of their words with all others (similarity about 0.4), and groups of up to 5 of them that are somewhat more alike."""
    rng = random.Random(9)
    hot, rows = words(rng, 75, 5000), []
    for _ in range(150):
        own = words(rng, 45, 90000)
        for _ in range(rng.choice([1, 2, 3, 5])):
            t = hot + own
            for _ in range(14):
                t[rng.randrange(75, 120)] = f"edit{rng.random()}"
            rows.append((len(rows), " ".join(t)))
    return rows


def brute_links(texts):
    """Pairs whose signatures agree enough and that have a band in common, and the label of every text."""
    s = op1_minhash.signatures(*op1_minhash.elements(*op1_minhash.text_bytes(pa.array(texts))))
    same = s[:, None] == s[None]
    hit = (same.mean(axis=2) >= op1_minhash.THRESHOLD) & same.reshape(len(s), len(s), -1, op1_minhash.SHORT).all(axis=3).any(axis=2)
    np.fill_diagonal(hit, False)
    label = np.arange(len(s))
    for _ in range(len(s)):
        new = np.minimum(label, np.where(hit, label[None], len(s)).min(axis=1))
        if (new == label).all():
            break
        label = new
    return hit, label


@pytest.mark.parametrize("block, small", [(2048, 32), (50, 8)])
def test_links_under_a_hot_passage(spark, monkeypatch, block, small):
    monkeypatch.setattr(op1_minhash, "BLOCK", block, raising=False)
    monkeypatch.setattr(op1_minhash, "SMALL", small, raising=False)
    rows = hot_passage()
    rows += [(len(rows), rows[7][1]), (len(rows) + 1, rows[7][1].replace(" ", "  ")), (len(rows) + 2, rows[9][1].replace(" ", "\n"))]
    hit, label = brute_links([t for _, t in rows])
    got = {r["id"]: r for r in op1_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["class_id"] for k in range(len(rows))] == label.tolist() and len(set(label)) < len(rows) - 100
    hit[:, len(rows) - 3] = False  # the text of row 7 once more: one text
    hit[len(rows) - 3] = hit[7]
    assert [got[k]["n_links"] for k in range(len(rows))] == hit.sum(axis=1).tolist() and hit.sum() > 400


def test_top_k(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(k), [float(np.float32(x)) for x in rng.integers(-3, 4, 6) / 4]) for k in range(420)]
    rows += [(50, [1.0] * 6), (None, [1.0] * 6), (421, None), (422, [1.0, None, 0.0]), (423, [float("nan")] * 6), (424, [float("inf")] + [0.0] * 5), (450, [1.0, 1.0]), (451, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in op2_topk.op2_topk(spark, str(tmp_path)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(k, [math.floor(256 * x) for x in v]) for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for at, (q, v) in enumerate(good):
        if q % 50 or q == 50:
            continue
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), k) for j, (k, w) in enumerate(good) if j != at))[:5]
        assert sorted(got[q]) == [(i + 1, k, -s) for i, (s, k) in enumerate(best)]
    assert len(got[50]) == 10  # two rows of that id
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op2_topk.op2_topk(spark, f"{tmp_path}/none").count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup(spark):
    rng = random.Random(7)
    lines = ["".join(rng.choice("abcé ") for _ in range(rng.choice([10, 26, 27, 40, 61]))) for _ in range(30)]
    for _ in range(60):
        t = list(rng.choice(lines))
        for _ in range(rng.choice([1, 1, 2])):
            k = rng.randrange(len(t))
            t[k : k + rng.choice([0, 1])] = rng.choice(["", "x", "a"])
        lines.append("".join(t))
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 5))) for _ in range(60)] + [None, "", "\n\n", lines[0] * 4000]
    rows = [(k if k % 9 else None, t, "clash", 3) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, row int").coalesce(1)
    got = [(r["doc_id"], r["text"], r["n_dropped"]) for r in op6_lines.drop_lines(df).collect()]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen, want = [], {}
    for k in order:
        keep, gone = [], 0
        for line in (texts[k] or "").split("\n"):
            if len(line) >= op6_lines.MIN_CHARS:
                drop = any(line == s or (abs(len(line) - len(s)) <= 1 and edit(line, s) <= 1) for s in seen)
                if line not in seen:
                    seen.append(line)
                if drop:
                    gone += 1
                    continue
            keep.append(line)
        want[k] = (rows[k][0], texts[k] if not gone else "\n".join(keep), gone)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")
    assert sorted(got, key=key) == sorted(want.values(), key=key)
    assert op6_lines.drop_lines(df.limit(0)).count() == 0


def test_rows_are_numbered_once(spark):
    df = spark.createDataFrame([(k, "the same line of enough characters\n" * 2) for k in range(4)], "doc_id long, text string")
    numbered, gone = op6_lines.dropped(df)
    assert "monotonically_increasing_id" not in numbered._jdf.queryExecution().optimizedPlan().toString()
    assert {r["_sl_row"] for r in gone.collect()} <= {r["_sl_row"] for r in numbered.collect()}


def test_language(spark, tmp_path):
    rng = random.Random(3)
    say = lambda lang: " ".join("".join(rng.choice({"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ze"], "cc": ["eau", "que", "ré"]}[lang]) for _ in range(3)) for _ in range(40))
    rows = [(k, say(lang := rng.choice(["aa", "bb", "cc"])), lang, "s", 1) for k in range(300)]
    rows += [(300, None, "aa", None, None), (301, "123 ... !!", "bb", None, None), (302, "", None, None, None), (303, say("cc") * 200, None, None, None), (None, say("aa"), None, None, None), (303, say("aa"), "aa", None, None)]
    spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_language.op7_language(spark, str(tmp_path)).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 303}
    assert len(got) == len(rows) and {by[300]["lang_pred"], by[301]["lang_pred"], by[302]["lang_pred"]} == {"und"}
    held = [k for k in range(300) if by[k]["held_out"]]
    assert len(held) > 40 and np.mean([by[k]["lang_pred"] == rows[k][2] for k in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op7_language.op7_language(spark, f"{tmp_path}/none").count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    m = op7_language.ByteGru(list("abc"), hidden=3)
    x, y, mask = rng.integers(0, 5, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones((6, 4), bool)
    mask[4:, 1] = False
    _, g = m.gradients(x, y, mask)
    for k in m.w:
        for _ in range(4):
            i = tuple(rng.integers(0, min(s, 5) if "table" in k and n else s) for n, s in enumerate(m.w[k].shape))
            old = m.w[k][i]
            m.w[k][i] = old + 1e-2
            a = m.gradients(x, y, mask)[0]
            m.w[k][i] = old - 1e-2
            b = m.gradients(x, y, mask)[0]
            m.w[k][i] = old
            assert abs((a - b) / 2e-2 - g[k][i]) < 3e-3


def ngram_truth(rows, held):
    """id -> n_tokens, n_known, train_tokens, base_score, score, by counting every n-gram of the training texts."""
    t = {r[0]: (r[1] or "").lower().split() + ["</>"] for r in rows}
    train = [v for k, v in t.items() if not held[k]]
    n, uni, grams, out = sum(map(len, train)), Counter(w for v in train for w in v), Counter(), {}
    for v in train:
        for i in range(len(v)):
            grams.update(tuple(v[i:j]) for j in range(i + 1, len(v) + 1))
    for k, v in t.items():
        base = total = 0.0
        for i, x in enumerate(v):
            b = (uni[x] + 0.5) / (n + 0.5 * (len(uni) + 1))
            size = next(s for s in range(i, -1, -1) if s == 0 or grams[tuple(v[i - s : i])])
            c = grams[tuple(v[i - size : i])] if size else n
            hit = grams[tuple(v[i - size : i + 1])] if size else uni[x]
            m = float(op9_ngram.weight(np.array([size]))[0])
            base, total = base + math.log10(b), total + math.log10((hit + m * b) / (c + m))
        out[k] = (len(v), sum(uni[x] > 0 for x in v), n, base, total)
    return out


def ngram_equal(got, truth):
    assert len(got) == len(truth)
    for r in got:
        want = truth[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert abs(r["base_score"] - want[3]) < 1e-9 and abs(r["score"] - want[4]) < 1e-9


def test_ngram_scores(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.choice([0, 1, 3, 12, 30]), 9)) for _ in range(30)]
    texts += texts[:4] + [texts[5] + " New " + texts[6], None, "w1  \tW1\n", "only " * 300]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)] + [(None, "w1 w2", None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_ngram.op9_ngram(spark, str(tmp_path)).collect()
    ngram_equal(got, ngram_truth(rows, {r["doc_id"]: r["held_out"] for r in got}))
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op9_ngram.op9_ngram(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize(("shard_tokens", "shard_windows", "dictionary"), [(1 << 22, 1 << 21, 1 << 21), (1, 40, 1 << 21), (200, 300, 8), (1 << 22, 100, 60), (150, 1 << 21, 0)])
def test_ngram_shards_and_codes(spark, tmp_path, shard_tokens, shard_windows, dictionary):
    """One shard or many of either kind; words with short codes, few of them, or none: the same scores. Copies, near copies, shared passages, clashing columns."""
    rng = random.Random(shard_windows + dictionary)
    passage = words(rng, 25, 60)
    texts = [words(rng, rng.choice([0, 2, 9, 40]), rng.choice([5, 60, 400])) for _ in range(60)]
    for k in range(0, 40, 2):
        at = rng.randrange(len(texts[k]) + 1)
        texts[k][at:at] = passage
    for k in range(12):
        copy = list(texts[k])
        if copy and k % 3:
            copy[rng.randrange(len(copy))] = f"rare{k}"
        texts.append(copy)
    rows = [(k, " ".join(t), "held", k % 5) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held string, block long")
    df.repartition(3).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in range(len(texts))}
    got = op9_ngram.score_texts(df, shard_tokens=shard_tokens, shard_windows=shard_windows, dictionary=dictionary).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == held
    ngram_equal(got, ngram_truth(rows, held))


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p
    from sheetloom.llm import op8_secrets

    rng = random.Random(11)
    vocabulary = {"aa": ["ka", "lo", "mi", "na"], "bb": ["sch", "ung", "ze", "ich"]}
    sentence = lambda lang: " ".join("".join(rng.choice(vocabulary[lang]) for _ in range(3)) for _ in range(12))
    rows = []
    for k in range(60):
        lang = rng.choice(["aa", "bb"])
        rows.append((k, "\n".join(sentence(lang) for _ in range(4)), lang, "s0", 0))
    rows += [(60, rows[3][1] + "\npassword=hunter2222 end", "aa", None, 0), (61, None, None, None, None), (62, "1234", "aa", None, 4), (63, rows[5][1].split("\n")[0] + "\n" + sentence("bb") + "\nsecret: abcdefgh1", "bb", None, 0)]
    near = rows[8][1].split(" ")
    near[5], near[30] = "kalomika", "ungzesch"
    rows.append((64, " ".join(near), "aa", None, 0))
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(p.STAGES)
    one = stages["language"](spark, docs, "")
    assert {r["doc_id"] for r in one.collect()} == set(range(65)) - {61, 62} and one.columns == docs.columns
    seen, want = [], {}
    for k, t, *_ in sorted((r for r in rows if r[0] not in (61, 62)), key=lambda r: r[0]):
        keep = []
        for line in t.split("\n"):
            if len(line) < op6_lines.MIN_CHARS or not any(line == s or (abs(len(line) - len(s)) < 2 and edit(line, s) < 2) for s in seen):
                keep.append(line)
            seen.append(line)
        if keep:
            want[k] = "\n".join(keep)
    two = stages["lines"](spark, one, "")
    assert {r["doc_id"]: r["text"] for r in two.collect()} == want and two.columns == docs.columns
    label = {k: k for k in want}
    for _ in range(4):
        for a in want:
            for b in want:
                if jaccard(want[a], want[b]) >= op1_minhash.THRESHOLD:
                    label[a] = label[b] = min(label[a], label[b])
    three = stages["near_duplicates"](spark, two, "")
    assert {r["doc_id"] for r in three.collect()} == set(label.values())
    four = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages["secrets"](spark, three, "").collect()}
    assert four == {k: (op8_secrets.redact(want[k]), len(op8_secrets.redact(want[k]))) for k in set(label.values())}
    packed = p.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(four)
    for k in four:
        mine = [r for r in packed if r["doc_id"] == k]
        assert sum(r["length"] for r in mine) == mine[0]["doc_tokens"]
    assert p.ORACLE_SQL is None and len(p.STAGES) == 5


@pytest.mark.parametrize("missing", [True])
def test_rest_stands_alone(tmp_path, missing):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e, json; print(json.dumps([len(e.queries()), sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline')]))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env, capture_output=True, text=True, check=True).stdout
    n, names = json.loads(out)
    assert n > 50 and names == []


def test_minhash_query_equals_brute_force(spark, tmp_path):
    """The query op1_minhash over a whole table: class, links and copies of every row, with null and empty texts and a column named like its own."""
    rows = [(k, t) for k, t in hot_passage()[:150]]
    rows += [(len(rows), rows[7][1]), (len(rows) + 1, None), (len(rows) + 2, ""), (len(rows) + 3, rows[9][1])]
    df = spark.createDataFrame([(*r, "x", "clash") for r in rows], "doc_id long, text string, row string, signature string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op1_minhash.op1_minhash(spark, str(tmp_path)).collect()}
    texts = [t or "" for _, t in rows]
    filled = [k for k, t in enumerate(texts) if t]
    hit, label = brute_links([texts[k] for k in filled])
    first = {t: k for k, t in reversed(list(enumerate(texts)))}
    for i, k in enumerate(filled):
        others = {texts[filled[j]] for j in np.flatnonzero(hit[i])} - {texts[k]}
        assert (got[k]["class_id"], got[k]["n_links"], got[k]["n_copies"]) == (filled[label[i]], len(others), texts.count(texts[k]))
        assert got[k]["kept"] == (got[k]["class_id"] == k)
    assert [(got[k]["class_id"], got[k]["n_links"], got[k]["n_copies"]) for k in range(len(rows)) if not texts[k]] == [(first[""], 0, 2)] * 2


def test_pipeline_of_nothing_and_of_repeated_rows(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0
    line = "some words that all of these documents share and more of them"
    rows = [(k // 2, f"{line} {k // 2} " + " ".join(words(random.Random(k // 2), 30)), "aa", None, 5) for k in range(8)] + [(None, None, None, None, None)] * 2
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/some/documents.parquet")
    got = p.run(spark, f"{tmp_path}/some").collect()
    assert {r["doc_id"] for r in got} <= {0, 1, 2, 3} and got and all(sum(x["length"] for x in got if x["doc_id"] == r["doc_id"]) == r["doc_tokens"] for r in got)


def test_ngram_of_a_long_repetition(spark):
    """One word 3000 times: the context of l words occurs 3001 - l times; learned from, and asked for by a held-out text of 500.

    500 words and the end occur once, too: where the long text ends.
    """
    df = spark.createDataFrame([(1, "only " * 3000, False), (2, "only " * 500, True)], "doc_id long, text string, h boolean")
    got = {r["doc_id"]: r for r in op9_ngram.score_texts(df, held=F.col("h")).collect()}
    n = 3001
    b, end = ((c + 0.5) / (n + 0.5 * 3) for c in (3000, 1))
    m = lambda length: float(op9_ngram.weight(np.array([length]))[0])
    c = lambda length: 3001 - length if length else n
    for key, size, last in ((1, 3000, 1), (2, 500, 1)):
        want = sum(math.log10((c(k + 1) + m(k) * b) / (c(k) + m(k))) for k in range(size)) + math.log10((last + m(size) * end) / (c(size) + m(size)))
        assert abs(got[key]["score"] - want) < 1e-9 and got[key]["n_tokens"] == size + 1


def longest_contexts(rows, held):
    """id -> score, by how far the words before every place agree with those before every training place."""
    t = {k: x.lower().split() + ["</>"] for k, x in rows}
    number = {w: k for k, w in enumerate(sorted({w for v in t.values() for w in v}))}
    train = [np.array([number[w] for w in v]) for k, v in t.items() if not held[k]]
    corpus, first = np.concatenate(train), np.cumsum([0, *map(len, train[:-1])])
    n, uni, out = len(corpus), np.bincount(corpus, minlength=len(number)), {}
    for k, v in t.items():
        alike, size, total = np.zeros(n, np.int64), 0, 0.0  # words that agree, up to and with each training place; the longest
        for x in (number[w] for w in v):
            b = (uni[x] + 0.5) / (n + 0.5 * ((uni > 0).sum() + 1))
            m = float(op9_ngram.weight(np.array([size]))[0])
            before = np.r_[0, alike[:-1]]
            before[first] = 0
            c = (alike >= size).sum() if size else n
            alike = np.where(corpus == x, before + 1, 0)
            total += math.log10(((alike > size).sum() + m * b) / (c + m))
            size = int(alike.max())
        out[k] = total
    return out


def test_ngram_long_contexts_without_shared_indexes(spark, tmp_path, monkeypatch):
    """Copies of up to 5000 words with edits, common passages and repetitions in many blocks: right scores, and tasks share no file but the dictionary.

    What all tasks read (each suffix array, before) costs blocks times corpus.
    """
    monkeypatch.setattr(op9_ngram, "BLOCK_TOKENS", 3000)
    rng = random.Random(29)
    long, line = words(rng, 5000, 300), words(rng, 40, 300)
    texts = [list(long), list(long), long[:4700], long[300:], long[100:900] + words(rng, 30, 300) + long[850:1500], ["a", "b", "c"] * 400, ["b", "c", "a"] * 90]
    for _ in range(24):
        at = rng.randrange(4000)
        copy = long[at : at + rng.choice([5, 12, 20, 60, 300, 600])]
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(9)}"
        texts.append(words(rng, rng.randrange(20), 300) * (rng.random() < 0.5) + copy + line[: rng.randrange(41)] + words(rng, 10, 300))
    rows = [(k, " ".join(x)) for k, x in enumerate(texts)]
    held = {k: k in (1, 4, 6) or k % 3 == 2 and k > 6 for k, _ in rows}
    df = spark.createDataFrame([(k, x, held[k]) for k, x in rows], "doc_id long, text string, h boolean").repartition(3)
    df.write.parquet(f"{tmp_path}/docs")
    (tmp_path / "shared").mkdir()
    monkeypatch.setattr(op9_ngram, "new_folder", lambda _: f"file://{tmp_path}/shared")
    got = op9_ngram.score_texts(spark.read.parquet(f"{tmp_path}/docs"), held=F.col("h"), shard_tokens=4000).collect()
    want = longest_contexts(rows, held)
    assert len(got) == len(rows) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-8 for r in got)
    files = {p.name.split("-")[0] for p in tmp_path.glob("shared/*")}
    assert "block" in files and files <= {"block", "dictionary"}


def test_ngram_ladders_go_up_only_where_someone_agrees(monkeypatch):
    """Answers on ladders by brute force; a rung is looked up only for places that agree with the training places on all below.

    Before, each of up to 20 rungs was looked up for every place, unsorted (op9_ngram took 1089 CPU seconds a GB, its budget is 960).
    """
    rng = random.Random(7)
    tall = 20

    def ladder(rungs):
        """Most differ from each other at once, few go far; 0 where a text ends."""
        out = [rng.randrange(1, 30)]
        for k in range(1, rungs):
            low = rng.randrange(1, 3) if rng.random() < 0.2 or k > 3 else rng.randrange(1 << 40)
            out.append(0 if out[-1] == 0 and k > 1 or rng.random() < 0.05 else hash((*out, low)) & (1 << 63) - 1 | 1)
        return out

    def row(block, kind, ladders, weights=b""):
        data = np.int64(len(ladders)).tobytes() + op9_ngram.pack(np.array(ladders, np.uint64).T.ravel())
        return 0, block, kind, data, op9_ngram.pack(np.array(weights, np.uint32)) if kind == op9_ngram.CORPUS else b""

    corpus = {b: [ladder(tall if b != "b" else 3) for _ in range(400)] for b in "abc"}
    weights = {b: [rng.randrange(1, 4) for _ in v] for b, v in corpus.items()}
    asked = {b: [list(rng.choice(corpus[rng.choice("abc")]))[:9] if rng.random() < 0.3 else ladder(9) for _ in range(500)] for b in "cde"}
    asked = {b: [x + [0] * (9 - len(x)) for x in v] for b, v in asked.items()}
    rows = [row(b, op9_ngram.CORPUS, v, weights[b]) for b, v in corpus.items()] + [row(b, op9_ngram.HELD, v) for b, v in asked.items()]
    table, looked_up = pa.Table.from_batches([op9_ngram._row(rows)]), []

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def searchsorted(self, a, v, *rest):
            looked_up.append(np.size(v))
            return np.searchsorted(a, v, *rest)

    monkeypatch.setattr(op9_ngram, "np", Counting())
    got = {(r["block"], r["kind"]): r for r in op9_ngram.answer_ladder(table).to_pylist()}
    monkeypatch.undo()
    times, bits = [Counter() for _ in range(tall)], [set() for _ in range(tall)]
    for b, v in corpus.items():
        for x, n in zip(v, weights[b], strict=True):
            for k, rung in enumerate(x):
                times[k][rung] += n if rung or not k else 0
    agree = []
    for b, v in asked.items():
        last = [max(k for k in range(9) if k == 0 or x[k] and times[k][x[k]]) for x in v]
        for x, k in zip(v, last, strict=True):
            bits[k].add(x[k])
        agree += last
        r = got[b, op9_ngram.HELD]
        assert op9_ngram.unpack(r["data"]).tolist() == last
        assert op9_ngram.unpack(r["extra"]).tolist() == [times[k][x[k]] if k else 0 for x, k in zip(v, last, strict=True)]
    for b, v in corpus.items():
        want = [sum(1 << k for k, rung in enumerate(x) if rung in bits[k]) for x in v]
        assert op9_ngram.unpack(got[b, op9_ngram.CORPUS]["data"]).tolist() == want and any(w > 2 for w in want)
    assert sum(looked_up) <= 2 * sum(k + 2 for k in agree) + tall


def test_ngram_shards_search_what_many_blocks_ask_for_once(monkeypatch):
    """Answers on windows by brute force, whatever block asks; the work grows with distinct windows, not with blocks times windows as before."""
    rng = random.Random(3)
    windows = sorted({int.from_bytes(bytes(rng.randrange(1, 4) for _ in range(8)), "big") for _ in range(700)})  # eight codes of a byte
    corpus = {f"b{k}": sorted(rng.sample(windows[:500], 60)) for k in range(12)}
    counts = {b: [rng.randrange(1, 4) for _ in v] for b, v in corpus.items()}
    asked = sorted(rng.sample(windows, 300))
    column = lambda v: op9_ngram.pack_sorted(np.array(v, np.uint64))
    rows = [(0, b, op9_ngram.CORPUS, column(v), op9_ngram.pack(np.array(counts[b], np.uint32))) for b, v in corpus.items()]
    rows += [(0, f"b{k}", kind, column(asked), b"") for k in range(40) for kind in (op9_ngram.HELD, op9_ngram.BEGIN)] + [(0, "b1", op9_ngram.FIRST, column(corpus["b1"][:5]), b"")]
    table, looked_up = pa.Table.from_batches([op9_ngram._row(rows)]), []

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def searchsorted(self, a, v, *rest):
            looked_up.append(np.size(v))
            return np.searchsorted(a, v, *rest)

    monkeypatch.setattr(op9_ngram, "np", Counting())
    got = op9_ngram.answer(table).to_pylist()
    monkeypatch.undo()
    n = Counter()
    for b, v in corpus.items():
        n.update(dict(zip(v, counts[b], strict=True)))
    prefixes = Counter()
    for w, c in n.items():
        prefixes.update({(k, w >> 64 - 8 * k): c for k in range(1, 9)})
    size = [max([0, *(k for k in range(1, 9) if prefixes[k, w >> 64 - 8 * k])]) for w in asked]
    for r in got:
        if r["kind"] == op9_ngram.CORPUS:
            want = [(n[w] > 1) * op9_ngram.AGAIN | (w in asked) * op9_ngram.IN_HELD | (w in corpus["b1"][:5]) * op9_ngram.IS_FIRST for w in corpus[r["block"]]]
            assert op9_ngram.unpack(r["data"]).tolist() == want
        else:
            assert op9_ngram.unpack(r["data"]).tolist() == [k | (k == 8) << 7 for k in size]
            assert op9_ngram.unpack(r["extra"]).tolist() == [prefixes[k, w >> 64 - 8 * k] if k else 0 for k, w in zip(size, asked, strict=True)]
    assert len(got) == 12 + 80 and sum(looked_up) <= 2 * 4 * len(asked) + 10
