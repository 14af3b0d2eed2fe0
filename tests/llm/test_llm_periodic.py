"""Runs of repeated words and whitening of embeddings against plain loops."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgauge.llm import periodic, whitening
from corpusgauge.llm.queries import QUERIES


def brute_runs(words, least=24, times=3):
    """Every maximal stretch of every period, kept if no smaller period fits."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            stretch = words[i : i + length]
            if length >= max(least, times * q) and not any(
                all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q)
            ):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def looped(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    words = looped(doc_id, words)
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *facts, digest(lines), digest(" ".join(collapse(words, runs))))


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def periodic_texts():
    rng = random.Random(11)
    word = lambda k: rng.choice("abcdefghijklmnop"[:k])
    texts = [None, "", " \n\t", "one", "a " * 23, "a " * 24, "x " + "a b " * 12, "é \x0b" * 30]
    for _ in range(60):
        out = []
        while len(out) < 150:
            root = [word(rng.choice([1, 2, 3, 12])) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 20, 33]))]
            k = rng.randint(1, 5)
            out += root * k + root[: rng.randint(0, len(root))] + [word(16) for _ in range(rng.randint(0, 6))]
        texts.append(" ".join(out))
    texts += [" ".join(word(2) for _ in range(200)) for _ in range(10)]
    # a root whose grams occur several times in one period
    v = [word(12) for _ in range(40)]
    texts.append(" ".join((v + v + ["z"] + v) * 3))
    return texts


def test_runs_equal_brute_force():
    for text in periodic_texts():
        words = (text or "").encode().split()
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.array([numbers[w] for w in words], dtype=np.int64)
        got = sorted(map(tuple, periodic.runs_of(ids, np.zeros(len(ids), dtype=np.int64), 24, 3).tolist()), key=lambda r: (r[0], r[2]))
        assert got == brute_runs(words)


def test_other_thresholds_equal_brute_force():
    for least, times in ((3, 3), (10, 4), (40, 3), (12, 6)):
        for text in periodic_texts()[:30]:
            words = (text or "").encode().split()
            numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
            ids = np.array([numbers[w] for w in words], dtype=np.int64)
            got = sorted(map(tuple, periodic.runs_of(ids, np.zeros(len(ids), dtype=np.int64), least, times).tolist()), key=lambda r: (r[0], r[2]))
            assert got == brute_runs(words, least, times)


def test_a_run_of_one_word_takes_linear_memory():
    ids = np.zeros(300_000, dtype=np.int64)
    got = periodic.runs_of(ids, np.zeros(300_000, dtype=np.int64), 24, 3)
    assert got.tolist() == [[0, 300_000, 1]]


def test_query_of_runs_equals_brute_force(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(periodic_texts())]
    rows += [(None, "a b " * 20, "x"), (3, "one", "x"), (3, "one", "x")]
    schema = "doc_id long, text string, runs string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    want = []
    for doc_id, text, _ in rows:
        facts = expected(doc_id, text) if doc_id is not None else None
        if facts is None:  # a NULL key has no checksum: the text stays as it is
            words = text.split()
            runs = brute_runs(words)
            facts = (1, 0, 40, 2, 20_000, digest("0,40,2\n"), digest(" ".join(collapse(words, runs))))
        want.append((doc_id, *facts))
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in got), key=order) == sorted(want, key=order)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op11_periodic_runs"](spark, f"{tmp_path}/none").count() == 0


def test_collapsed_text_is_the_operators_output(spark):
    docs = spark.createDataFrame([(1, "start " + "go on " * 20 + "end", 5)], "doc_id long, text string, collapsed int")
    row = periodic.periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 40, 2)]
    assert row["collapsed"] == "start go on end"
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, times=2)


def test_query_of_runs_on_the_given_table(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op11_periodic_runs"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    checked = 0
    for r in got:
        text = docs[r["doc_id"]]
        if len(text) < 6_000:
            assert tuple(r[c] for c in COLUMNS) == expected(r["doc_id"], text)
            checked += r["n_runs"] > 0
    assert checked > 5


# -- whitening ---------------------------------------------------------------------


def expected_whitening(rows, components=16, count=False):
    """Plain numpy over the distinct vectors."""
    x = {}
    for i, (key, v) in enumerate(rows):
        if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v):
            x[i] = tuple(int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v)
    fit = sorted(x.values()) if count else sorted(set(x.values()))
    a = np.array(fit, dtype=np.int64)
    n, s = len(a), a.sum(axis=0)
    z = a - s / n
    cov = z.T @ z / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    keep = e > 1e-12 * e[0]
    e, u = e[keep], u[:, keep]
    out = []
    for i, v in x.items():
        dev = sum((n * c - int(t)) ** 2 for c, t in zip(v, s))
        white = (np.array(v) - s / n) @ u / np.sqrt(e)
        out.append((rows[i][0], dev, white, e / np.trace(cov), n))
    return out


def compare_whitening(got, want):
    groups = {}
    for r in got:
        groups.setdefault((r["vec_id"], int(r["deviation"])), []).append(r)
    found = {}
    for k, rs in groups.items():
        by = {}
        for r in rs:
            by.setdefault(r["component"], []).append(r)
        found[k] = by
    signs = {}
    counts = {}
    for key, dev, white, share, n in want:
        counts[(key, dev)] = counts.get((key, dev), 0) + 1
        by = found[(key, dev)]
        assert sorted(by) == list(range(1, len(white) + 1))
        for c, w in enumerate(white, 1):
            r = by[c][0]
            assert r["n"] == n and abs(r["explained"] / share[c - 1] - 1) < 1e-6 and r["identity_error"] < 1e-6
            if abs(w) > 1e-3:
                signs.setdefault(c, np.sign(w) * np.sign(r["whitened"]))
            assert abs(abs(r["whitened"]) - abs(w)) < 1e-6
            assert abs(w) < 1e-3 or np.sign(w) * np.sign(r["whitened"]) == signs[c]
    for k, c in counts.items():
        assert all(len(rs) == c for rs in found[k].values())
    assert sum(len(rs) for rs in groups.values()) == sum(len(w[2]) for w in want)


def vectors(n=400, m=6, seed=5):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 1, (n, m)) @ rng.normal(0, 1, (m, m))
    rows = [(i, [float(c) for c in a[i]]) for i in range(n)]
    # a vector that a third of all rows share, repeated rows, and unusable ones
    rows += [(1000 + i, rows[0][1]) for i in range(n // 2)] + [rows[3], rows[3], (None, rows[4][1])]
    rows += [(2000, None), (2001, []), (2002, [None] + [0.0] * (m - 1)), (2003, [float("nan")] * m), (2004, [float("inf")] * m)]
    return rows


@pytest.mark.parametrize("weight", ["one", "count"])
def test_whitening_equals_numpy(spark, weight):
    rows = vectors()
    df = spark.createDataFrame([(k, v, 1.0) for k, v in rows], "vec_id long, embedding array<float>, whitened double").repartition(5)
    got = whitening.whiten(df, weight=weight, components=4).collect()
    compare_whitening(got, expected_whitening(rows, 4, weight == "count"))


def test_whitening_query_equals_numpy(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    got = QUERIES["op12_embedding_whitening"](spark, sf_dir).collect()
    compare_whitening(got, expected_whitening([(r["vec_id"], r["embedding"]) for r in table]))


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    whiten = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert whiten([]) == []
    assert whiten([(1, None)]) == []
    # one distinct vector has no direction of variance
    assert whiten([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    # a rank of one, and vectors of another length beside it
    got = whiten([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [5.0]), (4, [6.0]), (5, [6.5])])
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in got) == [(1, 1, 2), (2, 1, 2), (3, 1, 3), (4, 1, 3), (5, 1, 3)]
    assert sorted(abs(round(r["whitened"], 9)) for r in got if r["vec_id"] < 3) == [1.0, 1.0]
    # values far outside: saturated, exact, and no crash
    far = whiten([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])
    top = 2**52 + 10**6
    x = [(top, 10**6), (-(2**52) + 10**6, 10**6 + 64), (10**6, 10**6 + 128)]
    s = [sum(v[i] for v in x) for i in range(2)]
    want = {i + 1: sum((3 * v[d] - s[d]) ** 2 for d in range(2)) for i, v in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in far} == want
