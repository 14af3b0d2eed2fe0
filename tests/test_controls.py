"""Near copies and closest labels against plain loops."""

import random

from corpusgauge.operators import controls as K
from tests.conftest import rows


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_near_copies_of_a_template_family(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):  # a family whose members overlap by about 0.4 to 0.9
        t = list(base)
        for i in rng.sample(range(60), rng.randint(0, 3)):
            t[i] = f"x{rng.randrange(9)}"
        texts.append(" ".join(t))
    texts += [texts[5], texts[5].upper(), "one two three", "one two three", None, "", " ".join(base[:5])]
    sets = [shingles(t) for t in texts]
    want, levels = [], set()
    for i, a in enumerate(sets):
        near = [(j, jaccard(a, b)) for j, b in enumerate(sets[:i]) if a and b]
        levels |= {int(10 * x) for _, x in near}
        near = [(j, x) for j, x in near if x >= 0.8]
        if near:
            want.append((i, near[0][0], round(near[0][1], 9)))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4)
    got = [(r["id"], r["kept"], round(r["jaccard"], 9)) for r in K.near_copies(df, "id", "t").collect()]
    assert sorted(got) == sorted(want) and {4, 6, 7, 8} <= levels
    assert K.near_copies(df.limit(0), "id", "t").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_closest_labels(spark):
    rng = random.Random(8)
    names = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(0, 7))) for _ in range(120)})
    asked = [rng.choice(names) + rng.choice(["", "a", "zz", "q"]) for _ in range(150)] + ["", None, "zzzzzzzzz", "ABC", "abc", "abc"]
    df = spark.createDataFrame(list(enumerate(asked)), "i long, t string")
    labels = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string")
    for edits in (0, 1, 2):
        want = []
        for i, t in enumerate(asked):
            best = min(((distance(t.lower(), n), n) for n in names), default=None) if t is not None else None
            ok = best is not None and best[0] <= edits
            want.append((i, t, best[1] if ok else None, best[0] if ok else None))
        assert rows(K.closest_labels(df, "t", labels, "n", edits), "i", "t", "label", "distance") == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    plan = K.closest_labels(df, "t", labels, "n")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert K.closest_labels(df.limit(0), "t", labels, "n").count() == 0
    assert K.closest_labels(df, "t", labels.limit(0), "n").filter("label is not null").count() == 0


def test_a_long_list_of_centroids_is_searched(spark, monkeypatch):
    rng = random.Random(5)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    train = spark.createDataFrame([(f"c{i % 40}", vec()) for i in range(200)], "l string, v array<double>")
    ask = spark.createDataFrame([(i, vec()) for i in range(50)] + [(90, None), (91, [0.0] * 4)], "id int, v array<double>")
    centroids = K.class_centroids(train, "v", "l")
    cut = lambda out: {r["id"]: (r["nearest"], None if r["similarity"] is None else round(r["similarity"], 9), r["route"]) for r in out.collect()}
    listed = cut(K.similarity_gate(ask, "v", centroids, 0.7, ["id"]))
    monkeypatch.setattr(K, "CENTROID_NUMBERS", 10)
    assert cut(K.similarity_gate(ask, "v", centroids, 0.7, ["id"])) == listed and len(listed) == 52
    assert listed[90] == listed[91] == (None, None, "review")


def test_fetched_rows_are_bounded_in_bytes(spark, monkeypatch):
    from corpusgauge.operators import common

    df = spark.createDataFrame([("x" * 1000,)] * 20, "t string")
    assert len(common.small_rows(df, 100)) == 20 and common.small_rows(df, 10) is None
    monkeypatch.setattr(common, "BROADCAST_BYTES", 5_000)
    assert common.small_rows(df, 100) is None
    assert common.broadcast_if_small(df).count() == 20


def test_near_copies_store_and_move_their_sets_once(spark, monkeypatch):
    """Equal texts under other keys, a key with two texts, and a pair to be intersected."""
    stored, cut = [], K.cut_lineage
    monkeypatch.setattr(K, "cut_lineage", lambda df: stored.append(df.dtypes) or cut(df))
    a, b = [" ".join(f"{c}{i}" for i in range(40)) for c in "ab"]
    texts = [(1, a), (2, a), (2, a), (3, a + " z"), (4, b), (3, b), (5, "short"), (6, None), (None, a)]
    df = spark.createDataFrame(texts, "id long, t string").repartition(3)
    out = K.near_copies(df, "id", "t")
    got = sorted((r["id"], r["kept"], round(r["jaccard"], 6)) for r in out.collect())
    near = round(36 / 37, 6)
    # as the join over all rows of a key had it
    assert got == [(2, 1, 1.0), (2, 1, 1.0), (3, 1, near), (3, 1, near), (4, 1, near)]
    assert sum(kind == "array<bigint>" for dtypes in stored for _, kind in dtypes) == 1
