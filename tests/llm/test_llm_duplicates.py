"""Repeated strings, lines, near-duplicates, decontamination and the pipeline against
brute force on small texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from corpusgauge.llm import components, decontaminate, line_dedup, near_dedup, suffix_dedup, textbytes
from corpusgauge.llm.queries import QUERIES
from corpusgauge.llm.store import stored

WORDS = [a + b for a in ("ba", "ké", "lo", "mi", "nu", "ra", "si", "to") for b in ("n", "rt", "sh", "l", "", "nd")]


def prose(rng, n, sep=0.05):
    return "".join(rng.choice(WORDS) + ("\n" if rng.random() < sep else " ") for _ in range(n)).strip()


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    base = [prose(rng, rng.randint(20, 160)) for _ in range(25)]
    out = [*base, *base[:6], *(edited(rng, t, 2) for t in base[:12]), *(edited(rng, t, 9) for t in base[3:9])]
    shared = prose(rng, 40, 0)
    out += [prose(rng, 10) + " " + shared + " " + prose(rng, 10) for _ in range(8)]
    out += ["na " * 300, "na " * 260, "", None, " \n ", "one", "one", "Two words", "two WORDS", "a b c", base[0], base[0]]
    out += [prose(rng, 9000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, i % 3) for i, t in enumerate(texts)]
    rows += [(3, texts[3], 1), (None, texts[5], 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, component int")


# -- byte helpers --------------------------------------------------------------


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x0c\r\x1c.", max_size=30)), max_size=12))
@settings(max_examples=200, deadline=None)
def test_words_and_lines_of_chunks(values):
    got_words, got_lines = [], []
    for c in textbytes.chunks(pa.array(values, pa.string()), 16):
        data = c.buf.tobytes()
        s, e, first = c.words()
        w = [data[a:b] for a, b in zip(s, e)]
        got_words += [w[x:y] for x, y in zip(first[:-1], first[1:])]
        b, e, first = c.lines()
        x = [data[i:j] for i, j in zip(b, e)]
        got_lines += [x[i:j] for i, j in zip(first[:-1], first[1:])]
        h = c.span_hash(c.prefix(), s, c.words()[1])
        assert len(set(h.tolist())) == len(set(w))
    assert got_words == [(v or "").encode().split() for v in values]
    assert got_lines == [(v or "").encode().split(b"\n") for v in values]


# -- repeated strings ----------------------------------------------------------


def covered(texts, length, keep):
    """Bytes covered by repeated strings; ``first`` spares strings seen first."""
    where = defaultdict(list)
    for d, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            where[t[p : p + length]].append((d, p))
    out = [np.zeros(len(t), dtype=bool) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for d, p in places if keep == "none" else sorted(places)[1:]:
                out[d][p : p + length] = True
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("crowd", [2048, 2])
def test_repeats_equal_brute_force(spark, texts, keep, crowd):
    data = [(t or "").encode() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, 41, keep, crowd=crowd).collect()}
    assert len(got) == len(texts)
    for i, m in enumerate(covered(data, 41, keep)):
        kept = np.frombuffer(data[i], dtype=np.uint8)[~m].tobytes()
        assert bytes(got[i].kept) == kept and got[i].n_bytes == len(data[i])
        edge = np.diff(np.concatenate([[0], m.astype(int), [0]]))
        assert [(s.start, s.end) for s in got[i].removed] == list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))


def test_repeats_of_repeated_and_missing_rows(spark):
    t = " ".join(str(i * i) for i in range(60))
    docs = spark.createDataFrame([(1, t, 0), (1, t, 0), (None, "x" + t, 0), (2, None, 0)], "doc_id long, text string, id int")
    got = suffix_dedup.remove_repeats(docs, 50, "none").collect()
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in got) == [("1", b""), ("1", b""), ("2", b""), ("None", b"x")]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_longest_previous_factors():
    rng = random.Random(4)
    for _ in range(40):
        buf = bytes(rng.choice(b"ab") for _ in range(rng.randint(20, 60)))
        length = rng.choice([8, 11, 13])
        begins = np.arange(len(buf) - length + 1)
        order = suffix_dedup.SuffixOrder(np.frombuffer(buf, dtype=np.uint8), begins, np.zeros(len(begins), dtype=np.int64), length)
        for later in (False, True):
            got = order.longest_previous(later)
            for i in begins:
                others = begins[i + 1 :] if later else begins[:i]
                want = any(buf[i : i + length] == buf[j : j + length] for j in others)
                assert (got[i] >= length) == want
    pos = np.array([3, 1, 4, 0, 5, 2])
    assert suffix_dedup.nearest_smaller(pos).tolist() == [-1, -1, 1, -1, 3, 3]


# -- near-duplicates -----------------------------------------------------------


def shingles(text, n):
    w = re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_classes(rows, n):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}, {i: len(s) for i, s in sets}


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_equal_brute_force(spark, docs, texts, n):
    want, size = near_classes(list(enumerate(texts)), n)
    got = near_dedup.near_duplicates(docs, near_dedup.Forest(shingle=n)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], size[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = near_dedup.keep_first(docs, near_dedup.Forest(shingle=n))
    assert kept.columns == docs.columns and kept.filter("doc_id = 31").count() == (want[31] == 31)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_crowded_near_duplicates(spark):
    rng = random.Random(9)
    base = prose(rng, 120, 0)
    rows = [(i, edited(rng, base, rng.randint(1, 4))) for i in range(300)]
    want, _ = near_classes(rows, 4)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dedup.Forest(shingle=4)).collect()
    missed = sum(r.component_id != want[r.doc_id] for r in got)
    assert missed <= 3, missed


def template_family(n_pairs):
    """Pairs of similarity 0.82 in a family whose other pairs have 0.74."""
    rows = []
    core = [f"core{i}" for i in range(88)]
    for k in range(n_pairs):
        own = [f"c{k}x{i}" for i in range(5)]
        rows += [(2 * k + i, " ".join([*core, *own, *(f"d{k}y{i}z{j}" for j in range(10))])) for i in range(2)]
    return rows


def test_dense_links_do_not_depend_on_the_rounds_of_trees(spark):
    rows = template_family(250)
    want, _ = near_classes(rows, 5)
    assert len(set(want.values())) == 250
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # one round of one tree, then the exact join
    how = near_dedup.Forest(trees=8, dense=0, more_trees=1, worth=0)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, how).collect()} == want


def test_rows_cut_off_in_a_region_are_searched_however_few_they_met(spark):
    rows = template_family(250)
    want, _ = near_classes(rows, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # no document counts as dense by the number of its pairs
    how = near_dedup.Forest(trees=8, dense=10**6)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, how).collect()} == want


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(5, 5), (None, 3)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {i: find(i) for i in parent if find(i) != i}


# -- lines ---------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@given(st.binary(max_size=14), st.lists(st.tuples(st.sampled_from("ids"), st.integers(0, 14), st.integers(97, 99)), max_size=5))
@settings(max_examples=400, deadline=None)
def test_banded_distance(a, edits):
    b = bytearray(a)
    for op, i, x in edits:
        if op == "i":
            b.insert(i, x)
        elif i < len(b):
            if op == "d":
                del b[i]
            else:
                b[i] = x
    for k in (0, 1, 2, 3):
        assert line_dedup.within(a, bytes(b), k) == (distance(a, bytes(b)) <= k)


def test_lines_equal_brute_force(spark, tmp_path):
    rng = random.Random(6)
    base = [prose(rng, rng.randint(6, 14), 0) for _ in range(12)]

    def typo(t):
        t = list(t)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t))
            t[i : i + rng.choice([0, 1])] = rng.choice(["", "x", "y"])
        return "".join(t)

    rows = [(i, "\n".join(typo(rng.choice(base)) for _ in range(rng.randint(0, 8)))) for i in range(40)]
    rows += [(90, None), (91, ""), (92, "short\nshort\n\n"), (93, " " * 50), (94, rows[0][1]), (94, rows[0][1])]
    rows += [(95, f"short\n{'a long line ' * 5}\n\n \n\nshort\nshory"), (96, "short"), (97, "shory\nlines of a kind that are long enough")]
    docs = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, line string, n_chars long")
    places = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").encode().split(b"\n")) if x.split()]
    distinct = {}
    for i, k, x in sorted(places):
        distinct.setdefault(x, (i, k))
    parent = {x: x for x in distinct}
    links = Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(distinct)
    for k, x in enumerate(keys):
        for y in keys[:k]:
            if min(len(x), len(y)) >= 30 and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2:
                links[x] += 1
                links[y] += 1
                parent[find(x)] = find(y)
    first = {}
    for x in keys:
        first[find(x)] = min(first.get(find(x), distinct[x]), distinct[x])
    got = Counter((r.doc_id, r.line, r.class_id, r.class_line, r.kept) for r in line_dedup.line_classes(docs).collect())
    assert got == Counter((i, k, *first[find(x)], first[find(x)] == (i, k)) for i, k, x in places)
    # the registered query is the same operator
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    asked = QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.line, r.class_id, r.class_line, r.kept) for r in asked) == got
    assert sum(links.values()) > 20
    out = {r.doc_id: r for r in line_dedup.drop_lines(docs).collect()}
    for i, t in rows[:40]:
        cut = t.encode().split(b"\n")
        only_short = all(len(x) < 30 for x in cut)
        want = [x for k, x in enumerate(cut) if only_short or not x.split() or first[find(x)] == (i, k)]
        if len(want) == len(t.split("\n")):
            assert out[i].text == t
        elif any(x.split() for x in want):
            assert out[i].text == b"\n".join(want).decode() and out[i].n_chars == len(out[i].text)
        else:
            assert i not in out
    assert out[90].text is None and out[91].text == "" and out[92].text == "short\nshort\n\n"
    # short copies go from documents that have a long line
    assert out[95].text == f"{'a long line ' * 5}\n\n \n\nshory" and out[96].text == "short"
    assert out[97].text == "lines of a kind that are long enough"
    assert line_dedup.drop_lines(docs.limit(0)).count() == 0


def test_a_family_of_near_copied_lines_is_not_paired_out(spark, monkeypatch):
    rng = random.Random(16)
    base = prose(rng, 30, 0).replace("é", "e")
    # one edit from the base each, two from one another
    family = sorted({base[:i] + c + base[i + 1 :] for i in range(len(base)) for c in "abcdefghijklmnopqrstuvwxyz"})[:2_000]
    n = len(family)
    assert n == 2_000
    # a second family that shares the first third of the bytes, and lines on their own
    rest = "".join(rng.choice("xyzq ") for _ in range(len(base)))
    other = [base[: len(base) // 3] + f"{k:03}" + rest[len(base) // 3 + 3 :] for k in range(60)]
    rows = [(k, x) for k, x in enumerate(family + other + [prose(rng, 30, 0) for _ in range(200)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = []
    real = line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, found, how: made.append(pairs.count()) or real(pairs, found, how))
    got = {r.doc_id: r.class_id for r in line_dedup.line_classes(docs).collect()}
    assert {got[k] for k in range(n)} == {0}
    assert {got[k] for k in range(n, n + 60)} < set(range(n, n + 60))
    assert all(got[k] == k for k in range(n + 60, n + 260))
    # all pairs of the family would be two million
    assert made[0] <= 12 * len(rows) and made[1] <= len(rows)


# -- decontamination -----------------------------------------------------------


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(14, 90))) for i in range(30)] + [(30, None), (31, ""), (32, "three short words")]
    clean = [(i, text(rng.randint(5, 400))) for i in range(300)]
    rows, want = list(clean), set()
    for k in range(60):
        item, t = items[k % 30]
        words = t.split()
        if k >= 30:  # a paraphrase: every sixth word replaced, one put in
            words = [rng.choice(vocabulary) if j % 6 == 3 else w for j, w in enumerate(words)]
            words.insert(len(words) // 2, "inserted")
        rows.append((1000 + k, text(rng.randint(0, 150)) + " " + " ".join(words).upper() + ", " + text(rng.randint(0, 150))))
        want.add((1000 + k, item))
    rows += [(2000, None), (2001, ""), (2002, "so three short words here"), (2003, "three other short words")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, share string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got - want == {(2002, 32)}
    exact = {p for p in want if p[0] < 1030}
    assert exact <= got and len(want - got) <= 2, want - got
    kept = decontaminate.drop_contaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} >= {i for i, _ in clean}
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_planted_paraphrases_of_the_given_benchmark(spark):
    sf_dir = "/root/testdata/sf0.01"
    rng = random.Random(21)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    own = " ".join(r.text for r in given.filter("doc_id % 5 = 1 and lang = 'en'" if "lang" in given.columns else "doc_id % 5 = 1").collect())
    vocabulary = own.split()
    filler = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))

    def changed(words, how):
        if how == 0:
            return words
        if how < 3:
            return [rng.choice(vocabulary) if j % (6 if how == 1 else 4) == 2 else w for j, w in enumerate(words)]
        return [x for j, w in enumerate(words) for x in ([w, rng.choice(vocabulary)] if j % 3 == 2 else [w])]

    rows, want = [], set()
    for item, text in items:
        for how in range(4):
            k = 10_000_000 + len(rows)
            rows.append((k, f"{filler(rng.randint(20, 90))} {' '.join(changed(text.split(), how))} {filler(rng.randint(20, 90))}"))
            want.add((k, item))
    docs = given.unionByName(spark.createDataFrame(rows, given.schema)).repartition(6)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    found = {p for p in got if p[0] >= 10_000_000}
    missed = Counter((d - 10_000_000) % 4 for d, _ in want - found)
    # whole copies and those with every sixth word replaced are all found
    assert not missed[0] and not missed[1], missed
    assert missed[2] + missed[3] <= 4, missed
    assert len({d for d, _ in found}) <= len(rows)


def test_neighbouring_documents_do_not_hide_each_others_leaks(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = text(38)
    # one window each, and all of them after one another in one batch
    rows = [(i, text(rng.randint(5, 400))) for i in range(200)]
    rows += [(1000 + k, f"{text(k % 3 * 3)} {item} {text(6 - k % 3 * 2)}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1000 + k, 7) for k in range(12)}


@given(st.lists(st.integers(0, 4), max_size=9), st.lists(st.integers(0, 4), max_size=14))
@settings(max_examples=300, deadline=None)
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    masks = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    assert decontaminate.common_subsequence(masks, len(a), b) == table[-1][-1]


# -- pipeline ------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in at.collect()}
        out = stored(stage(spark, at, sf_dir), name)
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count()
        if k < 4:
            assert out.columns == docs.columns
        if name == "line_dedup":
            gone = [ln for i in before for ln in (before[i] or "").split("\n") if len(ln.encode()) >= 30]
            left = [ln for i in after for ln in (after[i] or "").split("\n") if len(ln.encode()) >= 30]
            assert len(left) == len(set(left)) and set(left) <= set(gone)
            short = [ln for t in after.values() for ln in (t or "").split("\n") if len(ln.encode()) < 30 and ln.encode().split() and any(len(x.encode()) >= 30 for x in t.split("\n"))]
            assert len(short) == len(set(short))
        elif name == "minhash_near_dedup":
            want, _ = near_classes(sorted(before.items()), 5)
            assert set(after) == {i for i, c in want.items() if c == i}
        elif name == "benchmark_decontamination":
            bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert not [i for i, t in after.items() if any(b in (t or "") for b in bench if len(b.split()) >= 10)]
        if k != 1:
            assert all(after[i] == before[i] for i in after)
        at = out
    assert {"size", "source_size", "target", "taken"} <= set(at.columns)
    whole = corpus_pipeline.run(spark, sf_dir)
    digest = lambda df: hashlib.sha256(str(sorted(map(tuple, df.collect()))).encode()).hexdigest()
    assert digest(whole) == digest(at) and len(texts) > whole.count()


def test_sketch_of_grams_keeps_lines_within_the_edits_and_drops_rearranged_ones():
    import numpy as np

    from corpusgauge.llm import line_dedup as D

    rng = np.random.default_rng(5)
    lines, edited = [], []
    for _ in range(300):
        line = bytearray(rng.integers(97, 103, int(rng.integers(30, 90))).astype(np.uint8).tobytes())
        other = bytearray(line)
        for _ in range(2):
            i = int(rng.integers(0, len(other)))
            kind = int(rng.integers(0, 3))
            if kind == 0:
                other[i] = int(rng.integers(97, 103))
            elif kind == 1:
                other.insert(i, 122)
            else:
                del other[i]
        lines.append(bytes(line))
        edited.append(bytes(other))

    def bits(some):
        n = np.array([len(x) for x in some])
        pair = D.gram_parities(np.frombuffer(b"".join(some), dtype=np.uint8), np.cumsum(n) - n, n)
        return [(int(t) & (1 << 64) - 1) | (int(u) & (1 << 64) - 1) << 64 for t, u in zip(*pair)]

    a, b = bits(lines), bits(edited)
    assert all((x ^ y).bit_count() <= 6 * 2 for x, y in zip(a, b))
    assert bits([lines[0]])[0] == a[0]  # a line's bits are its own
    # the same letters in another order are not near the line
    mixed = [rng.permutation(np.frombuffer(lines[1] + lines[2], dtype=np.uint8)).tobytes() for _ in range(60)]
    m = bits(mixed)
    assert all((m[i] ^ m[j]).bit_count() > 12 for i in range(60) for j in range(i))
