"""Quality rules, URL filter, archive, mixture, personal data, classifier."""

import base64
import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgauge.llm import classifier, mixture, pii, quality_rules, url_filter, warc
from corpusgauge.llm.queries import QUERIES, SQL
from tools.check_queries import TABLES, canonical

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0),
    (2, "", None, None, 0),
    (3, " \n\t ", "en", "b", 4),
    (4, "one", "en", "a", 3),
    (4, "one", "en", "a", 3),
    (None, "two words", "en", "z", 9),
    (6, "long " * 30_000 + "ende é\n" * 40, "en", "a", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create table {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


# -- quality rules -------------------------------------------------------------


def rule_facts(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(covered),
    )


def test_rules_measure_whole_texts(spark, odd):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("a b c d | ## e\n f\x0b g").split(" ")[0] + rng.choice(["", "\n", "é"]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = quality_rules.judge(docs).collect()
    for r in got:
        have = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert have == rule_facts(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_have_no_user_functions_and_keep_clashing_columns(spark, odd):
    out = quality_rules.judge(odd.withColumn("n_words", odd.doc_id).withColumn("kept", odd.lang))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert out.columns.count("n_words") == out.columns.count("kept") == 1
    assert out.count() == len(ODD) and quality_rules.judge(odd.limit(0)).count() == 0


# -- URL filter ----------------------------------------------------------------


def verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group().translate({i: i + 32 for i in range(65, 91)})
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    best = None
    for v, h, p in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "http://ORG/", "http://a.org", "http://a.org/x", "https://m.Example.org/es/1?q=/", "http://example.org/en/12#x",
        "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/de", "http://x.com/de/?a", "ftp://é.com/fr/\n/x", "http://spam.net/", "http://a.com?x=/fr/",
        "http://a.com/fr/", "http://a.com/fr/", "x://y://b.org/z", "http://com/fr/" + "a/" * 5000,
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, best = verdict(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, best[0] if best else None), u
        assert r.verdict == (best[1] if best else "block" if "spam" in host else "allow")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_rules_are_filed_under_their_rarest_token(spark, monkeypatch):
    rules = [url_filter.prefix_rule("block", "common.com", "/rare/"), url_filter.UrlRule("any", "block", "zzz")]
    urls = [f"http://common.com/{'rare/' if i == 0 else i}" for i in range(5)] + ["http://common.com/zzz"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    at = pages.select("url", *[c.alias(n) for c, n in zip(url_filter.split_url(pages.url), ("h", "p"))])
    tokens = at.select(url_filter.tokens(at.h, at.p).alias("tokens"))
    index = url_filter.rule_index(url_filter.rule_table(spark, rules), tokens, True)
    assert {r.rule: r.token for r in index.collect()} == {"common.com/rare/": "rare", "any": ""}
    blocked = lambda: [r.page_id for r in url_filter.judge_urls(pages, rules).filter("verdict = 'block'").sort("page_id").collect()]
    assert blocked() == [0, 5]
    # more rules than are broadcast are joined, with the same verdicts
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 1)
    plan = url_filter.judge_urls(pages, rules)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in plan.lower() and blocked() == [0, 5]
    many = [url_filter.prefix_rule("block", f"h{i}.org", "/x/") for i in range(300)]
    extra = spark.createDataFrame([(i, f"http://a.h{i}.org/x/y") for i in range(0, 600, 7)], "page_id long, url string")
    got = url_filter.judge_urls(extra, many).filter("verdict = 'block'").count()
    assert got == len(range(0, 300, 7))


# -- archive -------------------------------------------------------------------


def test_archive_round_trip(spark):
    rows = [
        (1, "http://a/\r\nX: y", "same"), (5, None, "same"), (3, "u", "same"), (7, "u", None), (8, "u", ""), (9, "u", "é" * 50_000),
        (4, "u", "twice"), (4, "u", "twice"), (None, "u", "same"), (None, "u", "alone"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("address", pa_lit("x"))
    archive = warc.write_archive(pages)
    assert spark.read.parquet(archive.payloads).count() == 5
    full = archive.reconstruct(spark).collect()
    assert len(full) == len(rows)
    for r in full:
        head, block = bytes(r.record).split(b"\r\n\r\n", 1)
        assert block.endswith(b"\r\n\r\n") and head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        want = bytes(r.payload) if r.record_type == "response" else b""
        assert block[:-4] == want and f"Content-Length: {len(want)}".encode() in head
    got = sorted(warc.archived_pages(pages).collect(), key=str)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter(
        [(1, "revisit", 5), (5, "response", None), (3, "revisit", 5), (7, "revisit", 8), (8, "response", None), (9, "response", None),
         (4, "response", None), (4, "response", None), (None, "revisit", 5), (None, "response", None)]
    )
    texts = {r[0]: r[2] or "" for r in rows}
    for r in got:
        if r.page_id is not None:
            data = texts[r.page_id].encode()
            assert r.payload_bytes == len(data)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    small = {r.page_id: r.record_type for r in warc.archived_pages(pages.filter("page_id < 7"), least=5).collect()}
    assert set(small.values()) == {"response"}
    assert warc.archived_pages(pages.limit(0)).count() == 0
    # a payload that was changed, or is gone, ends the read
    payloads = spark.read.parquet(archive.payloads)
    for i, bad in enumerate([payloads.withColumn("payload", F.lit(b"other")), payloads.limit(0)]):
        bad.write.parquet(f"{archive.payloads}-{i}")
        with pytest.raises(Exception, match="damaged record"):
            warc.Archive(archive.headers, f"{archive.payloads}-{i}").checked(spark).collect()


def pa_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


# -- mixture -------------------------------------------------------------------


def test_mixture_meets_targets_and_agrees_on_reruns(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 400), rng.choice([None, "b", "a", "c", "hot", "hot", "hot"])) for i in range(400)]
    rows += [(400, "tiny doc", "small"), (401, None, "a"), (401, None, "a"), (None, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixture.mix(docs).documents.collect()
    assert len(got) == len(rows) and Counter(got) == Counter(mixture.mix(docs).documents.collect())
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        assert r.source_size == sum(len((t or "").split()) for _, t, s in rows if s == r.source)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    level = max(target[s] / w for s, w in zip(sorted(x for x in size if x), [5, 2, 1] * 3))
    for s, w in zip([*sorted(x for x in size if x), None], [5, 2, 1] * 3):
        assert target[s] == pytest.approx(min(2 * size[s], w * level))
        assert abs(taken[s] - target[s]) <= max(2, 0.02 * target[s])


def test_permutation_is_one_to_one_and_mixed(spark):
    for n in (1, 2, 7, 1000, 20_000):
        df = spark.range(n).selectExpr("id as x", f"{n}L as n", "3L as source_no", "1L as epoch")
        got = {r.x: r.y for r in mixture.permute(df, "x", "n", "epoch", 17, "y").collect()}
        assert sorted(got) == list(range(n)) and sorted(got.values()) == list(range(n))
    # images of near places are as far apart as any two: mean n / 3, spread n / sqrt(18)
    step = np.abs(np.diff([got[x] for x in range(n)]))
    assert abs(step.mean() / n - 1 / 3) < 0.01 and abs(step.std() / n - 18**-0.5) < 0.01
    # another seed, source or epoch is another permutation
    other = {r.x: r.y for r in mixture.permute(df, "x", "n", "epoch", 18, "y").collect()}
    assert sum(other[x] == got[x] for x in got) < 10


def test_mixture_slots_are_multinomial_and_native(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mixture.mix(docs, mixture.Mixture(shard_slots=64))
    counts = out.shard_counts().toPandas()
    shards = counts["shard"].max() + 1
    assert shards > 20
    for _, of in counts.groupby("source_no"):
        seen = of.set_index("shard")["slots"].reindex(range(shards), fill_value=0)
        if seen.sum() >= 5 * shards:
            # chi-square over its degrees of freedom is near 1: neither even nor clustered
            ratio = ((seen - seen.mean()) ** 2 / seen.mean()).sum() / (shards - 1)
            spread = (2 / (shards - 1)) ** 0.5
            assert 1 - 4 * spread < ratio < 1 + 4 * spread
    whole = counts.groupby("shard")["slots"].sum()
    ratio = ((whole - whole.mean()) ** 2 / whole.mean()).sum() / (shards - 1)
    assert 1 - 4 * (2 / (shards - 1)) ** 0.5 < ratio < 1 + 4 * (2 / (shards - 1)) ** 0.5
    slots = out.slots.select("source_no", "epoch", "slot").collect()
    assert len(slots) == len(set(slots)) == whole.sum()
    assert "Arrow" not in out.documents._jdf.queryExecution().executedPlan().toString()


def test_mixture_of_nothing(spark, odd):
    assert mixture.mix_documents(odd.limit(0)).count() == 0
    zero = mixture.mix_documents(odd.filter("text is null").withColumn("size", odd.doc_id)).collect()
    assert [(r["size"], r.taken, r.target) for r in zero] == [(0, 0, 0.0)]


# -- personal data -------------------------------------------------------------


def brute_spans(t):
    out = []
    for k, rx in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(rx, t or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if k == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if k == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["a@b.co", "x", "@", ".", "1.2.3.4", "256.1.1.1.7", "+1 (017) 555-7713", "4539 1488 0343 6467", "4539148803436467", "é", " ", "-", "+", "_", "%", "0" * 20, "..", "9"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert [(pii.KINDS[k - 1], a, b) for k, a, b in pii.base_spans(t)] == brute_spans(t), t
    long = "7" * 200_000 + "@" * 50_000 + "1." * 50_000 + "(" * 50_000
    begin = time.time()
    pii.base_spans(long)
    assert time.time() - begin < 5  # linear time


def test_field_carries_labels_to_repeats(spark):
    filler = "plain words without anything"
    rows = [(i, f"{filler} call +1 (017) 555-{1000 + i} or +1 (017) 555-{1000 + i} at version 2.0 and {i % 7} more") for i in range(60)]
    rows += [(100, f"call +1 (017) 555-7713 today. {filler} * 9. again 1 (017) 555-7713 there"), (101, f"{filler} chapter 12 and 1998"), (102, None), (103, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.label_documents(docs).collect()}
    assert len(got) == len(rows)
    t = dict(rows)[100]
    assert [(s.kind, t[s.start : s.end]) for s in got[100].base] == [("phone", "+1 (017) 555-7713")]
    assert [(s.kind, t[s.start : s.end].strip(" (")) for s in got[100].added] == [("phone", "1 (017) 555-7713")]
    assert not got[101].base and not got[101].added and not got[102].base and not got[103].added
    assert pii.label_documents(docs.limit(0)).count() == 0
    assert pii.redact("mail a@b.co now", [("email", 5, 11)]) == "mail <email> now"


def informal(n, share, seed=0):
    """Documents of which a share repeats a phone and an address in another form."""
    rng, rows, hidden = random.Random(seed), [], {}
    word = lambda: rng.choice("lorem ipsum dolor sit amet elit sed do tempor".split())
    for i in range(n):
        phone, mail = f"({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}", f"{word()}{i}"
        say = lambda k: " ".join(word() for _ in range(k))
        t = f"{say(9)} in {rng.randint(1900, 2030)} about {rng.randint(1, 99)} of {say(3)} no {rng.randint(10**9, 10**10)} {say(4)} tel +1 {phone} and {mail}@mail.org {say(20)} "
        if i < share * n:
            a = len(t) + 5
            t += f"call 1 {phone} or write {mail}(at)mail.org {say(5)}"
            hidden[i] = [("phone", a, a + len(phone) + 2), ("email", t.index(f"{mail}(at)"), t.index(f"{mail}(at)") + len(mail) + 12)]
        rows.append((i, t + f" page {rng.randint(1, 500)}"))
    return rows, hidden


@pytest.mark.parametrize("n,share", [(300, 1.0), (500, 0.1)])
def test_informal_repeats_are_found_and_filler_is_not(spark, n, share):
    rows, hidden = informal(n, share)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: sorted((s.kind, s.start, s.end) for s in r.added) for r in pii.label_documents(docs).collect()}
    asked = {(i, s) for i, spans in hidden.items() for s in spans}
    added = {(i, s) for i, spans in got.items() for s in spans}
    assert len(asked & added) >= 0.95 * len(asked)
    # of the filler numbers, five in every document, none is taken
    assert not added - asked


def test_query_of_personal_data_equals_patterns_and_enumeration(spark, tmp_path):
    rows, hidden = informal(120, 0.5, 3)
    rows += [(500, None), (501, ""), (None, "a@b.co 1.2.3.4"), (502, "a@b.co"), (502, "a@b.co"), (503, "x" * 100_000 + " +49 (30) 123-4567")]
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, spans string, base int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans, r.n_added) for r in QUERIES["op4_pii"](spark, str(tmp_path)).collect())
    want = Counter()
    order = lambda spans: sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
    text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in order(spans))
    for i, t in rows:
        base = brute_spans(t or "")
        more = hidden.get(i, [])
        count = Counter(k for k, _, _ in base)
        want[(i, *[count[k] for k in pii.KINDS], hashlib.sha256(text(base).encode()).hexdigest(), text(base + more), len(more))] += 1
    assert got == want


def test_messages_agree_with_enumeration():
    rng = np.random.default_rng(0)
    x = np.zeros((3, len(pii.FIELDS)), dtype=np.int64)
    x[:, 3] = 7  # one key: a chain of three
    x[0, 0] = 3
    field = pii.Field(np.log(np.array([0.6, 0.1, 0.1, 0.1, 0.1])), [rng.normal(size=(n, pii.LABELS)) for _, n in pii.SHAPE], np.array([1.5, 0.5]))
    got = field.decide(np.zeros(3, dtype=np.int64), x)
    unary = np.tile(field.prior, (3, 1)) + sum(t[0] for t in field.shape)
    unary = np.clip(unary - unary.max(1, keepdims=True), -6, 0)
    unary[0] = -20
    unary[0, 3] = 0
    p = np.zeros((3, pii.LABELS))
    for a in range(5):
        for b in range(5):
            for c in range(5):
                w = np.exp(unary[0, a] + unary[1, b] + unary[2, c] + 1.5 * ((a == b) + (b == c)))
                p[0, a] += w
                p[1, b] += w
                p[2, c] += w
    assert np.allclose(got, p / p.sum(1, keepdims=True), atol=1e-3)


# -- classifier ----------------------------------------------------------------


def test_classifier_on_held_out_rows(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").unionByName(odd.filter("doc_id is null or doc_id < 4"))
    labels = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    out = classifier.score_documents(docs, labels).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    at = out.merge(labels.toPandas(), on="doc_id")
    at = at[at["held_out"]]
    pos, neg = at["score"][at["quality"] == 1].to_numpy(), at["score"][at["quality"] == 0].to_numpy()
    auc = (pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2
    assert auc > 0.95
    assert ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()


def test_classifier_fit_equals_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").cast("double").alias("y"))
    rows = classifier.text_statistics(docs).join(labels, "doc_id").filter("y is not null").select("x", "y", (F.col("doc_id") % 4 == 0).alias("held"))
    model = classifier.fit(rows, F.col("held"))
    at = rows.toPandas()
    x, y, held = np.array(at["x"].tolist()), at["y"].to_numpy(), at["held"].to_numpy()
    assert np.allclose(model.mean, x[~held].mean(axis=0)) and np.allclose(model.scale[x.std(axis=0) > 1e-3], x[~held].std(axis=0)[x.std(axis=0) > 1e-3])
    z = model.features(x[~held])
    penalty = 1e-2 * np.eye(z.shape[1])
    penalty[0, 0] = 0.0
    beta = np.linalg.solve(z.T @ z + penalty + 1e-9 * np.eye(z.shape[1]), z.T @ y[~held])
    # the system is ill-conditioned, its fit is not: raw scores agree
    assert np.abs(model.raw(x) - model.features(x) @ beta).max() < 1e-5
    # isotonic steps rise, and match the shares of the held rows they pool
    assert (np.diff(model.steps) >= 0).all()
    bins = np.clip(np.floor((model.raw(x[held]) + 0.5) / 2.0 * classifier.BINS), 0, classifier.BINS - 1)
    order = np.unique(bins)
    share = np.array([y[held][bins == b].mean() for b in order])
    want = np.clip(classifier.pool_adjacent(share, np.array([(bins == b).sum() for b in order], dtype=float)), 0.001, 0.999)
    assert np.allclose(model.steps, want)


def test_classifier_without_labels_or_documents(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classifier.score_documents(odd, none).collect()} == {0.5}
    assert classifier.score_documents(odd.limit(0), none).count() == 0


def test_pool_adjacent():
    assert classifier.pool_adjacent(np.array([0.0, 1.0, 0.0, 1.0]), np.array([1.0, 1.0, 3.0, 1.0])).tolist() == [0, 0.25, 0.25, 1]
