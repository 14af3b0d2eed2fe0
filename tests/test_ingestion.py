import hashlib

import pytest
from conftest import by, rows
from pyspark.sql import functions as F

from corpusgauge.functions import sha256
from corpusgauge.operators import ingestion as I
from corpusgauge.plans.validate import validate_ingestion
from corpusgauge.sources import tables as S


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(300).select(
        "id",
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("v"), (F.col("id") % 5).cast("string"))).alias("s"),
        (F.col("id") / 3).alias("x"),
    )


def test_flat_hash_golden(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c|d")], "k int, v string")
    one = I.aggregate_hash(df, ["k", "v"], "flat")
    golden = "b9de47788e56ed217cbba401c2d793b8988d463b98286892d3cd9b736a3abac1"
    assert one.head()["aggregate_hash"] == golden
    rows_ = sorted(hashlib.sha256(t.encode()).hexdigest() for t in ("1|a", "2|<<NaN>>", "3|c|d"))
    assert hashlib.sha256("".join(rows_).encode()).hexdigest() == golden


def test_sha256_is_taken_up_where_it_was_left():
    data = bytes(range(256)) * 3
    for step in (sha256.blocks, sha256.plain_blocks):
        state = sha256.START
        for piece in (data[:64], data[64:64], data[64:320], data[320:]):
            state = step(state, piece)
        assert sha256.finish(state, len(data)) == hashlib.sha256(data).hexdigest()
    assert sha256.finish(sha256.START, 0) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        sha256.blocks(sha256.START, b"x")


@pytest.mark.parametrize("parts, link", [(1, 1 << 21), (7, 500), (3, 300)])
def test_flat_hash_is_formed_in_links(spark, parts, link, monkeypatch):
    """No task takes more than a slice, and a row that comes often keeps its copies."""
    taken = []
    monkeypatch.setattr(I, "_link", lambda state, f=I._link: taken.append(state) or f(state))
    keys = [7 if i % 3 == 0 else i for i in range(2000)]
    base = spark.createDataFrame([(k,) for k in keys], "k long").repartition(parts)
    text = "".join(sorted(hashlib.sha256(str(k).encode()).hexdigest() for k in keys))
    got = I.flat_hash(I.row_hashes(base, ["k"]), link).head()[0]
    assert got == hashlib.sha256(text.encode()).hexdigest()
    assert len(taken) == -(-2000 // link)
    assert len(set(taken)) == len(taken)


def test_flat_hash_of_few_rows(spark):
    none = I.row_hashes(spark.createDataFrame([], "k long"), ["k"])
    assert I.flat_hash(none).head()[0] == hashlib.sha256(b"").hexdigest()
    # null hashes are left out; slices without a hash are passed over
    some = spark.createDataFrame([(hashlib.sha256(b"a").hexdigest(),), (None,)] * 2, "h string")
    want = hashlib.sha256((hashlib.sha256(b"a").hexdigest() * 2).encode()).hexdigest()
    assert I.flat_hash(some, 1).head()[0] == want


def tree(counts, levels):
    nodes = [(d, f"{d}:{c}") for d, c in counts.items()]
    for digits in levels:
        groups = {}
        for p, e in nodes:
            groups.setdefault(p[:digits], []).append(e)
        nodes = [(p, p + "=" + hashlib.sha256("".join(sorted(e)).encode()).hexdigest()) for p, e in groups.items()]
    return nodes[0][1][1:]


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_tree_hash_is_free_of_order_and_placement(spark, parts):
    """A third of the rows are equal; they form one counted leaf."""
    base = spark.range(20000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    h = I.row_hashes(base.repartition(parts).orderBy(F.rand(parts)), ["k"])
    counts = {}
    for i in range(20000):
        d = hashlib.sha256(str(-1 if i % 3 == 0 else i).encode()).hexdigest()
        counts[d] = counts.get(d, 0) + 1
    assert I.tree_hash(h).head()[0] == tree(counts, (6, 3, 0))
    if parts == 1:
        for levels in ((2, 1, 0), (0,), (4, 0)):
            assert I.tree_hash(h, levels).head()[0] == tree(counts, levels)
        other = I.tree_hash(I.row_hashes(base.filter("k <> 1"), ["k"])).head()[0]
        assert other != tree(counts, (6, 3, 0))


def test_digest_modes(table):
    with pytest.raises(ValueError):
        I.aggregate_hash(table, ["id"], "auto")
    assert I.aggregate_hash(table, ["id"]).head() != I.aggregate_hash(table, ["id"], "flat").head()


def jobs(spark, work):
    """Spark jobs that ``work`` starts."""
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    group = f"jobs-{id(work)}"
    sc.setJobGroup(group, group)
    try:
        work()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_sections_are_computed_on_demand(spark, table):
    assert jobs(spark, lambda: I.validation_report(table, sections=["column", "dtype"])) == 0
    assert jobs(spark, lambda: I.validation_report(table, sections=["shape"])) <= 2
    whole = {tuple(r) for r in I.validation_report(table, ["id"]).collect()}
    for s in I.SECTIONS:
        part = {tuple(r) for r in I.validation_report(table, ["id"], sections=[s]).collect()}
        assert part == {r for r in whole if r[0] == s}
    with pytest.raises(ValueError):
        I.validation_report(table, sections=["other"])


def test_a_report_takes_three_looks(spark, table, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    looks = []
    for name in ("collect", "first", "count", "toPandas"):
        real = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, *a, _real=real, _n=name, **k: looks.append(_n) or _real(self, *a, **k))
    I.validation_report(table, ["id"])
    assert looks.count("collect") == 3 and looks.count("first") == 2
    monkeypatch.undo()
    # quartiles by brackets equal those of one buffer
    whole = {tuple(r) for r in I.validation_report(table, sections=["stat"]).collect()}
    monkeypatch.setattr(I, "SMALL_GROUP", 1)
    assert {tuple(r) for r in I.validation_report(table, sections=["stat"]).collect()} == whole
    assert I.validation_report(table.limit(0)).filter("section = 'stat'").count() == 0


def status(checks):
    return {r["check"]: r["status"] for r in checks.collect()}


def test_equal_tables_pass(table):
    out = validate_ingestion(table, table.orderBy(F.desc("id")).repartition(5), ["id", "s"])
    assert set(status(out["checks"]).values()) == {"PASS"}
    assert out["overall"].head()[0] == "PASS"


def test_changed_values_fail(table):
    other = table.withColumn("x", F.when(F.col("id") == 5, 1e6).otherwise(F.col("x"))).withColumn("s", F.when(F.col("id") != 3, F.col("s")))
    out = validate_ingestion(table, other, ["id", "s"])
    got = status(out["checks"])
    assert got["shape_match"] == got["column_match"] == got["dtype_match"] == "PASS"
    assert got["stats_match"] == got["null_count_match"] == got["hash_match"] == "FAIL"
    assert out["overall"].head()[0] == "FAIL"
    stats = by(out["stats"], ["column", "stat"])
    assert stats["x", "max"]["outcome"] == "differs" and stats["x", "min"]["outcome"] == "equal"


def test_other_columns_skip_the_element_checks(table):
    out = validate_ingestion(table, table.select("s", "id", "x"))
    got = {r["check"]: (r["status"], r["warning"]) for r in out["checks"].collect()}
    assert got["column_match"] == ("FAIL", "column order differs")
    assert got["dtype_match"][0] == got["stats_match"][0] == got["null_count_match"][0] == "SKIPPED"
    assert got["hash_match"][0] == "SKIPPED"
    gone = by(validate_ingestion(table, table.drop("x").withColumn("y", F.lit(1)))["columns"], "column")
    assert gone["x"]["finding"] == "base_only" and gone["y"]["finding"] == "ingested_only"


def test_integer_widths_are_compatible(table):
    out = validate_ingestion(table, table.withColumn("id", F.col("id").cast("int")))
    assert status(out["checks"])["dtype_match"] == "PASS"
    out = validate_ingestion(table, table.withColumn("x", F.col("x").cast("string")))
    assert status(out["checks"])["dtype_match"] == "FAIL"


def report(spark, **stats):
    base = [("shape", None, None, "rows", "4"), ("column", "s", 0, "name", "s"), ("dtype", "s", 0, "type", "string"), ("null", "s", None, "nulls", "0"), ("hash", None, None, "hashed", "false")]
    return spark.createDataFrame(base + [("stat", "s", None, k, v) for k, v in stats.items()], I.REPORT_SCHEMA)


def test_top_rules(spark):
    a, b = report(spark, top="Foo", freq="2"), report(spark, top=" foo", freq="2")
    out = I.compare_reports(a, b)
    assert status(out)["stats_match"] == "PASS_WITH_WARNINGS"
    assert I.overall_status(out).head()[0] == "PASS_WITH_WARNINGS"
    assert status(I.compare_reports(a, b, ignore_top_on_equal_freq=False))["stats_match"] == "FAIL"
    assert status(I.compare_reports(a, b, normalize_top=True))["stats_match"] == "PASS"
    c = report(spark, top="Foo", freq="3")
    assert by(I.compare_stats(b, c), "stat")["top"]["outcome"] == "differs"
    gone = by(I.compare_stats(a, report(spark, freq="2")), "stat")["top"]
    assert (gone["ingested"], gone["outcome"]) == ("MISSING_OR_NULL", "differs")


def test_hash_on_one_side_and_errors(table):
    plain, hashed = I.validation_report(table), I.validation_report(table, ["id"])
    assert I.compare_hashes(plain, hashed).head()[:2] == ("SKIPPED", True)
    assert I.compare_hashes(plain, plain).head()[:2] == ("SKIPPED", False)
    broken = I.validation_report(table, ["absent"])
    assert I.compare_hashes(broken, hashed).head()[:2] == ("ERROR", True)
    other = I.validation_report(table, ["id", "s"], sort_for_hashing=False)
    assert I.compare_hashes(hashed, other).head()["warning"] == "different key columns; different sorting settings"


def test_report_files(spark, table, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    S.write_report(I.validation_report(table, ["id"]), a)
    S.write_report(I.validation_report(table, ["id"]), b)
    checks, overall = S.compare_report_files(spark, a, b)
    assert overall.head()[0] == "PASS" and checks.count() == 6
    checks, overall = S.compare_report_files(spark, a, str(tmp_path / "none"))
    assert overall.head()[0] == "ERROR" and checks.count() == 0


def test_csv_fallback(spark, tmp_path):
    p = str(tmp_path / "c")
    spark.createDataFrame([(1, 'a "quoted", one')], "i int, t string").write.option("header", True).option("escape", '"').csv(p)
    got = S.read_csv(spark, [str(tmp_path / "absent"), p], "i int, t string")
    assert rows(got) == [(1, 'a "quoted", one')]
    with pytest.raises(FileNotFoundError):
        S.read_csv(spark, [str(tmp_path / "absent")], "i int")


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    p = str(tmp_path / "d")
    spark.createDataFrame([("en", "x", 1), ("de", "y", 2)], "lang string, more string, doc_id int").write.option("header", True).csv(p)
    assert rows(S.read_csv(spark, [p], "doc_id int, lang string")) == [(1, "en"), (2, "de")]
    with pytest.raises(ValueError):
        S.read_csv(spark, [p], "doc_id int, absent string")
    with pytest.raises(Exception):  # noqa: B017
        S.read_csv(spark, [p], "lang int").collect()
