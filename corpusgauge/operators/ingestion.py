"""Did a table arrive intact? Content reports and their comparison.

A report is a small table of rows ``(section, column, position, stat, value)``:

=========  ==========================================================
section    rows
=========  ==========================================================
shape      ``rows`` and ``columns``
column     one per column, ``position`` giving the order
dtype      one per column
stat       descriptive statistics per column
null       null count per column
hash       ``hashed``, ``hash_columns``, ``mode``, ``aggregate_hash``, ``error``
=========  ==========================================================
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..datasets import DATASET, DatasetSet, kind_of
from ..functions import sha256
from ..functions.columns import fold_missing, row_text
from ..session import remove, scratch_path
from .quality import digest, value_digest_counts
from .quantiles import SMALL_GROUP, exact_quantiles, percentile_row

REPORT_SCHEMA = "section string, column string, position int, stat string, value string"
# Leading hex digits by which row hashes are grouped at each level of the digest
# tree, the same for a table of any size.
TREE_LEVELS = (6, 3, 0)
# Different row hashes, of 32 bytes, that one task of the flat digest reads.
LINK_ROWS = 1 << 21
# Copies of one hash that are digested at a time.
REPEATED = 1 << 14
SECTIONS = ("shape", "column", "dtype", "stat", "null", "hash")
# Fixed value: what a statistic reads that one side lacks.
MISSING = "MISSING_OR_NULL"
ONE = "table"
SIDES = ("base", "ingested")


# -- hashes -------------------------------------------------------------------


def row_hashes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """SHA-256 of each row's key columns joined by a bar."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"hash columns not found: {absent}")
    return df.select(F.sha2(row_text(list(columns)), 256).alias("h"))


def _link(state: bytes):
    """The state of the flat digest after one slice, whose hashes come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state
        for b in batches:
            h, c = b.column(0), b.column(1).to_numpy()
            # stretches of hashes that occur once, and single hashes that occur more often
            first = 0
            for i in [*np.flatnonzero(c > 1).tolist(), len(c)]:
                now = sha256.blocks(now, b"".join(h.slice(first, i - first).to_pylist()).hex().encode())
                first = i + 1
                if i < len(c):
                    one, left = h[i].as_py().hex().encode(), int(c[i])
                    while left:
                        now = sha256.blocks(now, one * min(left, REPEATED))
                        left -= min(left, REPEATED)
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary())], ["state"])

    return run


def flat_hash(hashes: DataFrame, link_rows: int = LINK_ROWS) -> DataFrame:
    """SHA-256 of all row hashes sorted and concatenated. The order makes this one
    sequence, but not one task: equal hashes are counted, and slices of about
    ``link_rows`` by leading digits are stored; the task of a slice takes up the digest
    in the state in which the one before left it. A hash in hex is one block of the
    digest, so nothing but that state travels. The jobs run while the frame is built."""
    spark = hashes.sparkSession
    slices = max(1, -(-hashes.count() // link_rows))
    counted = hashes.filter("h is not null").groupBy(F.unhex("h").alias("h")).agg(F.count(F.lit(1)).alias("c"))
    lead = F.conv(F.hex(F.substring("h", 1, 4)), 16, 10).cast("long")
    counted = counted.withColumn("slice", F.floor(lead * F.lit(slices) / F.lit(1 << 32)).cast("int"))
    path = scratch_path(spark, "row-hashes")
    counted.repartitionById(slices, "slice").write.partitionBy("slice").parquet(path)
    try:
        stored = spark.read.schema("h binary, c long, slice int").parquet(path)
        sizes = {r[0]: r[1] for r in stored.groupBy("slice").agg(F.sum("c")).collect()}
        state = sha256.START
        for k in sorted(sizes):
            one = spark.read.schema("h binary, c long").parquet(f"{path}/slice={k}")
            state = bytes(one.coalesce(1).sortWithinPartitions("h").mapInArrow(_link(state), "state binary").head()[0])
    finally:
        remove(spark, path)
    digest = sha256.finish(state, sha256.BLOCK * sum(sizes.values()))
    return spark.createDataFrame([(digest,)], "aggregate_hash string").coalesce(1)


def tree_hash(hashes: DataFrame, levels: Sequence[int] = TREE_LEVELS) -> DataFrame:
    """Order-free digest of any number of row hashes, by one algorithm for all.

    Equal hashes are counted first, so a row that makes up a third of the table
    is one leaf. Leaves are grouped by leading hex digits, each group's sorted
    leaves are hashed, and the digests are grouped again with fewer digits until
    one is left. A trillion different rows make groups of 60,000 leaves, and
    above the leaves no group has more than 4,096 entries.
    """
    level = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    level = level.select(F.col("h").alias("p"), F.concat_ws(":", "h", F.col("c").cast("string")).alias("e"))
    for digits in levels:
        level = level.select(F.substring("p", 1, digits).alias("p"), "e")
        level = level.groupBy("p").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("e"))), 256).alias("e"))
        # the prefix keeps siblings in order and apart
        level = level.select("p", F.concat("p", F.lit("="), "e").alias("e"))
    return level.select(F.substring("e", 2, 64).alias("aggregate_hash"))


def aggregate_hash(df: DataFrame, columns: Sequence[str], mode: str = "tree") -> DataFrame:
    """One-row frame with the table's digest."""
    if mode not in ("tree", "flat"):
        raise ValueError(f"mode is 'tree' or 'flat', not {mode!r}")
    hashes = row_hashes(df, columns)
    return flat_hash(hashes) if mode == "flat" else tree_hash(hashes)


# -- report -------------------------------------------------------------------


def _cells(df: DataFrame, section: str, column: Column, pairs: Sequence[tuple[str, Column]]) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        column.alias("column"),
        F.lit(None).cast("int").alias("position"),
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("stat"), v.cast("string").alias("value")) for s, v in pairs])
        ).alias("x"),
    ).select("section", "column", "position", "x.stat", "x.value")


def validation_report(
    df: DataFrame,
    hash_columns: Sequence[str] | None = None,
    hash_mode: str = "tree",
    sort_for_hashing: bool = True,
    sections: Sequence[str] = SECTIONS,
) -> DataFrame:
    """The report of one table, of which only the asked ``sections`` are computed:
    ``column`` and ``dtype`` need no look at the rows, ``shape`` one count. The
    digest does not depend on row order; ``sort_for_hashing`` is only recorded, so
    that two reports made with different settings can be told apart."""
    spark = df.sparkSession
    unknown = set(sections) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections {sorted(unknown)}")
    fields = df.schema.fields
    fixed = []
    if "column" in sections:
        fixed += [("column", f.name, i, "name", f.name) for i, f in enumerate(fields)]
    if "dtype" in sections:
        fixed += [("dtype", f.name, i, "type", f.dataType.simpleString()) for i, f in enumerate(fields)]
    parts: list[DataFrame] = []
    if {"shape", "null", "stat"} & set(sections):
        rows, parts = _profile(df, sections)
        fixed += rows
    hash_rows = [("hash", None, None, "hashed", "false")] if "hash" in sections else []
    if hash_columns and "hash" in sections:
        hash_rows = [
            ("hash", None, None, "hash_columns", ",".join(hash_columns)),
            ("hash", None, None, "sorted", str(sort_for_hashing).lower()),
        ]
        try:
            one = aggregate_hash(df, hash_columns, hash_mode)
        except ValueError as e:
            hash_rows += [("hash", None, None, "hashed", "false"), ("hash", None, None, "error", str(e))]
        else:
            hash_rows += [("hash", None, None, "hashed", "true"), ("hash", None, None, "mode", hash_mode)]
            parts.append(
                _cells(one, "hash", F.lit(None).cast("string"), [("aggregate_hash", F.col("aggregate_hash"))])
            )
    fixed += hash_rows
    # what needs a shuffle of its own is one query; its rows follow the columns
    if parts:
        stacked = parts[0]
        for p in parts[1:]:
            stacked = stacked.unionByName(p)
        found = [tuple(r) for r in stacked.filter("value is not null").collect()]
        tops = {r[1]: r[4] for r in found if r[3] == TOP_DIGEST}
        fixed += [r for r in found if r[3] != TOP_DIGEST] + _top_values(df, tops)
    # a report is as long as the table is wide: comparing two of them shuffles nothing
    return spark.createDataFrame(fixed, REPORT_SCHEMA).coalesce(1)


#: The statistic that stands for ``top`` until the text of its digest is known.
TOP_DIGEST = "top_digest"


def _profile(df: DataFrame, sections: Sequence[str]) -> tuple[list[tuple], list[DataFrame]]:
    """The typed profile of all columns: report rows from one aggregate (count of rows,
    of values, moments, extremes), and frames of report cells for what needs more, the
    quartiles and the counts of text digests."""
    base = fold_missing(df)
    fields = base.schema.fields
    stat = "stat" in sections
    kinds = {i: kind_of(f.dataType) for i, f in enumerate(fields)} if stat else {}
    numeric = [i for i, k in kinds.items() if k == "continuous"]
    dates = [i for i, k in kinds.items() if k == "datetime"]
    text = [fields[i].name for i in kinds if isinstance(fields[i].dataType, T.StringType)]
    col = lambda i: F.col(f"`{fields[i].name}`")
    wanted = [F.count(F.lit(1)).alias("n")]
    if stat or "null" in sections:
        wanted += [F.count(col(i)).alias(f"c{i}") for i in range(len(fields))]
    forms = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wanted += [f(col(i).cast("double")).cast("string").alias(f"{s}{i}") for i in numeric for s, f in forms.items()]
    wanted += [forms[s](col(i)).cast("string").alias(f"{s}{i}") for i in dates for s in ("min", "max")]
    row = base.agg(*wanted).first()
    rows: list[tuple] = []
    if "shape" in sections:
        rows += [("shape", None, None, "rows", str(row["n"])), ("shape", None, None, "columns", str(len(fields)))]
    if "null" in sections:
        rows += [("null", f.name, None, "nulls", str(row["n"] - row[f"c{i}"])) for i, f in enumerate(fields)]
    for i in [*numeric, *dates] if row["n"] else []:
        stats = [("count", str(row[f"c{i}"])), *[(s, row[f"{s}{i}"]) for s in (forms if i in numeric else ("min", "max"))]]
        rows += [("stat", fields[i].name, None, s, v) for s, v in stats if v is not None]
    parts = []
    if numeric and row["n"]:
        parts.append(_quartiles(base, [fields[i].name for i in numeric], row["n"]))
    if text and row["n"]:
        best = F.min(F.struct((-F.col("n")).alias("neg"), "k"))
        counts = value_digest_counts(DatasetSet({ONE: df}), text).groupBy("column")
        counts = counts.agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("best"))
        cells = [("count", F.col("count")), ("unique", F.col("unique")), ("freq", -F.col("best.neg")), (TOP_DIGEST, F.col("best.k"))]
        parts.append(_cells(counts, "stat", F.col("column"), cells))
    return rows, parts


def _quartiles(base: DataFrame, names: Sequence[str], n: int) -> DataFrame:
    """Cells of the exact quartiles: one buffer per column where the rows are few, by
    brackets beyond."""
    if n > SMALL_GROUP:
        found = exact_quantiles(base.withColumn(DATASET, F.lit(ONE)), [DATASET], names)
        label = F.concat(F.round(F.col("prob") * 100).cast("int").cast("string"), F.lit("%"))
        return found.select(
            F.lit("stat").alias("section"), "column", F.lit(None).cast("int").alias("position"), label.alias("stat"), F.col("quantile").cast("string").alias("value")
        )
    one = base.agg(*[percentile_row(F.col(f"`{c}`").cast("double")).alias(f"q{i}") for i, c in enumerate(names)])
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(s).alias("stat"), F.col(f"q{i}")[k].cast("string").alias("value"))
        for i, c in enumerate(names)
        for k, s in enumerate(("25%", "50%", "75%"))
    ]
    return one.select(F.explode(F.array(*cells)).alias("x")).select(
        F.lit("stat").alias("section"), "x.column", F.lit(None).cast("int").alias("position"), "x.stat", "x.value"
    )


def _top_values(df: DataFrame, tops: dict[str, str]) -> list[tuple]:
    """The texts of the most frequent digests, all in one scan."""
    if not tops:
        return []
    names = list(tops)
    wanted = [F.any_value(F.when(digest(F.col(f"`{c}`")) == F.lit(tops[c]), F.col(f"`{c}`")), F.lit(True)).alias(f"t{i}") for i, c in enumerate(names)]
    row = df.agg(*wanted).first()
    return [("stat", c, None, "top", row[f"t{i}"]) for i, c in enumerate(names)]


# -- comparison ---------------------------------------------------------------


def _section(report: DataFrame, section: str, side: str) -> DataFrame:
    return report.filter(F.col("section") == section).select(
        F.coalesce("column", F.lit("")).alias("column"),
        "stat",
        F.col("value").alias(side),
        F.col("position").alias(f"pos_{side}"),
    )


def _both(base: DataFrame, other: DataFrame, section: str) -> DataFrame:
    return _section(base, section, "base").join(
        _section(other, section, "ingested"), ["column", "stat"], "full_outer"
    )


def _close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    x, y = a.try_cast("double"), b.try_cast("double")
    numeric = x.isNotNull() & y.isNotNull()
    near = (F.abs(x - y) <= atol + rtol * F.abs(y)) | (x == y)
    return F.when(numeric, near).otherwise(a == b)


def compare_shapes(base: DataFrame, other: DataFrame) -> DataFrame:
    return _both(base, other, "shape").select(
        F.col("stat").alias("item"), "base", "ingested", F.coalesce(F.col("base") == F.col("ingested"), F.lit(False)).alias("equal")
    )


def compare_columns(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row per column name: on which side it is and whether it keeps its
    position."""
    side = (
        F.when(F.col("ingested").isNull(), "base_only")
        .when(F.col("base").isNull(), "ingested_only")
        .when(F.col("pos_base") == F.col("pos_ingested"), "same")
        .otherwise("moved")
    )
    return _both(base, other, "column").select(
        "column", side.alias("finding"), F.col("pos_base"), F.col("pos_ingested")
    )


def is_integer_type(c: Column) -> Column:
    return c.isin("tinyint", "smallint", "int", "bigint")


def compare_types(base: DataFrame, other: DataFrame) -> DataFrame:
    """Types per shared column; any two integer types are compatible."""
    b, i = F.col("base"), F.col("ingested")
    return (
        _both(base, other, "dtype")
        .filter(b.isNotNull() & i.isNotNull())
        .select("column", "base", "ingested", ((b == i) | (is_integer_type(b) & is_integer_type(i))).alias("compatible"))
    )


def compare_stats(
    base: DataFrame,
    other: DataFrame,
    rtol: float = 1e-5,
    atol: float = 1e-8,
    ignore_top_on_equal_freq: bool = True,
    normalize_top: bool = False,
) -> DataFrame:
    """Every statistic of the base table's columns with the rule that applied
    and its outcome: ``equal``, ``differs`` or ``ignored``. A statistic one side
    lacks differs and reads ``MISSING_OR_NULL``."""
    b, i = F.col("base"), F.col("ingested")
    pairs = _both(base, other, "stat")
    in_base = base.filter("section = 'column'").select("column").distinct()
    pairs = pairs.join(in_base, "column", "left_semi")
    freq = pairs.filter("stat = 'freq'").select(
        "column", F.coalesce(_close(b, i, rtol, atol), b.isNull() & i.isNull()).alias("freq_equal")
    )
    norm = (lambda c: F.trim(F.lower(c))) if normalize_top else (lambda c: c)
    top_equal = norm(b) == norm(i)
    missing = b.isNull() | i.isNull()
    equal = F.when(F.col("stat") == "top", top_equal).otherwise(_close(b, i, rtol, atol))
    ignored = (
        F.lit(ignore_top_on_equal_freq)
        & (F.col("stat") == "top")
        & F.coalesce("freq_equal", F.lit(True))
    )
    outcome = F.when(missing, "differs").when(equal, "equal").when(ignored, "ignored").otherwise("differs")
    gone = F.lit(MISSING)
    return pairs.join(freq, "column", "left").select(
        "column",
        "stat",
        F.coalesce(b, gone).alias("base"),
        F.coalesce(i, gone).alias("ingested"),
        outcome.alias("outcome"),
    )


def compare_nulls(base: DataFrame, other: DataFrame) -> DataFrame:
    return _both(base, other, "null").filter(F.col("base").isNotNull()).select(
        "column", "base", "ingested", F.coalesce(F.col("base") == F.col("ingested"), F.lit(False)).alias("equal")
    )


def compare_hashes(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row with the status of the hash check, whether it makes the whole
    validation fail, and what the two reports did differently."""

    tagged = base.filter("section = 'hash'").withColumn("side", F.lit("base")).unionByName(
        other.filter("section = 'hash'").withColumn("side", F.lit("ingested"))
    )

    def pick(side: str, stat: str) -> Column:
        return F.max(F.when((F.col("side") == side) & (F.col("stat") == stat), F.col("value")))

    names = {"hash": "aggregate_hash", "columns": "hash_columns", "mode": "mode", "sorted": "sorted", "error": "error"}
    row = tagged.agg(
        *[(F.coalesce(pick(x, "hashed"), F.lit("false")) == "true").alias(f"hashed_{x}") for x in SIDES],
        *[pick(x, stat).alias(f"{n}_{x}") for x in SIDES for n, stat in names.items()],
    )
    both = F.col("hashed_base") & F.col("hashed_ingested")
    none = ~F.col("hashed_base") & ~F.col("hashed_ingested")
    failed = F.col("error_base").isNotNull() | F.col("error_ingested").isNotNull()
    same = F.coalesce(F.col("hash_base") == F.col("hash_ingested"), F.lit(False))
    status = (
        F.when(both & same, "PASS").when(both, "FAIL").when(failed, "ERROR").otherwise("SKIPPED")
    )
    differs = lambda x: ~F.col(f"{x}_base").eqNullSafe(F.col(f"{x}_ingested"))
    warn = F.concat_ws(
        "; ",
        F.when(both & differs("columns"), "different key columns"),
        F.when(both & differs("sorted"), "different sorting settings"),
        F.when(both & differs("mode"), "different hash modes"),
    )
    issue = (both & ~same) | (~both & failed) | (~both & ~none)
    return row.select(
        status.alias("status"),
        issue.alias("issue"),
        F.when(warn != "", warn).alias("warning"),
        "hash_base",
        "hash_ingested",
    )


def compare_reports(base: DataFrame, other: DataFrame, **stat_rules) -> DataFrame:
    """The six checks with status, whether the check counts as an issue, and
    warnings. Reports are small; each check is one aggregate over its section.
    """
    shape = compare_shapes(base, other).agg(
        F.coalesce(F.every("equal"), F.lit(False)).alias("ok"), F.count(F.lit(1)).alias("n")
    )
    cols = compare_columns(base, other).agg(
        F.coalesce(F.every(F.col("finding") == "same"), F.lit(False)).alias("ok"),
        F.coalesce(F.every(F.col("finding").isin("same", "moved")), F.lit(False)).alias("same_set"),
        F.count(F.lit(1)).alias("n"),
    )
    types = compare_types(base, other).agg(
        F.coalesce(F.every("compatible"), F.lit(False)).alias("ok"), F.count(F.lit(1)).alias("n")
    )
    stats = compare_stats(base, other, **stat_rules).agg(
        F.coalesce(F.every(F.col("outcome") != "differs"), F.lit(False)).alias("ok"),
        F.coalesce(F.some(F.col("outcome") == "ignored"), F.lit(False)).alias("ignored"),
        F.count(F.lit(1)).alias("n"),
    )
    nulls = compare_nulls(base, other).agg(
        F.coalesce(F.every("equal"), F.lit(False)).alias("ok"), F.count(F.lit(1)).alias("n")
    )
    hashes = compare_hashes(base, other)

    # The six one-row summaries are stacked and folded into one row.
    parts = {"shape": shape, "cols": cols, "types": types, "stats": stats, "nulls": nulls, "hash": hashes}
    stacked, fields = None, []
    for prefix, df in parts.items():
        one = df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])
        fields += one.columns
        stacked = one if stacked is None else stacked.unionByName(one, allowMissingColumns=True)
    row = stacked.agg(*[F.max(c).alias(c) for c in fields])

    element = F.col("shape_ok") & F.col("cols_ok")
    passed = lambda c: F.when(c, "PASS").otherwise("FAIL")

    def elementwise(p: str) -> Column:
        return (
            F.when(F.col(f"{p}_n") == 0, "FAIL").when(~element, "SKIPPED").otherwise(passed(F.col(f"{p}_ok")))
        )

    moved = F.when(~F.col("cols_ok") & F.col("cols_same_set"), "column order differs")
    stat_status = elementwise("stats")
    stat_status = F.when((stat_status == "PASS") & F.col("stats_ignored"), "PASS_WITH_WARNINGS").otherwise(stat_status)
    top_note = F.when(element & F.col("stats_ignored"), "top differs where freq is equal")
    checks = [
        ("shape_match", passed(F.col("shape_ok")), ~F.col("shape_ok"), None),
        ("column_match", passed(F.col("cols_ok")), ~F.col("cols_ok"), moved),
        ("dtype_match", elementwise("types"), elementwise("types") == "FAIL", None),
        ("stats_match", stat_status, stat_status == "FAIL", top_note),
        ("null_count_match", elementwise("nulls"), elementwise("nulls") == "FAIL", None),
        ("hash_match", F.col("hash_status"), F.col("hash_issue"), F.col("hash_warning")),
    ]
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("check"),
                status.alias("status"),
                issue.alias("issue"),
                (F.lit(None).cast("string") if warning is None else warning).alias("warning"),
            )
            for i, (name, status, issue, warning) in enumerate(checks)
        ]
    )
    return row.select(F.explode(cells).alias("x")).select("x.*")


def overall_status(checks: DataFrame) -> DataFrame:
    """FAIL on any issue, PASS_WITH_WARNINGS on warnings only, ERROR without
    checks (a report could not be read)."""
    return checks.agg(
        F.when(F.count(F.lit(1)) == 0, "ERROR")
        .when(F.some("issue"), "FAIL")
        .when(F.count("warning") > 0, "PASS_WITH_WARNINGS")
        .otherwise("PASS")
        .alias("overall_status")
    )

