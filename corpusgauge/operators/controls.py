"""Controls on the inputs of a classifier."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..session import cut_lineage
from .common import broadcast_if_small, spread
from .vectors import nearest_vectors

# Numbers a centroid table may hold to be a literal of the plan.
CENTROID_NUMBERS = 20_000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def cosine(a: Column, b: Column) -> Column:
    return ratio(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def class_centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """``(label, centroid, variance)`` of every class, both as arrays. Sums are
    formed per dimension before the shuffle."""
    parts = (
        df.filter(F.col(vector).isNotNull() & F.col(label).isNotNull())
        .select(F.col(label).cast("string").alias("label"), F.posexplode(vector).alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("m"), F.var_pop(F.col("x").cast("double")).alias("v"))
    )
    rows = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m", "v"))).alias("d"))
    return rows.select(
        "label", F.transform("d", lambda x: x["m"]).alias("centroid"), F.transform("d", lambda x: x["v"]).alias("variance")
    )


def _literal(centroids: DataFrame) -> Column | None:
    """The class centroids as one literal of every row, or ``None`` if there are more
    numbers than ``CENTROID_NUMBERS``: nothing is joined to the rows."""
    k = centroids.agg(F.sum(F.size("centroid") * 2).alias("n")).head()["n"] or 0
    if k > CENTROID_NUMBERS:
        return None
    rows = sorted(centroids.collect(), key=lambda r: r["label"])
    numbers = lambda v: F.array(*[F.lit(None if x is None else float(x)).cast("double") for x in v])
    if not rows:
        return F.array().cast("array<struct<label:string,centroid:array<double>,variance:array<double>>>")
    return F.array(
        *[F.struct(F.lit(r["label"]).alias("label"), numbers(r["centroid"]).alias("centroid"), numbers(r["variance"]).alias("variance")) for r in rows]
    )


def similarity_gate(
    df: DataFrame, vector: str, centroids: DataFrame, threshold: float, keep: Sequence[str]
) -> DataFrame:
    """Nearest class centroid by cosine and whether the input is close enough
    to be accepted. A list of centroids too long for a literal is searched as
    training vectors are, by the first of ``keep``, which identifies a row."""
    x = F.col(vector)
    listed = _literal(centroids)
    route = F.when(F.col("similarity") >= threshold, "accept").otherwise("review").alias("route")
    if listed is None:
        train = centroids.select("label", F.col("centroid").alias(vector))
        near = nearest_vectors(df.select(keep[0], vector), train, keep[0], vector, "label")
        return df.select(*keep).join(near, keep[0], "left").select(*keep, "nearest", "similarity", route)
    scored = F.transform(
        listed,
        lambda c: F.struct(cosine(x, c["centroid"]).alias("similarity"), c["label"].alias("label")),
    )
    best = F.array_max(F.filter(scored, lambda s: s["similarity"].isNotNull()))
    return (
        df.withColumn("__best", F.when(x.isNotNull(), best))
        .select(
            *keep,
            F.col("__best.label").alias("nearest"),
            F.col("__best.similarity").alias("similarity"),
        )
        .select(*keep, "nearest", "similarity", route)
    )


def distance_gate(
    df: DataFrame,
    vector: str,
    centroids: DataFrame,
    threshold: float,
    keep: Sequence[str],
    epsilon: float = 1e-9,
) -> DataFrame:
    """Same with the diagonal Mahalanobis distance: each dimension is measured
    in standard deviations of the class."""
    x = F.col(vector)

    def distance(c: Column) -> Column:
        pairs = F.zip_with(c["centroid"], c["variance"], lambda m, v: F.struct(m.alias("m"), v.alias("v")))
        parts = F.zip_with(
            x, pairs, lambda a, p: (a.cast("double") - p["m"]) * (a.cast("double") - p["m"]) / (p["v"] + epsilon)
        )
        return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v))

    listed = _literal(centroids)
    if listed is None:
        raise ValueError("too many centroids for a class list")
    scored = F.transform(
        listed, lambda c: F.struct(distance(c).alias("distance"), c["label"].alias("label"))
    )
    best = F.array_min(scored)
    return (
        df.withColumn("__best", F.when(x.isNotNull(), best))
        .select(
            *keep,
            F.col("__best.label").alias("nearest"),
            F.col("__best.distance").alias("distance"),
            F.when(F.col("__best.distance") <= threshold, "accept").otherwise("review").alias("route"),
        )
    )


def definition_text(classes: DataFrame, name: str, definition: str, heading: str = "Classes and what they mean:") -> DataFrame:
    """Class definitions as one text block, in class order. The class list is
    the bound on what is collected."""
    rows = classes.select(F.struct(F.col(name).alias("name"), F.col(definition).alias("definition")).alias("x"))
    one = rows.agg(F.array_sort(F.collect_list("x")).alias("xs"))
    lines = F.transform(
        "xs", lambda x: F.concat(F.lit("- **"), x["name"], F.lit("**: "), x["definition"], F.lit("\n"))
    )
    return one.select(
        F.concat(F.lit(heading + "\n"), F.array_join(lines, "")).alias("definitions")
    )


def near_copies(df: DataFrame, key: str, text: str, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Near copies to remove: ``(key, kept, jaccard)`` for every text whose word shingles
    overlap those of a text of smaller key by ``least`` or more; ``kept`` is the smallest
    such key.

    An exact set-similarity join. A text's shingles are numbers, hashed in its row and
    put into one order for all texts, rare ones first by a table of counts of bounded
    size; only the first ``n - ceil(least * n) + 1`` of them travel: two sets that overlap
    enough have one in common there, whatever the order. A common number admits a pair only if the
    sizes allow the overlap and if what follows it on both sides still can reach it; the
    full sets of the pairs left are then intersected. Equal sets are one text, the one of
    smallest key, before the join. Texts of fewer words than a shingle have none and no
    copies; NULL texts likewise.
    """
    words = F.filter(F.split(F.lower(F.col(f"`{text}`")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    grams = F.expr(
        f"if(size(w) >= {shingle}, transform(sequence(1, size(w) - {shingle - 1}), i -> xxhash64(slice(w, i, {shingle}))), array())"
    )
    texts = spread(df.select(F.col(f"`{key}`").alias("id"), f"`{text}`"))
    sets = texts.select("id", words.alias("w")).select("id", F.array_sort(F.array_distinct(grams)).alias("h"))
    # filtered once stored: a filter on the shingles would sink to the split of the words,
    # which would then be split anew for every shingle
    sets = cut_lineage(sets.select("id", "h")).filter("size(h) > 0")
    sets = sets.select("id", F.size("h").alias("n"), F.xxhash64("h").alias("x"), F.hash("h").alias("y"), "h")
    # the sets stay where they are: copies are found by digest, prefixes alone are held
    # against them
    same = sets.groupBy(*DIGEST).agg(F.min("id").alias("rep"))
    at = cut_lineage(sets.select("id", *DIGEST).join(same, DIGEST))
    copies = at.filter("id <> rep").select("id", *DIGEST).distinct()
    first = _prefixes(sets, least).join(copies, ["id", *DIGEST], "left_anti")
    first = first.select("id", "n", F.posexplode("g").alias("p", "g"))
    a, b = first.toDF("id", "n", "p", "g"), first.toDF("kept", "m", "q", "g")
    overlap = f"cast(ceil({least}d / (1 + {least}d) * (n + m) - 1e-9) as int)"
    fits = f"kept < id and n >= {least}d * m - 1e-9 and m >= {least}d * n - 1e-9 and 1 + least(n - p - 1, m - q - 1) >= {overlap}"
    pairs = cut_lineage(a.join(b, "g").filter(fits).select("id", "kept").distinct())
    # only sets of a pair travel to be intersected
    paired = _among(sets, pairs.select("id").union(pairs.select("kept"))).join(copies, ["id", *DIGEST], "left_anti")
    paired = paired.select("id", "n", "h")
    both = pairs.join(paired, "id").join(paired.toDF("kept", "m", "k"), "kept")
    common = both.withColumn("c", F.size(F.array_intersect("h", "k"))).select(
        "id", "kept", ratio(F.col("c"), F.col("n") + F.col("m") - F.col("c")).alias("jaccard")
    )
    best = common.filter(F.col("jaccard") >= least).groupBy("id").agg(F.min(F.struct("kept", "jaccard")).alias("b"))
    best = best.select(F.col("id").alias("rep"), "b.kept", "b.jaccard")
    # a copy has the partners of the text it copies, and that text
    out = at.select("id", "rep").join(best, "rep", "left").filter("kept is not null or id <> rep")
    return out.select(F.col("id").alias(key), F.coalesce("kept", "rep").alias("kept"), F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"))


#: Cells of the table of shingle counts: it is as large for any number of texts.
SHINGLE_CELLS = 1 << 18


#: Bits of the table of ids: as large for any number of them.
ID_BITS = 1 << 24
#: Equal sets are told by size and two hashes.
DIGEST = ["n", "x", "y"]


def _among(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``sets`` whose id is among ``ids``, and a few more: a bit is set for the
    hash of every id, so that a join that follows moves little of the rest."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS))
    words = ids.select(bit("id").alias("b")).groupBy(F.shiftright("b", 5).alias("i")).agg(F.expr("bit_or(shiftleft(1L, int(b & 31)))").alias("v")).toPandas()
    table = np.zeros(ID_BITS >> 5, dtype=np.int64)
    table[words["i"].to_numpy(dtype=np.int64)] = words["v"].to_numpy(dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy()
            there = table[at >> 5] >> (at & 31) & 1 == 1
            yield pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(there))

    return sets.withColumn("__bit", bit("id")).mapInArrow(run, sets.schema)


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(id, n, x, y, g): the leading shingles of every set (id, n, x, y, h), in the order
    of their cell's count, then of their number."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SHINGLE_CELLS, dtype=np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy() % SHINGLE_CELLS, minlength=SHINGLE_CELLS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    sums = sets.select("h").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(SHINGLE_CELLS, dtype=np.int64)
    table[sums["cell"].to_numpy()] = sums["n"].to_numpy()

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, ends = [np.zeros(0, dtype=np.int64)], [0]
            for h in b.column(4):
                h = h.values.to_numpy()
                k = len(h) - math.ceil(least * len(h) - 1e-9) + 1
                grams.append(h[np.lexsort((h, table[h % SHINGLE_CELLS]))[:k]])
                ends.append(ends[-1] + len(grams[-1]))
            g = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], g], ["id", *DIGEST, "g"])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", *DIGEST, "h").mapInArrow(leading, f"id {kind}, n int, x long, y int, g array<long>")


def deletions(c: Column, edits: int) -> Column:
    """Hashes of a string and of all strings that up to ``edits`` deletions make of it."""
    every = last = F.array(c)
    for _ in range(edits):
        cut = F.flatten(
            F.transform(
                last,
                lambda s: F.when(
                    F.char_length(s) > 0,
                    F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(s), F.lit(1))), lambda i: F.overlay(s, F.lit(""), i, F.lit(1))),
                ).otherwise(F.array().cast("array<string>")),
            )
        )
        last = F.array_distinct(cut)
        every = F.concat(every, last)
    return F.transform(F.array_distinct(every), lambda s: F.xxhash64(s))


def closest_labels(df: DataFrame, text: str, labels: DataFrame, label: str, edits: int = 2) -> DataFrame:
    """``df`` with ``label`` and ``distance``: the label of least edit distance, whatever
    the case, among those at most ``edits`` away (the first by name on a tie), else NULL.

    Strings so near share one of the strings that deletions make of both, so distinct
    texts and labels are filed under the hashes of those, and only what meets there is
    measured: the work grows with the near pairs, not with rows times labels. Every
    distinct text is looked up once and its rows get the answer.
    """
    side = lambda d, c, to: d.select(F.col(c).alias(to)).filter(F.col(to).isNotNull()).distinct()
    asked = side(df, text, "a").select("a", F.explode(deletions(F.lower("a"), edits)).alias("h"))
    filed = side(labels, label, "l").select("l", F.explode(deletions(F.lower("l"), edits)).alias("h"))
    pairs = asked.join(filed, "h").select("a", "l").distinct()
    near = pairs.withColumn("distance", F.levenshtein(F.lower("a"), F.lower("l"), edits)).filter("distance >= 0")
    best = near.groupBy("a").agg(F.min(F.struct("distance", "l")).alias("x")).select("a", F.col("x.l").alias("label"), "x.distance")
    found = broadcast_if_small(best)
    return df.join(found, F.col(f"`{text}`") == F.col("a"), "left").drop("a")
