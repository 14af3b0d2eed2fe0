"""Mixing sources to target weights, by blocks of tokens.

The words of a source form one stream in a fixed order of its documents, packed
into blocks of one length per source. Every source gets a number of block slots
that follows its target; the slots are dealt to output shards at random, which
makes each shard's source counts multinomial given the totals. A slot names a
block through a pseudorandom permutation of the source's block indexes (one per
epoch, so no block is used more often than the cap), and blocks join documents by
index. DataFrame functions only; the random bits are whole-number arithmetic, so
reruns agree and SQL can repeat them.

No step gathers a source: streams are summed in buckets, permutations are
computed per index, and a document generates the indexes of the blocks that begin
in it. What reaches the driver are sums over sources and, per range partition of
the source names, one count.

Defined results: a NULL text has no words and a size of 0; NULL is a source, the
last one; repeated rows are documents of their own; an empty table mixes to an
empty one. Further columns of the input are kept by :func:`mix_documents` unless
their name is one that the result defines.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import settled, stored, word_array

BUCKET_ROWS = 8192


@dataclass(frozen=True)
class Mixture:
    weights: Sequence[int] = (5, 2, 1)
    share: float = 1.5
    cap: int = 2
    block_tokens: int = 64
    # a source of fewer blocks gets shorter ones, so that rounding stays small
    least_blocks: int = 256
    shard_slots: int = 4096
    seed: int = 17


def _digest_sql(*parts: str) -> str:
    """Eight hexadecimal digits of mixed bits, as a number, in Spark and DuckDB alike."""
    return "md5(concat_ws(':', " + ", ".join(f"cast({p} as string)" for p in parts) + "))"


def permute(df: DataFrame, column: str, size: str, salt: str, seed: int, to: str) -> DataFrame:
    """``to``: the image of ``column`` (0 <= x < ``size``, every x once per source and
    ``salt``) under a pseudorandom permutation, its rank by digest. All orders are as
    likely as digests are random. Digests are cut into ranges of about ``BUCKET_ROWS``,
    ranked apart and shifted by the ranges before them, so no window holds a source."""
    digest = F.expr(_digest_sql(str(seed), "source_no", salt, column))
    ranges = F.expr(f"bigint({size}) div {BUCKET_ROWS} + 1")
    # the digits of a digest, as a share of all digests, give its range
    at = df.withColumn("__h", digest).withColumn(
        "__range", F.shiftright(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") * ranges, 32)
    )
    counts = at.groupBy("source_no", salt, "__range").agg(F.count("*").alias("__n"))
    before = W.partitionBy("source_no", salt).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("source_no", salt, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy("source_no", salt, "__range").orderBy("__h", column)
    ranked = at.withColumn("__row", F.row_number().over(inside) - 1).join(counts, ["source_no", salt, "__range"])
    return ranked.withColumn(to, F.col("__before") + F.col("__row")).drop("__h", "__range", "__row", "__before")


def document_sizes(docs: DataFrame, text: str, source: str) -> DataFrame:
    """One narrow row per document: the only pass over the texts."""
    return docs.select(
        "*", F.size(word_array(F.col(f"`{text}`"))).cast("long").alias("size")
    ).select(*[c for c in docs.columns if c not in (text, source, "size")], F.col(f"`{source}`").alias("source"), "size")


def number_sources(sources: DataFrame) -> DataFrame:
    """Sources numbered from 0 in code point order, NULL last. Ranges of names are
    sorted apart and shifted by the rows before them."""
    ordered = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(
        F.col("source").asc_nulls_last()
    )
    at = stored(ordered.withColumn("__id", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright(F.col("__id"), 33)
    # one row per range partition
    before = at.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = before.withColumn(
        "__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("__n")
    numbered = at.withColumn("__part", part).join(F.broadcast(before), "__part")
    row = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("source_no", F.col("__before") + row).drop("__part", "__before", "__id")


def source_plan(sizes: DataFrame, how: Mixture) -> DataFrame:
    """Per source: number, size, weight, target, block length, blocks and slots.

    Targets are weight times a common level, stopped at ``cap`` times the size; the
    level rises until the targets sum to the share, a sum per round."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = number_sources(totals)
    weight = F.element_at(
        F.array(*[F.lit(int(w)) for w in how.weights]), (F.col("source_no") % len(how.weights) + 1).cast("int")
    )
    plan = stored(plan.withColumn("weight", weight), "mix-plan")
    most = F.col("source_size") * how.cap
    level, total = -1.0, None
    while True:
        full = F.lit(False) if total is None else F.col("weight") * F.lit(level) >= most
        at = plan.agg(
            F.sum("source_size").alias("n"),
            F.sum(F.when(full, most)).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("weights"),
        ).first()
        total = at["n"] or 0
        if not at["weights"]:
            break
        new = (how.share * total - (at["full"] or 0)) / at["weights"]
        if new <= level:
            break
        level = new
    target = F.least(F.col("weight") * F.lit(float(level)), most.cast("double"))
    plan = plan.withColumn("target", F.when(most == 0, F.lit(0.0)).otherwise(target))
    plan = plan.withColumn(
        "block_len", F.expr(f"greatest(1L, least({how.block_tokens}L, source_size div {how.least_blocks}))")
    )
    plan = plan.withColumn("n_blocks", F.expr("(source_size + block_len - 1) div block_len"))
    plan = plan.withColumn("epochs", F.expr("if(source_size = 0, 0L, bigint(floor(target / source_size)))"))
    return plan.withColumn(
        "extra", F.expr("least(n_blocks, bigint(floor((target - epochs * source_size) / block_len + 0.5)))")
    )


def streams(sizes: DataFrame, key: str, row: str) -> DataFrame:
    """``start``: words of the source before the document. Documents are dealt to
    buckets by a digest of the key; running sums inside a bucket are shifted by the
    buckets before it, so no window holds a source."""
    n = sizes.count() // BUCKET_ROWS + 1
    bucket = F.expr(f"bigint(conv(substr(md5(coalesce(string(`{key}`), '')), 1, 8), 16, 10)) % {n}")
    at = sizes.withColumn("__bucket", bucket)
    sums = at.groupBy("source_no", "__bucket").agg(F.sum("size").alias("__sum"))
    across = W.partitionBy("source_no").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source_no", "__bucket", F.coalesce(F.sum("__sum").over(across), F.lit(0)).alias("__shift"))
    inside = W.partitionBy("source_no", "__bucket").orderBy(key, "size", row).rowsBetween(W.unboundedPreceding, -1)
    at = at.withColumn("__run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = at.join(sums, ["source_no", "__bucket"])
    return at.withColumn("start", F.col("__shift") + F.col("__run")).drop("__bucket", "__shift", "__run")


@dataclass
class Mixed:
    """``documents``: one row per input row with size, source_size, target and
    taken; ``slots``: output shard, source, epoch, slot and the block it names;
    ``plan``: one row per source."""

    documents: DataFrame
    slots: DataFrame
    plan: DataFrame

    def shard_counts(self) -> DataFrame:
        """The multinomial source counts of every output shard."""
        return self.slots.groupBy("shard", "source_no").agg(F.count("*").alias("slots"))


def mix(
    docs: DataFrame, how: Mixture | None = None, key: str = "doc_id", text: str = "text", source: str = "source"
) -> Mixed:
    how = how or Mixture()
    narrow = document_sizes(docs.select(key, text, source), text, source)
    sizes = stored(narrow.withColumn("__row", F.monotonically_increasing_id()), "mix-sizes")
    plan = stored(source_plan(sizes, how), "mix-targets")
    # hot sources are split by the adaptive skew join; one row per source on the right
    named = sizes.withColumn("__name", F.struct("source")).join(
        plan.withColumn("__name", F.struct("source")).drop("source"), "__name"
    ).drop("__name")
    at = stored(streams(named, key, "__row"), "mix-streams")

    first = F.expr("(start + block_len - 1) div block_len")
    last = F.expr("(start + size - 1) div block_len")
    begun = at.filter("size > 0").select(
        "source_no", "n_blocks", "epochs", "extra",
        F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("block"),
    )
    begun = begun.select("*", F.explode(F.sequence(F.lit(0), F.lit(how.cap - 1))).alias("epoch"))
    begun = begun.filter("epoch < epochs or (epoch = epochs and extra > 0)")
    slots = permute(begun, "block", "n_blocks", "epoch", how.seed, "slot").filter("epoch < epochs or slot < extra")
    n_shards = plan.agg(F.sum(F.expr("epochs * n_blocks + extra"))).first()[0] or 0
    n_shards = n_shards // how.shard_slots + 1
    # every slot falls on a shard by its own mixed bits: a shard's source counts are
    # multinomial, given the totals
    bits = F.expr(_digest_sql(str(how.seed + 1), "source_no", "epoch", "slot"))
    draw = F.shiftright(F.conv(F.substring(bits, 1, 8), 16, 10).cast("long") * n_shards, 32)
    # stored: the plan of the mix is a result
    slots = stored(slots.select(draw.alias("shard"), "source_no", "epoch", "slot", "block"), "mix-slots")

    uses = slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
    begin, end = F.expr("start div block_len"), F.expr("(start + greatest(size, 1L) - 1) div block_len")
    parts = at.select(
        key, "__row", "source", "source_no", "size", "source_size", "target", "start", "block_len",
        F.explode(F.sequence(begin, end)).alias("block"),
    )
    overlap = F.expr(
        "greatest(0L, least(start + size, (block + 1) * block_len) - greatest(start, block * block_len))"
    )
    taken = (
        parts.withColumn("__overlap", overlap)
        .join(uses, ["source_no", "block"], "left")
        .groupBy(key, "__row", "source", "size", "source_size", "target")
        .agg(F.sum(F.coalesce(F.col("uses"), F.lit(0)) * F.col("__overlap")).alias("taken"))
    )
    return Mixed(taken.drop("__row"), slots, plan)


def mix_documents(docs: DataFrame, how: Mixture | None = None, key: str = "doc_id") -> DataFrame:
    """The documents with ``taken``, the words that the mix takes from each (repeats
    counted), and their source's target."""
    new = ("size", "source_size", "target", "taken")

    def build() -> DataFrame:
        # rows of one key are one document here
        per_key = mix(docs, how, key).documents.groupBy(F.col(key).alias("__key"))
        return per_key.agg(
            F.sum("size").alias("size"), F.max("source_size").alias("source_size"),
            F.max("target").alias("target"), F.sum("taken").alias("taken"),
        )

    taken = settled(docs.sparkSession, build, "mix-taken")
    kept = docs.drop(*new)
    return kept.join(taken, kept[f"`{key}`"].eqNullSafe(F.col("__key"))).drop("__key")


def mix_sql(how: Mixture | None = None) -> str:
    """The same mix in SQL."""
    how = how or Mixture()
    weights = ", ".join(str(int(w)) for w in how.weights)
    digest = _digest_sql(str(how.seed), "source_no", "epoch", "block").replace("as string", "as varchar")
    return f"""
    with sz as (
      select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::bigint as size
      from documents),
    src as (
      select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as source_no
      from sz group by source),
    wt as (select *, [{weights}][(source_no % {len(how.weights)} + 1)::integer] as weight from src),
    fill as (
      select *, {how.share} * sum(source_size) over () as whole,
             coalesce(sum({how.cap} * source_size) over (order by source_size::double / weight, source_no rows between unbounded preceding and 1 preceding), 0) as below,
             sum(weight) over (order by source_size::double / weight, source_no rows between current row and unbounded following) as above
      from wt),
    lev as (select max((whole - below) / above) as level from fill),
    tg as (
      select source, source_no, source_size, least(weight * level, ({how.cap} * source_size)::double)::double as target,
             greatest(1, least({how.block_tokens}, source_size // {how.least_blocks})) as block_len
      from fill, lev),
    pl as (
      select *, (source_size + block_len - 1) // block_len as n_blocks,
             case when source_size = 0 then 0 else floor(target / source_size)::bigint end as epochs from tg),
    pln as (select *, least(n_blocks, floor((target - epochs * source_size) / block_len + 0.5)::bigint) as extra from pl),
    bk as (
      select doc_id, source, size, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % (select count(*) // {BUCKET_ROWS} + 1 from sz) as b
      from sz),
    st as (
      select *, coalesce(sum(size) over (partition by source order by b, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from bk),
    sl as (
      select source_no, epochs, extra, epoch, block, row_number() over (partition by source_no, epoch order by {digest}, block) - 1 as slot
      from (select *, unnest(range(n_blocks)) as block from pln), (select unnest(range({how.cap})) as epoch)),
    us as (select source_no, block, count(*) as uses from sl where epoch < epochs or (epoch = epochs and slot < extra) group by all),
    pt as (
      select st.*, source_no, source_size, target, block_len,
             unnest(range(start // block_len, (start + greatest(size, 1) - 1) // block_len + 1)) as block
      from st join pln on st.source is not distinct from pln.source)
    select doc_id, size, source_size, target,
           sum(coalesce(uses, 0) * greatest(0, least(start + size, (block + 1) * block_len) - greatest(start, block * block_len)))::bigint as taken
    from pt left join us using (source_no, block)
    group by doc_id, size, source_size, target, start"""
