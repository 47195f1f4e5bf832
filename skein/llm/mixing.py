"""Mixing sources to target weights by Sainte-Lague apportionment.  DataFrame functions only.

The budget is the size of the corpus in words.  Sources share it by weight; no target passes
max_repeats times its source, and what is left over is shared again by weight.  The budget is cut into
equal blocks, small beside the smallest target, and the blocks go to the sources by the highest quotients
target / (2 * seats + 1).  As
that method is house-monotone, the seats of the first h shards' blocks taken from those of the first
h + 1 give each mix shard its own integer quota of every source.  A source's documents lie on a line in
seeded order; its blocks are cut along that line and taken in that order, from the start again when a
source is repeated, so a document's share of the blocks is an interval overlap.

Quotients are not listed one by one: an apportionment differs from the proportional share by a bounded
number of seats, so only the few around it are ranked, about three a source.  Line positions are prefix
sums over small hash ranges of a source plus the sums of the ranges before them, so that a source with a
third of all rows is spread over as many tasks as any other rows.

Edge cases: a null text has size 0; the null source is a source of its own, last; an empty corpus gives
no rows; if no document has a word all targets and takes are 0; documents of size 0 take 0; rows that
repeat take their own places on the line; other columns of the input may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import WORD, packed, spill, text_key, unpacked

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Blocks of the source with the smallest target: its take is right to about half a block.
BLOCKS_PER_SOURCE = 1000
#: Rows of a hash range of a source, about.
RANGE_ROWS = 2000
MIX_SHARDS = 8
SEED = 20240601


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, place, weight, target; a row a source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("place", place).withColumn("weight", weight).withColumn("most", max_repeats * F.col("source_size"))
    # by the level at which a source is full; it is capped if the level that those before it leave reaches that
    filled = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before, whole = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("level", level).withColumn("capped", F.col("most") <= F.col("level") * F.col("weight"))
    last = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)  # of the first that is not; after it levels fall
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(last * F.col("weight"))
    return ranked.select("source", "source_size", "place", "weight", target.alias("target"))


def quotas(shares: DataFrame, shards: int = MIX_SHARDS, blocks_per_source: int = BLOCKS_PER_SOURCE) -> DataFrame:
    """targets() -> place, shard, block (words a block), blocks: each mix shard's integer quota of each source."""
    whole = Window.partitionBy()
    total, n = F.sum("source_size").over(whole), F.count("*").over(whole)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole)  # so that no source is too small for the blocks
    block = F.greatest(F.lit(1), F.floor(F.least(total / n, least) / blocks_per_source)).cast("long")
    house = shares.where("source_size > 0").select("place", "target", n.alias("n"), total.alias("total"), block.alias("block"))
    house = house.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    seats = F.floor(F.col("total") / F.col("block"))
    house = house.withColumn("house", F.floor((F.col("shard") + 1) * seats / shards).cast("long")).where("house > 0")
    share = F.col("house") * F.col("target") / F.col("total")
    slack = F.col("n") / (2 * F.col("house"))
    house = house.withColumn("low", F.greatest(F.lit(0), F.floor(share * (1 - slack) - 0.5)).cast("long")).withColumn("high", F.ceil(share * (1 + slack) + 0.5).cast("long"))
    seat = house.withColumn("seat", F.explode(F.sequence(F.col("low"), F.greatest("low", "high"))))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("seat") + 1)).desc(), "place", "seat"))
    sure = house.groupBy("shard").agg(F.sum("low").alias("sure"))
    won = seat.withColumn("rank", rank).join(sure, "shard").where(F.col("rank") <= F.col("house") - F.col("sure")).groupBy("shard", "place").agg(F.count("*").alias("won"))
    held = house.select("shard", "place", "block", "low").join(won, ["shard", "place"], "left").withColumn("held", F.col("low") + F.coalesce("won", F.lit(0)))
    earlier = F.coalesce(F.lag("held").over(Window.partitionBy("place").orderBy("shard")), F.lit(0))
    return held.select("place", "shard", "block", (F.col("held") - earlier).alias("blocks"))


def mix(sized: DataFrame, source_col: str, size_col: str, seed_cols: list[str], sources: DataFrame, plan: DataFrame, n_rows: int, seed: int = SEED, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sized with __source_size, __target, __taken and __mix_shard (of the first word taken).

    sources is what targets() gives, plan what quotas() gives; both have a few rows a source.
    """
    bits = max(0, math.ceil(math.log2(max(1, n_rows / RANGE_ROWS))))
    by = plan.groupBy("place").agg((F.sum("blocks") * F.max("block")).alias("words"), F.sort_array(F.collect_list(F.struct("shard", (F.col("blocks") * F.col("block")).alias("words")))).alias("parts"))
    ends = F.expr("transform(parts, (p, i) -> aggregate(slice(parts, 1, i + 1), 0L, (a, q) -> a + q.words))")
    facts = sources.join(by, "place", "left").select(
        F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.coalesce(F.least("words", max_repeats * F.col("source_size")), F.lit(0)).alias("__quota"), F.coalesce(ends, F.array().cast("array<bigint>")).alias("__ends")
    )
    h = F.xxhash64(F.lit(seed), F.col(source_col), *[F.col(c) for c in seed_cols])
    line = sized.withColumn("__h", h).withColumn("__range", F.shiftrightunsigned("__h", 64 - bits) if bits else F.lit(0).cast("long"))
    ranges = line.groupBy(F.col(source_col).alias("__source"), F.col("__range")).agg(F.sum(size_col).alias("__words"))
    before = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("__start", F.coalesce(F.sum("__words").over(before), F.lit(0))).drop("__words")
    starts = starts.join(facts, starts["__source"].eqNullSafe(facts["__source"])).drop(facts["__source"]).withColumnRenamed("__range", "__r")
    within = Window.partitionBy(source_col, "__range").orderBy("__h", *seed_cols).rowsBetween(Window.unboundedPreceding, -1)
    placed = line.withColumn("__within", F.coalesce(F.sum(size_col).over(within), F.lit(0)))
    placed = placed.join(starts, F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__range") == F.col("__r")))
    at = F.col("__start") + F.col("__within")
    passes = F.when(F.col("__source_size") > 0, F.floor(F.col("__quota") / F.col("__source_size"))).otherwise(0).cast("long")
    rest = F.col("__quota") - passes * F.col("__source_size")
    part = F.greatest(F.lit(0), F.least(at + F.col(size_col), rest) - at)
    placed = placed.withColumn("__at", at).withColumn("__taken", (passes * F.col(size_col) + part).cast("long"))
    placed = placed.withColumn("__mix_shard", F.when(F.col("__taken") > 0, F.expr("size(filter(__ends, e -> e <= __at))").cast("int")))
    return placed.drop("__h", "__range", "__r", "__within", "__start", "__source", "__quota", "__ends", "__at")


def _plan(sized: DataFrame, source_col: str, size_col: str) -> tuple[DataFrame, DataFrame, int]:
    sizes = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"), F.count("*").alias("n"))
    sizes = spill(sizes, "sources")
    shares = spill(targets(sizes.drop("n")), "targets")
    return shares, spill(quotas(shares), "quotas"), sizes.agg(F.sum("n")).first()[0] or 0


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, mix_shard."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), text_key(F.col(text_col)).alias("tkey"))
    sized = spill(sized, "sized")
    shares, plan, n = _plan(sized, "source", "size")
    return mix(sized, "source", "size", ["doc_id", "tkey"], shares, plan, n).select("doc_id", "size", *[F.col(f"__{c}").alias(c) for c in ("source_size", "target", "taken", "mix_shard")])


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: docs' columns, each document once for every pass that takes any of its words.

    A document of which nothing is taken is not in the mix.  The text moves once, with its row.
    """
    sized = packed(docs, source=F.col(source_col), id=F.col(id_col), size=n_words(F.col(text_col)), tkey=text_key(F.col(text_col)))
    shares, plan, n = _plan(sized, "source", "size")
    out = mix(sized, "source", "size", ["id", "tkey"], shares, plan, n)
    copies = F.ceil(F.col("__taken") / F.col("size")).cast("int")
    return unpacked(out.where("__taken > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))))
