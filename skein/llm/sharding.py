"""Sharding by balanced label propagation.

Documents with equal texts are linked.  Every document starts on a shard drawn from its own hash.  In
each round a join tells a document which shard most of its neighbours hold; the wishes are summed into a
shards x shards table of flows, the flows are cut to what each shard can take in (its quota, as documents
without links can go anywhere), and the documents that a hash draws move.  Rounds end when nobody wishes to move, or after max_rounds.  Last, shards above
their row quota release documents to those below it: documents without links first, then whole groups in
order, so that few links are cut.  Counts then differ by one at most: the law is `rows`.

A group that is larger than a quota has to be cut; it is dealt into as few parts as hold it beforehand.  No
two groups or parts of more than half a quota fit on one shard, so each of them starts whole on a shard of
its own, as long as there are shards, and is the last to release documents.  There are fewer than
2 * shards of them, apart from what dealing by hash makes uneven.  Joins by part are salted, so that
no key holds more than about SALT_ROWS rows.  Ranks (which documents
leave, and slots) are counted in small hash ranges of a shard plus the counts of the ranges before.
What the driver sees is the table of flows, shards x shards numbers at any input size.

Edge cases: null texts have size 16, checksum 0 and no links; empty texts are equal texts; rows that
repeat are rows of their own, linked as equal texts; an empty table gives no rows; other columns of the
input stay out of the result unless named in keep.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import spill, text_key, utf8

SHARDS = 40
MAX_ROUNDS = 8
#: While moving, shards may pass their quota by this share; the last step takes it back.
SLACK = 0.03
RANGE_ROWS = 2000
#: Rows of a part that meet in one key, about.
SALT_ROWS = 500


def _intake(flows: dict[tuple[int, int], int], held: list[int], room: float) -> list[float]:
    """The share of wishes that each shard can grant if the others do as well."""
    k = len(held)
    rates = [1.0] * k
    for _ in range(50):
        leaves, comes = [0.0] * k, [0.0] * k
        for (i, j), m in flows.items():
            leaves[i] += m * rates[j]
            comes[j] += m
        after = [min(rates[j], max(0.0, room - held[j] + leaves[j]) / comes[j]) if comes[j] else 1.0 for j in range(k)]
        if max(abs(a - b) for a, b in zip(after, rates, strict=True)) < 1e-4:
            break
        rates = after
    return rates


def _by_shard(values: list, shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), shard.cast("int") + 1)


def _ranked(rows: DataFrame, shard: str, span: Column, order: list[str]) -> DataFrame:
    """rows with `rank` within their shard, by span and then order."""
    rows = rows.withColumn("__span", span)
    spans = rows.groupBy(F.col(shard).alias("__shard"), F.col("__span").alias("__of")).agg(F.count("*").alias("__m"))
    before = Window.partitionBy("__shard").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select("__shard", "__of", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"))
    within = rows.withColumn("__within", F.row_number().over(Window.partitionBy(shard, "__span").orderBy(*order)) - 1)
    out = within.join(starts, (F.col(shard) == F.col("__shard")) & (F.col("__span") == F.col("__of")))
    return out.withColumn("rank", (F.col("__start") + F.col("__within")).cast("long")).drop("__span", "__shard", "__of", "__start", "__within")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, max_rounds: int = MAX_ROUNDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows, then keep."""
    text = F.col(text_col)
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(utf8(text)).alias("text_crc32"),
        F.when(text.isNotNull(), F.unhex(F.md5(utf8(text)))).alias("g"), F.xxhash64(F.lit("shard"), F.col(id_col), text_key(text)).alias("h"), *kept,
    )
    rows = spill(rows.withColumn("label", F.pmod("h", F.lit(shards)).cast("int")), "rows")
    groups = spill(rows.where("g is not null").groupBy("g").agg(F.count("*").alias("m")).where("m > 1"), "groups")
    n = rows.count()
    if n == 0:
        return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("label").alias("shard"), F.col("h").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("h").alias("group_rows"), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])
    quota = n / shards
    marked = rows.join(groups, "g", "left")
    parts = F.ceil(F.col("m") / math.ceil(quota))
    marked = marked.withColumn("part", F.when(F.col("m").isNotNull(), F.struct("g", F.pmod(F.xxhash64("h"), parts).alias("i"))))
    marked = marked.withColumn("salts", F.coalesce(F.ceil(F.col("m") / parts / SALT_ROWS), F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("h", F.lit("salt")), F.col("salts")))
    rows = spill(marked.drop("g"), "rows")

    # parts that cannot share a shard start whole
    wide = [(bytes(r.part.g), r.part.i, r.m) for r in rows.where("part is not null").groupBy("part").agg(F.count("*").alias("m")).where(F.col("m") > max(1.0, quota / 2)).collect()]
    wide = sorted(wide, key=lambda p: (-p[2], p[0], p[1]))[:shards]
    seats = docs.sparkSession.createDataFrame([(g, i, k) for k, (g, i, _) in enumerate(wide)], "seat_g binary, seat_i long, seat int")
    rows = rows.join(F.broadcast(seats), (F.col("part.g") == F.col("seat_g")) & (F.col("part.i") == F.col("seat_i")), "left").drop("seat_g", "seat_i")
    rows = rows.withColumn("label", F.coalesce("seat", "label"))

    singles, linked = rows.where("part is null"), rows.where("part is not null")
    for turn in range(max_rounds):
        votes = linked.groupBy("part", "label").agg(F.count("*").alias("m"), F.max("salts").alias("salts"))
        wish = votes.groupBy("part").agg(F.max(F.struct("m", F.xxhash64("part", "label").alias("tie"), "label")).getField("label").alias("wish"), F.max("salts").alias("salts"))
        wish = wish.select("part", "wish", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        wishes = spill(linked.join(wish, ["part", "salt"]), "wishes")
        flows = {(r.label, r.wish): r["count"] for r in wishes.where("label != wish").groupBy("label", "wish").count().collect()}
        if not flows:
            break
        held = [0] * shards
        for r in wishes.groupBy("label").count().collect():
            held[r.label] = r["count"]
        rates = _intake(flows, held, quota * (1 + SLACK) + 1)
        draw = F.pmod(F.xxhash64("h", F.lit(turn)), F.lit(1 << 20)) / (1 << 20)
        moved = F.when(draw < _by_shard(rates, F.col("wish")), F.col("wish")).otherwise(F.col("label"))
        linked = wishes.withColumn("label", moved).drop("wish")

    # exact quotas: who is above releases, who is below takes, in order
    rows = spill(singles.unionByName(linked.select(*singles.columns)), "propagated")
    held = [0] * shards
    for r in rows.groupBy("label").count().collect():
        held[r.label] = r["count"]
    fullest = sorted(range(shards), key=lambda i: (-held[i], i))
    goal = [n // shards] * shards
    for i in fullest[: n % shards]:
        goal[i] += 1
    excess = [max(0, h - g) for h, g in zip(held, goal, strict=True)]
    lack = [max(0, g - h) for h, g in zip(held, goal, strict=True)]
    spans = 1 << max(0, math.ceil(math.log2(max(1, n / RANGE_ROWS / shards))))
    hashed = F.when(F.col("part").isNull(), F.pmod(F.xxhash64("h"), F.lit(spans))).when(F.col("seat").isNotNull(), F.lit(2 * spans)).otherwise(spans + F.pmod(F.xxhash64("part"), F.lit(spans)))
    own = F.when(F.col("salts") > 1, F.xxhash64("part")).otherwise(F.lit(0))  # a salted part's ranges lie together
    hashed = F.struct(hashed.alias("a"), own.alias("b"), F.col("salt").alias("c"))
    ranked = _ranked(rows, "label", hashed, ["part", "h", "doc_id"])
    first = [sum(excess[:i]) for i in range(shards)]
    ends = [sum(lack[: i + 1]) for i in range(shards)]
    place = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= _by_shard(first, F.col("label")) + F.col("rank")))
    shard = F.when(F.col("rank") < _by_shard(excess, F.col("label")), place).otherwise(F.col("label")).cast("int")
    final = spill(ranked.withColumn("shard", shard).drop("rank"), "placed")
    slots = _ranked(final, "shard", F.pmod(F.xxhash64("h"), F.lit(spans)), ["h", "doc_id"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.coalesce("m", F.lit(1)).cast("long").alias("group_rows"), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)]
    )
