"""Near duplicates by HyperMinHash.

A document's set is its distinct k-word shingles (ASCII lower case; words are runs of anything but
ASCII blanks).  Every shingle is hashed once to 64 bits: the top 7 bits choose one of 128 buckets, and
each bucket keeps its smallest remainder as 6 bits of leading-zero count and 10 bits of mantissa
(a 16-bit HyperMinHash register).  32 bands of 4 registers nominate candidates, a collision-corrected
Jaccard estimate drops the hopeless ones, and the full sets decide.  At a similarity of 0.85 the bands
miss a pair with probability under 1e-10, at 0.8 under 1e-7.

No group is ever expanded into all its pairs:

* equal sets are one node from the start;
* a shingle that no other candidate has bounds its owner's similarity to anything; nodes that can reach
  no partner under that bound go, and every later pair has to satisfy it;
* in each band bucket members are first compared with two pivots: the node with most shared shingles
  and one drawn by hash;
* once those links have been closed into components, only nodes of a bucket that are still in different
  components are looked at again.  Two that were compared with the same pivot need no further data: what
  each lacks of the pivot and adds to it says exactly what they share, so the join gives links and no other
  pairs.  Pairs with a node that the bounds or the estimate kept from the pivot are bounded, estimated and
  compared as before.  After that the components are those of all links, but for what the bands miss and
  for pairs estimated SIGMAS deviations too low.

With exact=True nothing is missed: the buckets are then the shingles of prefix filtering (of the shingles
in order of their frequency, similar sets share one of the first n - t n + 1) and the estimate is not
asked; the rest is the same.

Sketches, sets and registers are each kept in one table; pairs are narrow until they are compared, and each
table goes as soon as nothing needs it.  A pivot that many pairs meet is dealt out in copies, so that a
key holds about SALT_ROWS pairs.

Edge cases: a null or blank text has an empty set and links with nothing; with fewer than k words the
whole sequence is the one shingle; rows with a null id keep a null component and are kept; rows that
repeat an id are told apart by their text; ties do not matter, as a component is named by its smallest id;
other columns of the input are not read, and may have any names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import BROADCAST_ROWS, join_by_size, packed, release, small_batches, spill, text_key, unpacked, utf8

BUCKET_BITS, MANTISSA_BITS = 7, 10
REGISTERS = 1 << BUCKET_BITS
BAND_ROWS = 4
BANDS = REGISTERS // BAND_ROWS
REST_BITS = 64 - BUCKET_BITS
#: An estimate this many standard deviations under the threshold still goes to verification.
SIGMAS = 5.0
#: Pairs of one pivot that meet in one key, about.
SALT_ROWS = 500
#: Registers are kept four to a long, a band in each: bits where they start.
LANES = (0, 16, 32, 48)

_U = np.uint64
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()  # of bytes: A-Z and ASCII blanks only
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(xxh3_64_intdigest, words), _U, len(words))
    width = min(k, len(h))
    acc = np.full(len(h) - width + 1, width, _U)
    for j in range(width):
        acc = _mix(acc * _MIX[2] + h[j : len(h) - width + 1 + j])
    return np.unique(acc)


def registers(u: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted hashes; 0 is an empty bucket."""
    out = np.zeros(REGISTERS, np.int32)
    if len(u):
        bucket = (u >> _U(REST_BITS)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # sorted: the first is the smallest
        rest = u[first] & _U((1 << REST_BITS) - 1)
        length = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
        zeros = np.clip(REST_BITS - length, 0, REST_BITS)
        mantissa = ((rest << zeros.astype(_U)) >> _U(REST_BITS - 1 - MANTISSA_BITS)) & _U((1 << MANTISSA_BITS) - 1)
        out[bucket[first]] = ((zeros + 1) << MANTISSA_BITS) | mantissa.astype(np.int64)
    return out


def packed_registers(regs: np.ndarray) -> np.ndarray:
    """A long for each band, with its registers in LANES; 0 for a band without registers."""
    return regs.astype("<u2").view("<i8")


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        n, fps, regs = [], [], []
        for text in batch.column("text").to_pylist():
            u = shingle_set(text, k)
            n.append(len(u))
            fps.append(xxh3_128_digest(u.tobytes()) if len(u) else None)
            regs.append(packed_registers(registers(u)) if len(u) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("tkey"), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(regs, pa.list_(pa.int64()))],
            names=["id", "tkey", "n", "fp", "regs"],
        )


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text, k).view(np.int64) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])


def _lanes(x: Column, y: Column, test) -> Column:
    """Of the registers of two packed arrays, how many pass test(register of x, register of y)."""

    def in_band(v: Column, w: Column) -> Column:
        of = [(F.shiftrightunsigned(v, at).bitwiseAND(0xFFFF), F.shiftrightunsigned(w, at).bitwiseAND(0xFFFF)) for at in LANES]
        return sum((test(p, q).cast("int") for p, q in of[1:]), test(*of[0]).cast("int"))

    return F.aggregate(F.zip_with(x, y, in_band), F.lit(0), lambda s, m: s + m)


def estimate(regs_a: Column, regs_b: Column, n_a: Column, n_b: Column) -> Column:
    """Jaccard estimate of two packed register arrays, less the matches that chance alone brings."""
    used = _lanes(regs_a, regs_b, lambda x, y: (x != 0) | (y != 0))
    same = _lanes(regs_a, regs_b, lambda x, y: (x != 0) & (x == y))
    ratio = F.greatest(n_a, n_b) / F.least(n_a, n_b)
    # expected chance matches of HyperMinHash: 0.1699 * 2^(p - r) * 4x / (1 + x)^2 for sizes in the ratio x
    chance = F.lit(0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS)) * 4 * ratio / ((1 + ratio) * (1 + ratio))
    return F.when(used > 0, F.greatest(F.lit(0.0), (same - chance) / used)).otherwise(F.lit(0.0))


def _likely(regs_a: Column, regs_b: Column, n_a: Column, n_b: Column, num: int, den: int) -> Column:
    """Whether the estimate is no more than SIGMAS standard deviations under the threshold."""
    spread = F.sqrt(F.lit(num / den * (1 - num / den)) / F.greatest(F.lit(1), _lanes(regs_a, regs_a, lambda x, _: x != 0)))
    return estimate(regs_a, regs_b, n_a, n_b) >= num / den - SIGMAS * spread


def _reachable(n_a: Column, c_a: Column, n_b: Column, c_b: Column, num: int, den: int) -> Column:
    """Whether sets of n shingles, c of them shared with anything, can be similar enough."""
    return F.least(c_a, c_b) * (num + den) >= num * (n_a + n_b)


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, label): label is the smallest node of the component.

    Each round every node takes its smallest neighbour as label, labels take their own until none
    changes, and links are carried over to the labels, where those within one label vanish.  A round at
    least halves the nodes that have links.  Minima and joins only, no group is gathered.
    """
    edges = spill(links.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).where("src != dst").distinct(), "edges")
    named = None
    while not edges.isEmpty():
        ends = edges.select(F.col("dst").alias("node"), F.col("src").alias("low")).union(edges.select(F.col("src").alias("node"), F.col("src").alias("low")))
        hooks = spill(ends.groupBy("node").agg(F.min("low").alias("label")), "hooks")
        while True:
            to = hooks.select(F.col("node").alias("label"), F.col("label").alias("root"))
            jumped = spill(hooks.join(to, "label").select("node", F.col("root").alias("label"), F.col("label").alias("was")), "hooks")
            hooks = jumped.select("node", "label")
            if jumped.where("label != was").isEmpty():
                break
        if named is None:
            named = hooks
        else:
            later = hooks.select(F.col("node").alias("label"), F.col("label").alias("root"))
            named = spill(named.join(later, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        moved = edges.join(hooks.select(F.col("node").alias("src"), F.col("label").alias("x")), "src").join(hooks.select(F.col("node").alias("dst"), F.col("label").alias("y")), "dst")
        edges = spill(moved.where("x != y").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct(), "edges")
    return named if named is not None else edges.select(F.col("src").alias("node"), F.col("dst").alias("label"))


def _at_ends(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """pairs(x, p, salts, ...) with side's value of both; p may be in any number of pairs."""
    copies = side.join(pairs.groupBy(F.col("p").alias("node")).agg(F.max("salts").alias("salts")), "node")
    copies = copies.select(F.col("node").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col(value).alias(f"{value}_p"))
    dealt = pairs.join(side.select(F.col("node").alias("x"), F.col(value).alias(f"{value}_x")), "x")
    return dealt.withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts"))).join(copies, ["p", "salt"])


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Each of pairs(x, p, m, ...) once, with salts as m rows or so meet at p; of other columns the largest."""
    rest = [c for c in pairs.columns if c not in ("x", "p", "m")]
    return pairs.groupBy("x", "p").agg(F.ceil(F.max("m") / SALT_ROWS).cast("long").alias("salts"), *[F.max(c).alias(c) for c in rest])


def _apart_around_pivots(seen: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between nodes of different components that have been compared with the same pivot.

    The shingles of a pivot that a node lacks, and those that it adds, say exactly what two such nodes
    share, so that no pair of them leaves this join but a link.
    """
    around = seen.where("leads").join(labels, F.col("x") == F.col("node"), "left").select("p", "n_p", "x", F.coalesce("label", "x").alias("label"), "lacks", "adds")
    sizes = around.groupBy("p", "label").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("p").agg(F.count("*").alias("labels"), F.max(F.struct("m", "label")).getField("label").alias("main"), F.sum("m").alias("m")).where("labels > 1")
    around = spill(around.join(mixed.select("p", "main", F.ceil(F.col("m") / SALT_ROWS).cast("long").alias("salts")), "p"), "around")
    stray = around.where("label != main").select("p", *[F.col(c).alias(f"{c}_s") for c in ("x", "label", "lacks", "adds")], F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    n, n_s = (F.col("n_p") - F.size(f"lacks{e}") + F.size(f"adds{e}") for e in ("", "_s"))
    similar = lambda both: both * (num + den) >= num * (n + n_s)
    at_most = F.col("n_p") - F.greatest(F.size("lacks"), F.size("lacks_s")) + F.least(F.size("adds"), F.size("adds_s"))
    both = F.col("n_p") - F.size("lacks") - F.size("lacks_s") + F.size(F.array_intersect("lacks", "lacks_s")) + F.size(F.array_intersect("adds", "adds_s"))
    pairs = around.withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts"))).join(stray, ["p", "salt"])
    pairs = pairs.where((F.col("label") != F.col("label_s")) & ((F.col("label") == F.col("main")) | (F.col("x") < F.col("x_s"))) & similar(at_most)).where(similar(both))
    links = spill(pairs.select(F.col("x").alias("a"), F.col("x_s").alias("b")).distinct(), "links")
    release(around)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, exact: bool = False) -> DataFrame:
    """One row per input row: id, tkey (names the row's text), n_shingles, component_id, kept, component.

    Sets link when den * |intersection| >= num * |union|.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tkey"), utf8(F.col(text_col)).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    sketches = spill(rows.mapInArrow(functools.partial(_sketch, k=k), f"id {id_type}, tkey long, n long, fp binary, regs array<long>"), "sketch")

    # a node for each set, with the row that stands for it
    equal = sketches.where("id is not null and fp is not null").groupBy("fp", "id", "tkey").agg(F.count("*").alias("times"), F.max("n").alias("n"))
    nodes = equal.groupBy("fp").agg(F.min(F.struct("id", "tkey", "times")).alias("rep"), F.sum("times").alias("copies"), F.max("n").alias("n"))
    nodes = spill(nodes.select(F.monotonically_increasing_id().alias("node"), "fp", F.xxhash64("fp").alias("tie"), "rep.*", "copies", "n"), "nodes")
    repeated = not nodes.where("times > 1").isEmpty()

    def standing(of: DataFrame, which: DataFrame, n_which: float) -> DataFrame:
        """The rows that stand for the nodes of which; of equal rows one."""
        which = which.select("node", "id", "tkey", "times")
        out = join_by_size(of, which.where("times = 1") if repeated else which, ["id", "tkey"], n_which)
        if repeated:
            out = out.union(join_by_size(of, which.where("times > 1"), ["id", "tkey"], n_which).dropDuplicates(["node"]))
        return out.drop("id", "tkey", "times")

    if exact:
        reps = nodes
    else:
        bands = standing(sketches.select("id", "tkey", "regs"), nodes, math.inf).select("node", F.posexplode("regs").alias("at", "band"))
        buckets = bands.where("band != 0").select("node", F.xxhash64("at", "band").alias("band"))
        crowded = buckets.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band")
        members = spill(buckets.join(crowded, "band"), "members")
        reps = spill(nodes.join(members.select("node").distinct(), "node", "left_semi"), "reps")

    # full sets of the nodes that share a bucket, and of their shingles those that nothing else has
    sets = spill(standing(rows, reps, reps.count()).mapInArrow(functools.partial(_sets, k=k), "node long, shingles array<long>"), "sets")
    shingles = sets.select("node", F.explode("shingles").alias("s"))
    alone = shingles.groupBy("s").agg(F.count("*").alias("df"), F.min("node").alias("node")).where("df = 1").groupBy("node").agg(F.count("*").alias("u"))
    bounded = reps.select("node", "tie", "n").join(alone, "node", "left").select("node", "tie", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("c"))
    bounded = spill(bounded.where(F.col("c") * den >= num * F.col("n")), "bounded")
    n_bounded = bounded.count()
    if exact:
        common = shingles.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
        order = F.row_number().over(Window.partitionBy("node").orderBy("df", "s"))
        prefix = F.col("c") - F.ceil(F.col("n") * num / den) + 1  # the shingles that nothing else has come before these
        ranked = shingles.join(common, "s").withColumn("nth", order).join(bounded, "node").where(F.col("nth") <= prefix)
        members = spill(ranked.select("node", F.col("s").alias("band")), "members")
    else:
        release(reps)
    kept_sets = spill(join_by_size(sets, bounded.select("node"), ["node"], n_bounded, "left_semi"), "sets")
    release(sets)
    sets = kept_sets
    live = spill(join_by_size(members, bounded, ["node"], n_bounded), "live")
    release(members)
    regs = spill(standing(sketches.select("id", "tkey", "regs"), nodes.join(bounded.select("node"), "node", "left_semi"), n_bounded).join(bounded, "node"), "regs")

    def compared(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs(x, p) those that the estimate doesn't rule out: whether they link, and how x differs from p."""
        if not exact:
            p = _at_ends(pairs, regs.select("node", F.struct("n", "regs").alias("r")), "r")
            pairs = p.where(_likely(F.col("r_x.regs"), F.col("r_p.regs"), F.col("r_x.n"), F.col("r_p.n"), num, den)).select(pairs.columns)
        p = _at_ends(pairs, sets, "shingles").withColumn("adds", F.array_except("shingles_x", "shingles_p")).withColumn("lacks", F.array_except("shingles_p", "shingles_x"))
        both = F.size("shingles_x") - F.size("adds")
        linked = den * both >= num * (F.size("shingles_p") + F.size("adds"))
        return p.select(*[c for c in pairs.columns if c != "salts"], F.size("shingles_p").alias("n_p"), "lacks", "adds", linked.alias("linked"))

    # first: everyone with two of its bucket, the one with most shared shingles and one drawn by hash
    pivots = live.groupBy("band").agg(
        F.max(F.struct((F.col("c") / F.col("n")).alias("share"), "n", "c", "tie", "node")).alias("p"), F.max(F.struct(F.xxhash64("tie", "band").alias("draw"), "n", "c", "node")).alias("q"), F.count("*").alias("m")
    )
    pivots = spill(pivots.where("m > 1"), "pivots")
    near = live.join(pivots, "band")
    star = [near.select(F.col("node").alias("x"), "n", "c", "m", F.col(f"{v}.node").alias("p"), F.col(f"{v}.n").alias("n_p"), F.col(f"{v}.c").alias("c_p"), F.lit(v == "p").alias("leads")) for v in ("p", "q")]
    star = star[0].union(star[1]).where("x != p").where(_reachable(F.col("n"), F.col("c"), F.col("n_p"), F.col("c_p"), num, den))
    star = spill(_distinct_pairs(star.select("x", "p", "m", "leads")), "star")
    seen = spill(compared(star), "seen")
    release(star)
    first = components(seen.where("linked").select(F.col("x").alias("a"), F.col("p").alias("b")))

    # then, of who shares a bucket and is still apart: those that were compared with its pivot
    around = _apart_around_pivots(seen, first, num, den)
    # and the others; a bucket's largest component needs no pairs of its own
    placed = live.join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = placed.groupBy("band", "label").agg(F.count("*").alias("m"), F.min("n").alias("low_n"))
    mixed = sizes.groupBy("band").agg(F.count("*").alias("labels"), F.max(F.struct("m", "label")).getField("label").alias("main"), F.sum("m").alias("m"), F.min("low_n").alias("low_n")).where("labels > 1")
    placed = placed.join(mixed.drop("labels"), "band").join(pivots.select("band", F.col("p.node").alias("p")), "band").where("node != p")
    placed = placed.join(seen.where("leads").select(F.col("x").alias("node"), "p", F.lit(True).alias("known")), ["node", "p"], "left")
    placed = spill(placed.select("band", "node", "n", "c", "label", "main", "m", "low_n", F.col("known").isNotNull().alias("known")), "placed")
    release(live, pivots, seen)
    # a straggler whose shared shingles cannot carry even the bucket's shortest partner has none
    stray = placed.where("label != main").where(F.col("c") * (num + den) >= num * (F.col("n") + F.col("low_n")))
    stray = stray.select("band", *[F.col(c).alias(f"{c}_p") for c in ("node", "n", "c", "label", "known")])
    apart = placed.join(stray, "band").where(
        (F.col("label") != F.col("label_p")) & ((F.col("label") == F.col("main")) | (F.col("node") < F.col("node_p")))
        & ~(F.col("known") & F.col("known_p")) & _reachable(F.col("n"), F.col("c"), F.col("n_p"), F.col("c_p"), num, den)
    )
    apart = spill(_distinct_pairs(apart.select(F.col("node").alias("x"), F.col("node_p").alias("p"), "m")), "apart")
    release(placed)
    more = spill(around.union(compared(apart).where("linked").select(F.col("x").alias("a"), F.col("p").alias("b"))), "more")
    release(sets, regs, apart, around)
    if more.isEmpty():
        final = first
    else:  # the new links are between labels, or nodes that had none
        at = lambda c: first.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
        between = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
        joined = components(between)
        named = first.join(joined.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
        final = named.unionByName(joined.join(first.select("node"), "node", "left_anti"))

    # a component's id is the smallest id of all its documents
    names = nodes.select("node", "fp", F.col("id").alias("low"), "copies").join(final, "node", "left")
    linked = names.where("label is not null")
    lowest = linked.groupBy("label").agg(F.min("low").alias("component_id"))
    grouped = linked.join(lowest, "label").select("fp", "component_id", "label").union(names.where("label is null and copies > 1").select("fp", F.col("low").alias("component_id"), F.col("node").alias("label")))
    grouped = spill(grouped, "grouped")
    out = sketches.select("id", "tkey", "n", "fp").join(F.broadcast(grouped) if grouped.count() <= BROADCAST_ROWS else grouped, "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return out.select("id", "tkey", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), F.col("label").alias("component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, exact: bool = False) -> DataFrame:
    """docs without all but one document of each group, all columns as they were.

    Rows that are equal in id and text count as copies too: one of them stays.
    """
    found = spill(near_duplicates(docs, id_col, text_col, k, num, den, exact).where("id is not null"), "kept")
    keyed = packed(docs, id=F.col(id_col), tkey=text_key(F.col(text_col)))
    gone = found.where(~F.col("kept")).select("id", "tkey").distinct()
    left = keyed.join(gone, ["id", "tkey"], "left_anti")
    # where rows of one component repeat the kept id, the one of the smallest text key stays
    crowded = found.where("kept").groupBy("component").agg(F.count("*").alias("m"), F.min("tkey").alias("low")).where("component is not null and m > 1")
    again = found.where("kept").join(crowded, "component").select("id", "tkey", (F.col("tkey") == F.col("low")).alias("stays")).distinct()
    again = spill(again, "again")
    if not again.isEmpty():
        marked = left.join(again, ["id", "tkey"], "left")
        left = marked.where("stays is null").unionByName(marked.where("stays").dropDuplicates(["id", "tkey"]))
    return unpacked(left)
