"""Minimax contiguous sharding of documents, in DataFrame functions only.

Equal texts form groups that are never cut. Groups are ordered by a hash of
their text and gathered into ``atoms`` consecutive hash classes, the atomic
sizes of the search: their number is fixed, so the one row that holds them
stays small at any input size. The smallest capacity for which a greedy pass
needs at most ``shards`` shards is found by binary search.

Null texts count as empty (size 16). Null doc_ids are allowed and come first in
their class. Repeated rows each get a slot. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import stage

ATOMS = 16384
UNIT_ROWS = 200_000
SEARCH_STEPS = 62


def needed(sizes: Column, capacity: Column) -> Column:
    """Shards that a greedy pass over ``sizes`` fills under ``capacity``."""
    start = F.struct(F.lit(1).cast("long").alias("used"), F.lit(0).cast("long").alias("load"))

    def step(s, x):
        full = s["load"] + x > capacity
        return F.struct(
            F.when(full, s["used"] + 1).otherwise(s["used"]).alias("used"),
            F.when(full, x).otherwise(s["load"] + x).alias("load"),
        )

    return F.aggregate(sizes, start, step, lambda s: s["used"])


def smallest_capacity(sizes: Column, total: Column, largest: Column, shards: int) -> Column:
    """Binary search between the obvious lower bound and the total."""
    low = F.greatest(largest, F.ceil(total / F.lit(shards)).cast("long"))

    def halve(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("long")
        fits = needed(sizes, middle) <= shards
        return F.when(s["low"] >= s["high"], s).otherwise(
            F.when(fits, F.struct(s["low"].alias("low"), middle.alias("high"))).otherwise(F.struct((middle + 1).alias("low"), s["high"].alias("high")))
        )

    start = F.struct(low.alias("low"), F.greatest(low, total).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(SEARCH_STEPS)), start, halve, lambda s: s["high"])


def cuts(entries: Column, capacity: Column, total: Column, shards: int, even: bool) -> Column:
    """First atom of every shard and the largest load.

    ``even`` aims each shard at an equal part of what is left, never above the
    capacity; otherwise shards are filled up to the capacity.
    """
    longs = lambda v: F.lit(v).cast("long")
    start = F.struct(
        F.array(longs(0)).alias("firsts"), longs(0).alias("load"), longs(0).alias("peak"), total.alias("left")
    )

    def step(s, x):
        size, used = x["bytes"], F.size(s["firsts"])
        over = s["load"] + size > capacity
        if even:
            aim = s["left"] / (F.lit(shards) - used + 1)
            over = over | ((s["load"] + size / 2 > aim) & (s["load"] > 0))
        cut = over & (used < shards)
        load = F.when(cut, size).otherwise(s["load"] + size)
        return F.struct(
            F.when(cut, F.concat(s["firsts"], F.array(x["atom"]))).otherwise(s["firsts"]).alias("firsts"),
            load.alias("load"),
            F.greatest(s["peak"], load).alias("peak"),
            F.when(cut, s["left"] - s["load"]).otherwise(s["left"]).alias("left"),
        )

    return F.aggregate(entries, start, step, lambda s: F.struct(s["firsts"].alias("firsts"), s["peak"].alias("peak")))


def plan_shards(atoms: DataFrame, shards: int) -> DataFrame:
    """``atom, rows, shard`` from ``atom, bytes, rows``; one bounded row does the search."""
    one = atoms.agg(F.sort_array(F.collect_list(F.struct("atom", "bytes", "rows"))).alias("entries"), F.sum("bytes").alias("total"), F.max("bytes").alias("largest"))
    one = one.where("total is not null").withColumn("sizes", F.transform("entries", lambda x: x["bytes"]))
    one = one.withColumn("capacity", smallest_capacity(F.col("sizes"), F.col("total"), F.col("largest"), shards))
    one = one.withColumn("near", cuts(F.col("entries"), F.col("capacity"), F.col("total"), shards, True))
    one = one.withColumn("tight", cuts(F.col("entries"), F.col("capacity"), F.col("total"), shards, False))
    one = one.withColumn("firsts", F.when(F.col("near.peak") <= F.col("capacity"), F.col("near.firsts")).otherwise(F.col("tight.firsts")))
    each = one.select("firsts", "capacity", F.explode("entries").alias("x"))
    shard = F.size(F.filter("firsts", lambda c: c <= F.col("x.atom"))) - 1
    return each.select("x.atom", "x.rows", shard.alias("shard"), "capacity")


def shard_documents(docs: DataFrame, shards: int = 40, atoms: int = ATOMS, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Per document ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``slot`` numbers the rows of a shard: classes are cut into units of about
    ``unit_rows`` rows by a hash of doc_id (a class of copies may hold a third
    of all rows), units get offsets from their counts, rows are numbered within.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(atoms).cast("long")).alias("atom"),
        ),
        "shardrows",
    )
    plan = stage(plan_shards(rows.groupBy("atom").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), shards), "shardplan")
    # The plan has at most ``atoms`` rows, so this broadcast is bounded.
    dealt = rows.join(F.broadcast(plan.select("atom", "shard", F.ceil(F.col("rows") / unit_rows).alias("units"))), "atom").withColumn(
        "unit", F.pmod(F.xxhash64("doc_id"), F.col("units"))
    )
    counted = dealt.groupBy("shard", "atom", "unit").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("atom", "unit").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("atom", "unit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("atom", "unit").orderBy("doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["atom", "unit"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
