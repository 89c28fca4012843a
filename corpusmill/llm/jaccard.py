"""Exact self-join of documents on the Jaccard similarity of word shingles.

Method: prefixes over token combinations. Shingles are put in one global order:
those seen once come first, then repeated ones, then frequent ones. Two sets
that are similar enough share their first common shingle within their prefixes,
and their first two within prefixes one longer. A rare shingle of the prefix
is indexed alone; frequent ones in pairs from the longer prefix. Documents
of one index entry are compared in two rounds: each with the entry's head (the
one with the fewest rare shingles), which binds large groups of copies with one
comparison each, then all pairs that the links found so far leave apart. Size
and position filters precede every comparison; comparisons are exact.

The frequency classes only steer the order; they come from counts within tasks,
kept as two bit tables of fixed size, and any outcome gives the same result.

Equal shingle sets are one set, so copies cost nothing beyond the first scan.
Shingles are 64-bit hashes of their words, sets are named by a 64-bit hash.

Words are split at space and ASCII control white space, A-Z lower-cased. Texts
of fewer words than a shingle are one shingle; null texts and texts without
words have none and link with nothing. Null doc_ids form components like others,
and sort last. Repeated rows are copies. Empty tables give no rows. Extra columns
are ignored, or kept by ``drop_near_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.batches import slices
from corpusmill.session import WIDE_GROUP_BYTES, broadcast_checked, stage, wide_rows

WIDTH = 5
PERCENT = 75
FREQUENT = 256
PAIRED = 64
CLASS_BITS, ENTRY_BITS = 24, 27
PARITY_BITS, LEAST_BITS = 2048, 256
COUNT_TOKENS = 400_000
KNOWN_WORDS = 60_000
KNOWN_SETS = 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)

SETS = "kind int, doc_id long, n long, key long, words long, grams binary, counts binary"
ENTRIES = "entry long, key long, n long, pos long, head long, head_n long, head_pos long, more boolean"
POSTINGS = "entry long, pos long, n long, key long"


def _batch(arrays, spec: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in spec.split(", ")])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


# ---- sets of shingles -----------------------------------------------------------


class _WordHashes(dict):
    """Hashes of words met before; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _split(text: bytes | None) -> list[bytes]:
    """Words of UTF-8; of bytes, ``lower`` takes A-Z and ``split`` parts at space and 09 to 0D, no others."""
    return (text or b"").lower().split()


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) > 1 else values


def _windows(ids: np.ndarray, width: int) -> np.ndarray:
    n = len(ids) - width + 1
    value = np.full(n, width, np.uint64)
    for k in range(width):
        value = value * MIX + ids[k : k + n]
    return mixed(value)


def shingles_of(texts: list[bytes | None], hashes: dict, width: int) -> tuple[list[np.ndarray], list[int]]:
    """Sorted distinct 64-bit hashes of the shingles of each text, and the number of its words."""
    words = [_split(t) for t in texts]
    sizes = [len(w) for w in words]
    ids = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, sum(sizes))
    windows = _windows(ids, width) if len(ids) >= width else ids[:0]
    out, at = [], 0
    for n in sizes:
        if n >= width:
            out.append(_distinct(windows[at : at + n - width + 1]))
        else:
            out.append(_windows(ids[at : at + n], n) if n else ids[:0])
        at += n
    return out, sizes


def shingles(text: str | None, hashes: dict, width: int) -> np.ndarray:
    return shingles_of([(text or "").encode("utf-8", "surrogatepass")], hashes, width)[0][0]


def shingle_sets(docs: DataFrame, width: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of kind 0: documents with size, key, words, columns to ``keep`` and (once per task) their set; kind 1: local counts."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast("string").alias(c) for c in keep])
    spec = ", ".join([SETS, *(f"{c} string" for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, held, n_held = _WordHashes(), set(), [], 0

        def counted():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            often = times > 1
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (values[often], times[often].astype(np.int32))]
            return _batch([pa.array([1], pa.int32()), *[pa.nulls(1, pa.int64())] * 4, *packed, *[pa.nulls(1, pa.string())] * len(keep)], spec)

        for batch in slices(batches):
            sizes, keys, grams = [], [], []
            sets_here, words = shingles_of(batch.column(1).cast(pa.binary()).to_pylist(), hashes, width)
            for found in sets_here:
                key = xxhash.xxh3_64_intdigest(raw := found.tobytes()) - (1 << 63) if len(found) else None
                fresh = key is not None and key not in seen
                if fresh:
                    if len(seen) >= KNOWN_SETS:
                        seen.clear()
                    seen.add(key)
                    held.append(found)
                    n_held += len(found)
                sizes.append(len(found))
                keys.append(key)
                grams.append(raw if fresh else None)
            n = batch.num_rows
            numbers = [pa.array(c, pa.int64()) for c in (sizes, keys, words)]
            yield _batch([pa.array(np.zeros(n, np.int32)), batch.column(0), *numbers, pa.array(grams, pa.binary()), pa.nulls(n, pa.binary()), *batch.columns[2:]], spec)
            if n_held >= COUNT_TOKENS:
                yield counted()
                held, n_held = [], 0
        if held:
            yield counted()

    return narrow.mapInArrow(run, spec)


def class_bits(sets: DataFrame, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit tables (repeated, frequent) over the low bits of shingle hashes; 2 MB each at any input size."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slot = (np.frombuffer(grams, np.uint64) & np.uint64((1 << CLASS_BITS) - 1)).astype(np.int64)
                yield _batch([pa.array(np.frombuffer(grams, np.int64)), pa.array(slot), pa.array(np.frombuffer(counts, np.int32))], "g long, slot long, n int")

    local = sets.where("kind = 1").select("grams", "counts").mapInArrow(unpack, "g long, slot long, n int")
    slots = local.groupBy("g", "slot").agg(F.sum("n").alias("n")).groupBy("slot").agg(F.max("n").alias("n"))
    bit = F.expr("shiftleft(1L, cast(slot % 32 as int))")
    words = slots.groupBy(F.floor(F.col("slot") / 32).alias("word")).agg(F.bit_or(bit).alias("any"), F.bit_or(F.when(F.col("n") >= frequent, bit).otherwise(0)).alias("many"))
    any_bits, many_bits = (np.zeros(1 << (CLASS_BITS - 5), np.uint32) for _ in range(2))
    for row in words.toLocalIterator():  # at most 2 ** (CLASS_BITS - 5) rows
        any_bits[row["word"]], many_bits[row["word"]] = row["any"], row["many"]
    return any_bits, many_bits


def classes(grams: np.ndarray, bits: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0: not seen twice, 1: repeated, 2: frequent."""
    slot = grams & np.uint64((1 << CLASS_BITS) - 1)
    word, at = (slot >> np.uint64(5)).astype(np.int64), (slot & np.uint64(31)).astype(np.uint32)
    return sum((((table[word] >> at) & np.uint32(1)).astype(np.int8) for table in bits), np.zeros(len(grams), np.int8))


def classified(column: pa.Array, bits: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each set of a batch with the classes of its shingles, which are looked up for all sets at once."""
    sets_here = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in column]
    kinds = classes(np.concatenate([*sets_here, np.zeros(0, np.uint64)]), bits)
    at = 0
    for grams in sets_here:
        yield grams, kinds[at : at + len(grams)]
        at += len(grams)


# ---- the index --------------------------------------------------------------------


@lru_cache(maxsize=256)
def _pairs_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def index_entries(grams: np.ndarray, kinds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of one set and the position of each one's first shingle in the set's order.

    Frequent shingles stand in pairs in sets of up to ``PAIRED`` shingles and
    alone in larger ones, whose pairs would be too many. Sets of sizes that may
    meet across that border have both kinds of entries.
    """
    n = len(grams)
    may_miss = n - -(-percent * n // 100)
    order = np.argsort(kinds, kind="stable")
    prefix, kind = grams[order[: may_miss + 2]], kinds[order[: may_miss + 2]]
    paired, single = 100 * n <= 100 * 100 * PAIRED // percent, n > percent * PAIRED // 100
    alone = np.flatnonzero((kind[: may_miss + 1] < 2) | single)
    entries, places = [prefix[alone]], [alone]
    often = np.flatnonzero(kind == 2)
    if paired and len(often) > 1 and often[0] <= may_miss:
        a, b = _pairs_of(len(often))
        keep = often[a] <= may_miss
        a, b = often[a[keep]], often[b[keep]]
        entries.append(mixed(prefix[a] * MIX + prefix[b]))
        places.append(a)
    return np.concatenate(entries), np.concatenate(places)


def _listed(sets: DataFrame) -> DataFrame:
    return sets.where("grams is not null and kind = 0").select("key", "grams")


def repeated_entries(sets: DataFrame, bits, percent: int) -> np.ndarray:
    """Bit table over the low bits of entries that occur twice or more.

    Entries travel as packed 32-bit values, each once per task and chunk, in as
    many buckets as their number asks for; so an entry in a third of all sets
    is no larger than another. 16 MB at any input size: when it fills up, more
    entries pass in vain.
    """
    total = sets.where("kind = 0 and grams is not null").agg(F.sum("n")).first()[0] or 0
    buckets = max(64, math.ceil(total / 4_000_000))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            bucket = ((values >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            values, times, bucket = values[order].astype(np.uint32), times[order], bucket[order]
            edges = np.append(np.flatnonzero(np.append(True, np.diff(bucket) != 0)), len(bucket))
            rows = []
            for a, b in zip(edges[:-1], edges[1:]):
                twice = values[a:b][times[a:b] > 1]
                rows.append((int(bucket[a]), values[a:b].tobytes(), twice.tobytes()))
            return _batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], "bucket long, once binary, twice binary")

        for batch in slices(batches):
            for grams, kinds in classified(batch.column(1), bits.value):
                held.append(index_entries(grams, kinds, percent)[0])
                size += len(held[-1])
                if size > COUNT_TOKENS:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    def meet(rows):
        import pandas as pd

        values, times = np.unique(np.concatenate([np.frombuffer(r, np.uint32) for r in rows["once"]]), return_counts=True)
        found = np.unique(np.concatenate([values[times > 1], *[np.frombuffer(r, np.uint32) for r in rows["twice"]]])) & np.uint32((1 << ENTRY_BITS) - 1)
        part = found >> np.uint32(ENTRY_BITS - 5)
        return pd.DataFrame([(int(p), found[part == p].tobytes()) for p in np.unique(part)], columns=["part", "slots"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slots = np.frombuffer(raw, np.uint32) & np.uint32((1 << (ENTRY_BITS - 5)) - 1)
                table = tables.setdefault(part, np.zeros(1 << (ENTRY_BITS - 8), np.uint8))
                np.bitwise_or.at(table, slots >> np.uint32(3), np.uint8(1) << (slots & np.uint32(7)).astype(np.uint8))
        for part, table in tables.items():
            yield _batch([pa.array([part], pa.int64()), pa.array([table.tobytes()], pa.binary())], "part long, slots binary")

    packed = _listed(sets).mapInArrow(pack, "bucket long, once binary, twice binary")
    slots = packed.groupBy("bucket").applyInPandas(meet, "part long, slots binary")
    table = np.zeros((32, 1 << (ENTRY_BITS - 8)), np.uint8)
    for row in slots.repartition(32, "part").mapInArrow(merge, "part long, slots binary").collect():  # 32 rows of 512 kB at most
        table[row["part"]] = np.frombuffer(row["slots"], np.uint8)
    return table.reshape(-1)


def postings(sets: DataFrame, bits, repeated: np.ndarray, percent: int) -> DataFrame:
    """``entry, pos, n, key`` of the entries that may have two sets or more."""
    known = sets.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts, size = [], 0
            for key, (grams, kinds) in zip(batch.column(0).to_pylist(), classified(batch.column(1), bits.value)):
                entry, pos = index_entries(grams, kinds, percent)
                slot = entry & np.uint64((1 << ENTRY_BITS) - 1)
                met = np.flatnonzero((known.value[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
                parts.append((entry[met].view(np.int64), pos[met], np.full(len(met), len(grams)), np.full(len(met), key)))
                size += len(met)
                if size > 200_000:
                    yield _batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts)], POSTINGS)
                    parts, size = [], 0
            if parts:
                yield _batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts)], POSTINGS)

    return _listed(sets).mapInArrow(run, POSTINGS)


def shared_entries(rows: DataFrame) -> DataFrame:
    """Postings of entries with two sets or more, each with the entry's head.

    Rows arrive sorted by entry; only the head of the current entry is kept.
    ``more`` is false where an entry surely has one set besides its head.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, told = None, False  # first row of the current entry; whether it has been sent on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            carried = head is not None
            if carried:
                rows = np.concatenate([head[:, None], rows], axis=1)
            entry, pos, n, key = rows
            first = np.append(True, entry[1:] != entry[:-1])
            start = np.maximum.accumulate(np.where(first, np.arange(len(entry)), 0))
            other = key != key[start]
            shared = np.zeros(len(entry), bool)
            shared[start[other]] = True
            repeated = np.append(False, (key[1:] == key[:-1]) & ~first[1:])  # a copy that another task listed
            send = shared | (other & ~repeated)
            if carried and told:
                send[0] = False
            last = int(start[-1])
            told = bool(shared[last]) or (carried and last == 0 and told)
            head = rows[:, last].copy()
            keep = np.flatnonzero(send)
            if len(keep):
                at = start[keep]
                # An entry that goes on in another batch may have more sets than are seen here.
                more = (np.bincount(start[other & ~repeated], minlength=len(entry))[at] > 1) | (at == last) | (carried & (at == 0))
                yield _batch([pa.array(x) for x in (entry[keep], key[keep], n[keep], pos[keep], key[at], n[at], pos[at], more)], ENTRIES)

    return rows.repartition("entry").sortWithinPartitions("entry", "pos", "n", "key").mapInArrow(run, ENTRIES)


def _may_link(n1, p1, n2, p2, percent: int):
    """Size filter, and position filter for pairs whose first common shingle stands at these positions."""
    size = (100 * F.least(n1, n2)) >= percent * F.greatest(n1, n2)
    left = F.least(n1 - p1, n2 - p2)
    return size & ((100 + percent) * left >= percent * (n1 + n2))


def _needed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``key, grams`` of the sets in ``pairs``, one row each."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    return _listed(sets).join(broadcast_checked(keys), "key", "left_semi").groupBy("key").agg(F.any_value("grams").alias("grams"))


def parity(grams: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """Bits that are set where an odd number of hashes falls; ``bits`` is a power of two."""
    slot = (grams >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(slot.astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def parity_bits(n: int) -> int:
    """Two to four bits per element: a table of fixed size says nothing of large sets."""
    return max(LEAST_BITS, 1 << (2 * n - 1).bit_length())


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing parity bits per row; the wider table is folded to the width of the other."""
    x, y = (x, y) if x.shape[1] <= y.shape[1] else (y, x)
    while y.shape[1] > x.shape[1]:
        half = y.shape[1] // 2
        y = y[:, :half] ^ y[:, half:]
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def not_excluded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that parity bits do not rule out.

    Two sets differ in at least as many elements as their parity bits differ,
    so half of what remains of both sizes bounds the common ones. A pair travels
    with a thirtieth of its sets here.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets_here = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in batch.column(1)]
            yield _batch([batch.column(0), pa.array(map(len, sets_here), pa.int64()), pa.array([parity(g, parity_bits(len(g))).tobytes() for g in sets_here], pa.binary())], "key long, n long, bits binary")

    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    bits = _listed(sets).join(broadcast_checked(keys), "key", "left_semi").mapInArrow(sketch, "key long, n long, bits binary").dropDuplicates(["key"])
    side = lambda k, n, v: bits.select(F.col("key").alias(k), F.col("n").alias(n), F.col("bits").alias(v))
    joined = pairs.join(side("a", "n1", "x"), "a").join(side("b", "n2", "y"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in (3, 5))
            both = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            apart = np.zeros(len(x), np.int64)
            widths = np.array([(len(p), len(q)) for p, q in zip(x, y)], np.int64).reshape(-1, 2)
            for pair in np.unique(widths, axis=0):
                rows = np.flatnonzero((widths == pair).all(axis=1))
                apart[rows] = differing(*(np.frombuffer(b"".join(side[r] for r in rows), np.uint8).reshape(len(rows), -1) for side in (x, y)))
            common = (both - apart) // 2
            mask = pa.array(100 * common >= percent * (both - common))
            yield _batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], "a long, b long")

    return joined.select("a", "b", "n1", "x", "n2", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough, counted exactly."""
    left = stage(not_excluded(stage(pairs, "pairs"), sets, percent), "leftpairs")
    needed = _needed(left, sets)
    joined = left.join(needed.select(F.col("key").alias("a"), F.col("grams").alias("x")), "a").join(needed.select(F.col("key").alias("b"), F.col("grams").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = []
            for raw_x, raw_y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(raw_x.as_buffer(), np.uint64), np.frombuffer(raw_y.as_buffer(), np.uint64)
                both = len(x) + len(y)
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")
                common = int(np.count_nonzero(merged[1:] == merged[:-1]))
                good.append(100 * common >= percent * (both - common))
            mask = pa.array(good, pa.bool_())
            yield _batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], "a long, b long")

    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """``node, comp``: the smallest node of every component, for nodes with links.

    Alternates large-star and small-star steps until nothing changes, and fails
    if ``limit`` rounds do not get there. Every
    step is written to the shared folder.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = None
    for _ in range(limit):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = stage(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links"
        )
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components are not stable after {limit} rounds")
    nodes = edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    return nodes.unionByName(nodes.select(F.col("comp").alias("node"), "comp").distinct())


def similar_sets(sets: DataFrame, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """Links ``a, b`` between keys: enough of them to join every component."""
    bits = sets.sparkSession.sparkContext.broadcast(class_bits(sets, frequent))
    index = stage(shared_entries(postings(sets, bits, repeated_entries(sets, bits, percent), percent)), "entries")
    heads = index.where((F.col("key") != F.col("head")) & _may_link(F.col("n"), F.col("pos"), F.col("head_n"), F.col("head_pos"), percent))
    first = stage(verified(heads.select(F.least("key", "head").alias("a"), F.greatest("key", "head").alias("b")).distinct(), sets, percent), "firstlinks")
    known = broadcast_checked(components(first).select(F.col("node").alias("key"), "comp"))
    # Pairs with a head are settled, and with them all pairs of entries of two sets.
    named = index.where("more and key <> head").select("entry", "key", "n", "pos").join(known, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    apart = named.groupBy("entry").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("entry")
    rest = stage(named.join(apart, "entry", "left_semi"), "restentries")
    a, b = rest.alias("a"), rest.alias("b")
    met = a.join(
        b,
        (F.col("a.entry") == F.col("b.entry"))
        & (F.col("a.comp") < F.col("b.comp"))
        & _may_link(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"), percent),
    )
    others = met.select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct()
    return first.unionByName(verified(others, sets, percent))


def near_copy_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id`` (smallest doc_id linked, directly or not)."""
    with wide_rows(docs.sparkSession):
        sets = stage(shingle_sets(docs, width), "sets", WIDE_GROUP_BYTES)
        groups = components(similar_sets(sets, percent, frequent)).withColumnRenamed("node", "key")
    rows = sets.where("kind = 0").select("doc_id", "n", "key")
    keys = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    named = keys.join(groups, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_key = named.join(smallest, "comp").select("key", "component_id")
    return rows.join(by_key, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def sized_clusters(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """Per row ``doc_id, source, cluster, size``: a number equal within a group of near copies (null without words), and its words."""
    with wide_rows(docs.sparkSession):
        sets = stage(shingle_sets(docs, width, keep=("source",)), "sets", WIDE_GROUP_BYTES)
        groups = stage(components(similar_sets(sets, percent, frequent)), "groups").withColumnRenamed("node", "key")
    rows = sets.where("kind = 0").select("doc_id", "source", "key", F.col("words").alias("size"))
    return rows.join(broadcast_checked(groups), "key", "left").select("doc_id", "source", F.coalesce("comp", "key").alias("cluster"), "size")


def drop_near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of every component stays, that with the smallest id; all columns kept.

    A doc_id goes if any of its rows is near to a smaller id. Of rows that repeat
    id and text one stays. Documents without words or without id stay.
    """
    rows = stage(near_copy_components(docs, width, percent), "components")
    near = stage(rows.where("doc_id <> component_id").select("doc_id").distinct(), "nearcopies")
    kept = docs.join(broadcast_checked(near), "doc_id", "left_anti").select(*docs.columns)
    again = stage(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeatedids")
    if again.isEmpty():
        return kept
    again = broadcast_checked(again)
    single = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").unionByName(single).select(*docs.columns)
