"""Prefix trie of rebuilt conversations from the order of their turn sequences.

Conversations become arrays of turn digests; equal ones are counted once. The
distinct sequences are range-sorted, so every trie node is an interval of
neighbours. Within a run of neighbours a union-find takes the edges between
neighbours in descending order of their common prefix (LCP): each merge makes or
widens the branching node at that depth, and the chain of nodes above a merged
component, up to the merge, is complete. Nodes on the path of the first or last
sequence of a run may go on in the next run: they stay open, and the run is
contracted to these two paths with what hangs off them. Contracted runs are merged
in the same way, ``FAN`` at a time, until one is left; children of nodes that were
open get their parent's id by a join at the end.

Turns without conv_id belong to no conversation and are left out. Turns are ordered
by turn (null first), repeated or missing turn numbers by the digest of role and
text. Null role or text is empty. A conversation that keeps no turn is a member of
the root. Repeated rows are repeated turns. Empty tables give no nodes. Extra
columns are ignored. One conversation's digests (not its texts) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import fits_broadcast, salted_join, stage

SHARED_TURNS = 5  # most turns taken from the first conversation of a hundred
HUNDRED = 100
CHUNK_IDS = 4096
RUN_TURNS = 200_000
FAN = 64

HANG = [("depth", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())]
PARTS = pa.schema(
    [
        ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("parent_key", pa.string()), ("node_key", pa.string()),
        ("part", pa.int64()), ("side", pa.int32()), ("digests", pa.list_(pa.string())), ("chars", pa.list_(pa.int64())), ("hang", pa.list_(pa.struct(HANG))),
    ]
)
PARTS_DDL = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, parent_key string, node_key string, "
    "part long, side int, digests array<string>, chars array<long>, "
    "hang array<struct<depth: long, n: long, least: long, children: long, leaves: long, saved: long, ends: string>>"
)
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Sums:
    """What hangs at one node: conversations, children, and totals of their subtrees."""

    __slots__ = ("n", "least", "children", "leaves", "saved", "ends", "rows")

    def __init__(self, n=0, least=None, children=0, leaves=0, saved=0, ends=None, rows=None):
        self.n, self.least, self.children, self.leaves, self.saved, self.ends = n, least, children, leaves, saved, ends
        self.rows = [] if rows is None else rows  # emitted children that wait for their parent's id

    def add(self, other: Sums) -> Sums:
        self.n += other.n
        if other.least is not None and (self.least is None or other.least < self.least):
            self.least = other.least
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends
        if len(other.rows) > len(self.rows):
            self.rows, other.rows = other.rows, self.rows
        self.rows += other.rows
        return self


class Path:
    """One sequence of the sorted order, with what hangs at each depth of it."""

    __slots__ = ("digests", "chars", "hang", "_keys")

    def __init__(self, digests: list[str], chars: list[int], hang: dict[int, Sums]):
        self.digests, self.chars, self.hang, self._keys = digests, chars, hang, None

    def key(self, depth: int) -> str:
        if self._keys is None:
            state = hashlib.sha256()
            self._keys = [state.hexdigest()]
            for digest in self.digests:
                state.update(digest.encode())
                self._keys.append(state.copy().hexdigest())
        return self._keys[depth]


class Component:
    __slots__ = ("first", "last", "depth", "sums", "hang")

    def __init__(self, at: int, path: Path):
        self.first = self.last = at
        self.depth = len(path.digests)
        self.hang = dict(path.hang)
        self.sums = self.hang.pop(self.depth, None) or Sums()


def common(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def merge_run(paths: list[Path], close: bool, keyed: bool) -> tuple[list[list], list[Path]]:
    """Complete nodes of a run of neighbours, and the paths it is contracted to.

    ``close`` completes the open paths too (nothing lies beside the run); ``keyed``
    names the nodes, for children that earlier runs have given out.
    """
    rows: list[list] = []
    count = len(paths)
    left: dict[int, Sums] = {}
    right: dict[int, Sums] = {}
    owner = list(range(count))
    parts = [Component(i, p) for i, p in enumerate(paths)]

    def find(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    def lift(c: Component, to: int) -> None:
        """Complete the nodes of ``c`` deeper than ``to``."""
        while c.depth > to:
            at, sums, path = c.depth, c.sums, paths[c.first]
            up = (c.hang.pop(at - 1, None) or Sums()) if at else None
            if not close and (c.first == 0 or c.last == count - 1):
                (left if c.first == 0 else right)[at] = sums
            else:
                leaves = sums.leaves if sums.children else 1
                saved = sums.saved + ((sums.n - 1) * path.chars[at - 1] if at else 0)
                for r in sums.rows:
                    rows[r][2] = sums.least
                rows.append([sums.least, at, None, sums.n, sums.children, leaves, saved, sums.ends or NO_ENDS, None, path.key(at) if keyed else None])
                if at:
                    up.add(Sums(sums.n, sums.least, 1, leaves, saved, None, [len(rows) - 1]))
            c.depth, c.sums = at - 1, up

    edges = [common(a.digests, b.digests) for a, b in zip(paths, paths[1:])]
    for i in sorted(range(count - 1), key=lambda k: -edges[k]):
        a, b = find(i), find(i + 1)
        for c in (parts[a], parts[b]):
            lift(c, edges[i])
        one, other = (parts[a], parts[b]) if len(parts[a].hang) >= len(parts[b].hang) else (parts[b], parts[a])
        for depth, sums in other.hang.items():
            one.hang[depth] = one.hang[depth].add(sums) if depth in one.hang else sums
        one.sums.add(other.sums)
        one.first, one.last = parts[a].first, parts[b].last
        owner[b] = a
        parts[a], parts[b] = one, None
    lift(parts[find(0)], -1)

    kept = []
    if not close:
        kept = [Path(paths[0].digests, paths[0].chars, left)]
        if count > 1:
            kept.append(Path(paths[-1].digests, paths[-1].chars, right))
        for path in kept:
            for depth, sums in path.hang.items():
                for r in sums.rows:
                    rows[r][8] = path.key(depth)
                sums.rows = []
    return rows, kept


def path_rows(paths: list[Path], part: int) -> list[list]:
    blank = [None] * 10
    return [
        [*blank, part, side, p.digests, p.chars, [{"depth": d, "n": s.n, "least": s.least, "children": s.children, "leaves": s.leaves, "saved": s.saved, "ends": s.ends} for d, s in p.hang.items()]]
        for side, p in enumerate(paths)
    ]


def batch_of(rows: list[list]) -> pa.RecordBatch:
    width = len(PARTS)
    columns = list(zip(*(r + [None] * (width - len(r)) for r in rows))) if rows else [()] * width
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PARTS)], schema=PARTS)


def contract(paths: Iterable[Path], run_turns: int) -> Iterator[tuple[list[list], list[Path]]]:
    """Nodes of the runs of one partition; the last item holds its contracted paths."""
    run: list[Path] = []
    held: list[Path] = []
    turns = 0
    for path in paths:
        run.append(path)
        turns += len(path.digests) + 1
        if turns >= run_turns:
            rows, kept = merge_run(run, False, False)
            yield rows, []
            held += kept
            run, turns = [], 0
            if len(held) >= 2 * FAN:
                rows, held = merge_run(held, False, True)
                yield rows, []
    if run:
        rows, kept = merge_run(run, False, False)
        yield rows, []
        held += kept
    if held:
        rows, held = merge_run(held, False, True) if len(held) > 2 else ([], held)
        yield rows, held


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` (array of digest and code points) after the first turns are shared."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = (
        conversations.where("conv_id is not null")
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.struct(
                F.col("turn").alias("turn"),
                F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8")).alias("digest"),
                F.length(text).cast("long").alias("chars"),
            ).alias("t"),
        )
        .groupBy("conv_id")
        .agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))
    )
    heads = own.where(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED_TURNS).alias("head"))
    named = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED).withColumn("h", (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 6).cast("int"))
    none = F.slice("turns", 1, 0)
    return named.join(heads, "base", "left").select(
        "conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(none)).alias("turns")
    )


def ids_in_chunks(members: DataFrame, chunk: int = CHUNK_IDS) -> DataFrame:
    """``seq, conv_id, n, ends``: smallest id, number and digest of all ids of each ``seq``.

    Ids are range-sorted and joined to chunks first, so that the task that hashes a
    sequence's ids in order reads one row per chunk and holds one chunk.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, ids, out = None, [], []
        names = ["seq", "first", "n", "ids"]

        def cut():
            if ids:
                out.append((seq, ids[0], len(ids), ",".join(map(str, ids))))

        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != seq or len(ids) >= chunk:
                    cut()
                    seq, ids = s, []
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
                out = []
        cut()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, state, least, n, out = None, None, None, 0, []
        names = ["seq", "conv_id", "n", "ends"]
        for batch in batches:
            for s, first, rows, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if s != seq:
                    if seq is not None:
                        out.append((seq, least, n, state.hexdigest()))
                    seq, state, least, n = s, hashlib.sha256(ids.encode()), first, rows
                else:
                    state.update(b"," + ids.encode())
                    n += rows
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
                out = []
        if seq is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (seq, least, n, state.hexdigest())], names)

    chunks = members.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(joined, "seq string, first long, n long, ids string")
    return chunks.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(hashed, "seq string, conv_id long, n long, ends string")


def merger(close: bool, fan: int):
    """Task that merges the contracted runs of ``fan`` neighbouring parts."""

    def merged(table: pa.Table) -> pa.Table:
        held = sorted(table.to_pylist(), key=lambda r: (r["part"], r["side"]))
        paths = [Path(r["digests"], r["chars"], {h.pop("depth"): Sums(**h) for h in r["hang"]}) for r in held]
        rows, kept = merge_run(paths, close, True)
        return pa.Table.from_batches([batch_of(rows + path_rows(kept, held[0]["part"] // fan))])

    return merged


def build_trie(conversations: DataFrame, run_turns: int = RUN_TURNS, fan: int = FAN) -> DataFrame:
    """Per trie node ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    built = stage(rebuilt(conversations).withColumn("seq", F.md5(F.encode(F.array_join("turns.digest", ""), "UTF-8"))), "conversations")
    distinct = ids_in_chunks(built.select("seq", "conv_id")).join(built.select("conv_id", "turns"), "conv_id")
    ordered = distinct.select(F.col("turns.digest").alias("digests"), F.col("turns.chars").alias("chars"), "n", "conv_id", "ends").repartitionByRange("digests").sortWithinPartitions("digests")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def paths():
            for batch in batches:
                for digests, chars, n, conv, ends in zip(*(c.to_pylist() for c in batch.columns)):
                    yield Path(digests, chars, {len(digests): Sums(n, conv, 0, 0, 0, ends)})

        for rows, kept in contract(paths(), run_turns):
            yield batch_of(rows + path_rows(kept, part))

    found = [stage(ordered.mapInArrow(first, PARTS_DDL), "trie")]
    last = found[0].agg(F.max("part")).first()[0]
    while last is not None:
        close = last < fan
        found.append(stage(found[-1].where("part is not null").groupBy(F.floor(F.col("part") / fan)).applyInArrow(merger(close, fan), PARTS_DDL), "trie"))
        last = None if close else last // fan
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionAll(more)
    nodes = nodes.where("part is null").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"), "parent_key", "node_key")
    named = nodes.where("node_key is not null").select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("found"))
    waiting = nodes.where("parent_key is not null")
    joined = waiting.join(F.broadcast(named), "parent_key") if fits_broadcast(named) else salted_join(waiting, named, "parent_key", "conv_id")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return nodes.where("parent_key is null").select(*columns).unionAll(joined.withColumn("parent_conv_id", F.col("found")).select(*columns))
