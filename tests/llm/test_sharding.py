"""Shards against a plain minimax search."""

import random
import zlib

from corpusmill.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


def least(sizes, shards):
    def used(capacity):
        n, load = 1, 0
        for s in sizes:
            n, load = (n + 1, s) if load + s > capacity else (n, load + s)
        return n

    low = max(sizes)
    while used(low) > shards:
        low += 1
    return low


def test_smallest_capacity_is_met(spark):
    rng = random.Random(2)
    for trial in range(4):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 50))] + ([900] if trial == 2 else [])
        atoms = spark.createDataFrame([(n, s, 1) for n, s in enumerate(sizes)], "atom long, bytes long, rows long").repartition(3)
        for shards in (1, 3, 7):
            got = sorted(tuple(r) for r in S.plan_shards(atoms, shards).collect())
            loads = {}
            for atom, _, shard, capacity in got:
                loads[shard] = loads.get(shard, 0) + sizes[atom]
            assert capacity == least(sizes, shards) and max(loads.values()) <= capacity
            order = [s for _, _, s, _ in got]
            assert order == sorted(order) and max(order) < shards


def test_documents(spark):
    rng = random.Random(4)
    rows = [(n, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 40)))) for n in range(300)]
    rows += [(1000 + n, "a copied text") for n in range(200)] + [(None, "x"), (None, None), (5, ""), (5, ""), (6, "ü" * 5000)]
    got = S.shard_documents(frame(spark, rows), shards=8, unit_rows=16).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    slots, homes = {}, {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in homes.values()) and set(slots) <= set(range(8))
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}


def test_empty_table_and_one_row(spark):
    assert S.shard_documents(frame(spark, [])).count() == 0
    (row,) = S.shard_documents(frame(spark, [(1, None)])).collect()
    assert (row["shard"], row["slot"], row["size"]) == (0, 0, 16)
