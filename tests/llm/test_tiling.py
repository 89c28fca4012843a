"""String tiling against a plain greedy search."""

import random

import numpy as np

from corpusmill.llm import tiling as T

DOCS = "doc_id long, text string, item_id string, lang string"
ITEMS = "item_id long, text string, doc_id string"


def plain(doc, item, k):
    doc_free, item_free, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and doc_free[i + n] and item_free[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return tiles
        tiles.append((i, j, n))
        doc_free[i : i + n] = [False] * n
        item_free[j : j + n] = [False] * n


def test_tiles_equal_plain_search():
    rng = random.Random(2)
    for _ in range(150):
        item = [rng.choice("abcd") for _ in range(rng.randint(1, 25))]
        doc = [rng.choice("abcd") for _ in range(rng.randint(0, 12))] + item[7:] + item[:7] + [rng.choice("abcd") for _ in range(5)]
        a = np.array([(i, j) for i in range(len(doc) - 3) for j in range(len(item) - 3) if doc[i : i + 4] == item[j : j + 4]]).reshape(-1, 2)
        assert T.greedy_tiles(a[:, 0], a[:, 1], 4) == plain(doc, item, 4)


def matches(spark, docs, items, **k):
    d = spark.createDataFrame([(i, t, "clash", "en") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "clash") for i, t in items], ITEMS)
    return d, b, T.tile_matches(d, b, **k)


def test_documents(spark):
    words = [f"w{n}" for n in range(40)]
    item = " ".join(words)
    other = " ".join(f"q{n}" for n in range(10))
    moved = "intro " + " ".join(words[20:]) + " middle. " + " ".join(words[:20]).upper()
    docs = [
        (1, f"before, {item}! after"), (2, moved), (3, " ".join(words[:18])), (4, None), (5, ""), (1, f"before, {item}! after"), (6, " ".join(reversed(words))),
        (None, item), (7, "x " * 100_000 + item), (8, f"{item} {other} {item}"), (9, " ".join(w for x in words for w in (x, "z"))),
    ]
    items = [(10, item), (11, other), (12, None), (13, ""), (14, "w1 w2"), (10, item), (None, other)]
    d, b, found = matches(spark, docs, items)
    want = [(i, 10) for i in (1, 1, 2, None, 7, 8)] * 2 + [(8, 11), (8, None)]
    assert sorted(((r["doc_id"], r["item_id"]) for r in found.collect()), key=str) == sorted(want, key=str)
    two = [r for r in found.collect() if r["doc_id"] == 2][0]
    assert (two["tiles"], two["covered"], two["item_tokens"], two["coverage"]) == (2, 40, 40, 1.0)
    blocks = T.tile_matches(d, b, block_bytes=60)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, found.collect()))
    kept = T.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 9]
    assert sorted(r["doc_id"] for r in T.drop_contaminated(d, b, block_bytes=60).collect()) == [3, 4, 5, 6, 9]


def test_empty_tables(spark):
    assert matches(spark, [], [(1, "a b c d e")])[2].count() == 0
    assert matches(spark, [(1, "a b c d e")], [])[2].count() == 0
    d, b, _ = matches(spark, [(1, "a b c d e")], [])
    assert T.drop_contaminated(d, b).count() == 1


def test_tasks_hold_bounded_pieces_of_a_batch():
    import pyarrow as pa

    from corpusmill.llm.batches import ROWS, slices

    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 1, ROWS, 3 * ROWS + 1)]
    got = list(slices(iter(batches)))
    assert max(b.num_rows for b in got) == ROWS
    assert [x for b in got for x in b.column(0).to_pylist()] == [x for b in batches for x in b.column(0).to_pylist()]
    assert list(slices(iter([]))) == []
