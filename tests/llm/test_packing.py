"""Packing: whole results, capacity, conflicts and tightest bins."""

import random

from corpusmill.llm import packing as P

SCHEMA = "doc_id long, text string, source string, bin string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash") for i, t, s in rows], SCHEMA)


def plain(rows, capacity):
    """Best fit by a scan over all bins."""
    pieces = []
    for doc, source, cluster, size in rows:
        n = 0
        while True:
            pieces.append((min(capacity, size - n * capacity), doc, n, source, cluster))
            n += 1
            if n * capacity >= size:
                break
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    bins, out = [], []
    for size, doc, n, source, cluster in pieces:
        if not size:
            out.append((doc, n, None))
            continue
        fits = [(capacity - b[0], k) for k, b in enumerate(bins) if capacity - b[0] >= size and not (source is not None and source in b[1]) and cluster not in b[2]]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([0, set(), set()])
        bins[k][0] += size
        bins[k][1].add(source)
        bins[k][2].add(cluster)
        out.append((doc, n, k))
    return sorted(out, key=str)


def test_group_equals_plain_best_fit():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(n, rng.choice([None, "hot", "hot", "a", "b", "c"]), rng.randrange(20), rng.choice([0, 1, 3, 5, 9, 10, 11, 25])) for n in range(rng.randint(0, 60))]
        got = sorted(((d, n, b) for d, n, _, _, b, _ in P.pack_group(rows, 10)), key=str)
        assert got == plain(rows, 10)


def test_documents(spark):
    rng = random.Random(5)
    rows = [(n, " ".join("w" for _ in range(rng.choice([0, 1, 5, 9, 30]))) + f" {n % 50}", rng.choice(["hot", "hot", None, f"s{n}"])) for n in range(400)]
    rows += [(500, None, "hot"), (501, "", None), (502, " \n", "x"), (None, "a b", "y"), (3, rows[3][1], rows[3][2]), (504, "z " * 50_000, "long")]
    got = P.pack_documents(frame(spark, rows).repartition(3), capacity=12, group_rows=64, task_rows=100).collect()
    sizes = {}
    for i, t, s in rows:
        sizes[i] = sizes.get(i, 0) + len((t or "").split())
    words, bins = {}, {}
    for r in got:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
        if r["bin"] is not None:
            bins.setdefault((r["part"], r["bin"]), []).append(r)
    assert words == sizes
    source = {i: s for i, _, s in rows}
    text = {i: t for i, t, _ in rows}
    for held in bins.values():
        assert sum(r["n_words"] for r in held) <= 12
        spans = sorted((r["bin_offset"], r["n_words"]) for r in held)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
        named = [source[r["doc_id"]] for r in held if source[r["doc_id"]] is not None]
        assert len(named) == len(set(named)) and len({text[r["doc_id"]] for r in held}) == len(held)
    assert {r["doc_id"] for r in got if r["bin"] is None} == {500, 501, 502}


def test_near_copies_share_no_bin(spark, monkeypatch):
    from corpusmill.llm import queries

    rng = random.Random(8)
    rows = []
    for g in range(4):
        words = [f"w{g}x{rng.randrange(500)}" for _ in range(100)]
        rows += [(g * 10 + n, " ".join([*words[:-1], f"end{n}"]), None if n % 2 else f"s{n}") for n in range(6)]
    rows += [(100, rows[0][1], None), (None, rows[0][1] + " more", None), (101, "", None), (102, None, "x")]
    monkeypatch.setattr(queries, "read_table", lambda *_: frame(spark, rows))
    got = queries.op9(spark, "").collect()
    assert len(got) == len(rows)
    group = lambda i: 0 if i is None or i == 100 else i // 10
    held = [(r["part"], r["bin"], group(r["doc_id"])) for r in got if r["bin"] is not None]
    assert len(held) == 26 and len(set(held)) == len(held)
    assert len({b[:2] for b in held}) < len(held)


def test_empty_table(spark):
    assert P.pack_documents(frame(spark, [])).count() == 0
