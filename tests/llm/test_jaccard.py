"""Jaccard join against brute force, with copies, near copies and every border case."""

import random
import re

import numpy as np
import pytest

from corpusmill.llm import jaccard as J

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def sets_of(rows):
    out = []
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    return out


def brute(rows):
    sets = sets_of(rows)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(least.get(find(n), i), i)
    return sorted((i, len(s), least[find(n)]) for n, (i, s) in enumerate(sets))


def corpus(seed=3, bases=12, copies=9):
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(400)]
    passage = [rng.choice(words) for _ in range(45)]
    rows = []
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.choice([6, 12, 40, 60, 80, 150]))]
        if rng.random() < 0.5:
            base = passage + base[:12]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text))
    rows += ["", None, "  \t", "one two", "One TWO", "one two three", "É à é", "é à é", " x"] * 2
    rng.shuffle(rows)
    return [(n * 7 % 1009, t) for n, t in enumerate(rows)]


@pytest.mark.parametrize("frequent", [2, 4, 256])
def test_equals_brute_force(spark, frequent):
    rows = corpus()
    found = sorted(tuple(r) for r in J.near_copy_components(frame(spark, rows).repartition(3), frequent=frequent).collect())
    assert found == brute(rows)


def test_entries_keep_every_similar_pair():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(2, 120))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        keep = np.sort(rng.permutation(len(x))[: max(1, int(len(x) * rng.uniform(0.8, 1)))])
        y = np.unique(np.concatenate([x[keep], rng.integers(0, 1 << 62, int(rng.integers(0, 8))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 75 * (len(x) + len(y) - both) or len(x) == len(y) == 1:
            continue
        kind = lambda g: (g % np.uint64(3)).astype(np.int8)
        a, b = J.index_entries(x, kind(x), 75), J.index_entries(y, kind(y), 75)
        common, at_x, at_y = np.intersect1d(a[0], b[0], return_indices=True)
        assert len(common)
        # The position filter must let the pair pass in one of the entries.
        left = np.minimum(len(x) - a[1][at_x], len(y) - b[1][at_y])
        assert (175 * left >= 75 * (len(x) + len(y))).any()


def test_a_large_group_of_near_copies_makes_few_pairs(spark):
    rng = random.Random(5)
    base = [f"b{n}" for n in range(60)]
    rows = [(0, " ".join(base))]
    for n in range(1, 400):
        text = list(base)
        text[rng.randrange(60)] = f"x{n}"
        rows.append((n, " ".join(text)))
    sets = J.stage(J.shingle_sets(frame(spark, rows), 5), "t")
    bits = spark.sparkContext.broadcast(J.class_bits(sets, 256))
    index = J.shared_entries(J.postings(sets, bits, J.repeated_entries(sets, bits, 75), 75))
    assert index.count() < 400 * 400
    assert {r["component_id"] for r in J.near_copy_components(frame(spark, rows)).collect()} == {0}


def test_parity_bits_bound_the_common_part():
    rng = np.random.default_rng(4)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 3000))).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(0, 1 << 62, int(rng.integers(0, 900))).astype(np.uint64)]))
        differ = int(np.unpackbits(J.parity(x) ^ J.parity(y)).sum())
        assert len(np.intersect1d(x, y)) <= (len(x) + len(y) - differ) // 2


def test_empty_tables_and_null_ids(spark):
    assert J.near_copy_components(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)]
    found = [tuple(r) for r in J.near_copy_components(frame(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 0, None)], key=str)


def test_drop_keeps_columns_and_one_of_each(spark):
    rows = corpus(seed=8)
    docs = frame(spark, rows)
    kept = J.drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = sorted(i for i, _, c in brute(rows) if i == c)
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(60)] + [(100, 200)], "a long, b long")
    found = {r["node"]: r["comp"] for r in J.components(links).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100}


def test_components_cut_short_fail(spark):
    import pytest

    from corpusmill.llm import jaccard

    chain = spark.createDataFrame([(n, n + 1) for n in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        jaccard.components(chain, limit=1)
    assert {r["comp"] for r in jaccard.components(chain).collect()} == {0}


def test_parity_bits_tell_large_sets_apart():
    rng = np.random.default_rng(9)
    for n in (40, 700, 6000, 20000):
        x, y = (np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64)) for size in (n, int(n * 0.8)))
        for k in (0, n // 3, n // 2):
            z = np.unique(np.concatenate([y, x[:k]]))
            tables = [np.frombuffer(J.parity(g, J.parity_bits(len(g))).tobytes(), np.uint8)[None, :] for g in (x, z)]
            both, common = len(x) + len(z), len(np.intersect1d(x, z))
            bound = (both - int(J.differing(*tables)[0])) // 2
            assert common <= bound
            assert k == n // 2 or 100 * bound < 75 * (both - bound)  # ruled out without its sets
    assert J.differing(tables[1], tables[0])[0] == J.differing(*tables)[0]


def test_entries_of_two_sets_are_settled_by_their_heads(spark):
    rows = [(1, 0, 9, 7), (1, 0, 9, 8), (2, 0, 9, 7), (2, 1, 9, 8), (2, 2, 9, 9), (3, 0, 9, 5), (3, 0, 9, 5), (4, 0, 9, 6), (5, 1, 9, 1), (5, 1, 9, 2)]
    postings = spark.createDataFrame(rows, J.POSTINGS).coalesce(1)
    found = {(r["entry"], r["key"]): r["more"] for r in J.shared_entries(postings).collect()}
    assert set(found) == {(1, 7), (1, 8), (2, 7), (2, 8), (2, 9), (5, 1), (5, 2)}
    assert all(found[2, k] for k in (7, 8, 9)) and not all(found[e, k] for e, k in ((1, 7), (1, 8), (5, 1), (5, 2)))


def test_words_of_bytes_are_those_of_the_contract():
    text = "\x1cA\x85b\u00a0C\td\x0be\x0cF\r\n G\x1fh É\u2003İ \x00 z"
    assert [w.decode() for w in J._split(text.encode())] == re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    assert J._split(None) == []


def test_clusters_come_with_words_from_one_pass(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(J, "shingle_sets", lambda *a, f=J.shingle_sets, **b: passes.append(1) or f(*a, **b))
    rows = corpus(seed=4)
    got = J.sized_clusters(frame(spark, rows).repartition(3)).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, len((t or "").encode().split())) for i, t in rows)
    groups = {}
    for r in got:
        groups.setdefault(r["cluster"], set()).add(r["doc_id"])
    want = {}
    for i, n, c in brute(rows):
        want.setdefault(c if n else None, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) and passes == [1]


def test_wide_rows_travel_in_bounded_pieces(spark, monkeypatch):
    import glob

    import pyarrow as pa
    import pyarrow.parquet as pq

    from corpusmill import session

    rng = random.Random(11)
    rows = [(n, " ".join(str(rng.getrandbits(40)) for _ in range(3000))) for n in range(900)]
    docs = frame(spark, rows).coalesce(1)
    keys = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before, seen, write = [spark.conf.get(k) for k in keys], [], J.stage

    def watched(df, name, *more):
        seen.append((name, tuple(spark.conf.get(k) for k in keys)))
        out = write(df, name, *more)
        if name == "sets":
            files = [f for p in out.inputFiles() for f in glob.glob(p.removeprefix("file://"))]
            groups = [m.row_group(k).total_byte_size for m in map(pq.read_metadata, files) for k in range(m.num_row_groups)]
            assert sum(groups) > 20_000_000 and max(groups) < 16_000_000

            def sizes(batches):
                for b in batches:
                    yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([sum(map(len, b.column(0).to_pylist()))])], ["n", "size"])

            told = out.where("kind = 0").select("grams").mapInArrow(sizes, "n long, size long").collect()
            assert sum(r["n"] for r in told) == len(rows) and max(r["size"] for r in told) < 4_000_000
        return out

    monkeypatch.setattr(J, "stage", watched)
    assert {(r["doc_id"], r["component_id"]) for r in J.near_copy_components(docs).collect()} == {(n, n) for n in range(900)}
    assert {values for _, values in seen} == {(str(session.WIDE_BATCH_BYTES), str(session.WIDE_READ_ROWS))}
    assert [spark.conf.get(k) for k in keys] == before


def test_classes_of_a_batch_equal_those_of_each_set():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    bits = tuple(rng.integers(0, 1 << 32, 1 << (J.CLASS_BITS - 5), dtype=np.uint64).astype(np.uint32) for _ in range(2))
    grams = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (1, 300, 0, 7)]
    column = pa.array([g.tobytes() for g in grams], pa.binary())
    for part, expected in ((column, grams), (column.slice(1, 2), grams[1:3]), (column.slice(0, 0), [])):
        found = list(J.classified(part, bits))
        assert len(found) == len(expected)
        for (g, kinds), e in zip(found, expected):
            assert (g == e).all() and (kinds == J.classes(e, bits)).all()
