"""Prefix trie: contracted runs and whole tables against plain tries."""

import hashlib
import random
import zlib

import pytest

from corpusmill.llm import prefixtrie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth string, part string"


def digest(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def plain(sequences):
    """Nodes of ``{conv_id: [(label, chars)]}`` by plain dictionaries."""
    nodes, kids = {}, {}
    for conv, seq in sequences.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(conv)
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)

    def total(key):
        saved, leaves = ((len(nodes[key]) - 1) * key[-1][1] if key else 0), 0
        for kid in kids.get(key, []):
            s, n = total(kid)
            saved, leaves = saved + s, leaves + n
        return saved, leaves or 1

    out = []
    for key, members in nodes.items():
        saved, leaves = total(key)
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), len(kids.get(key, [])), leaves, saved, digest(c for c in members if len(sequences[c]) == len(key))))
    return sorted(out, key=str)


def test_contracted_runs_equal_a_plain_trie(monkeypatch):
    rng = random.Random(2)
    for _ in range(400):
        monkeypatch.setattr(P, "FAN", rng.choice([1, 2, 3]))
        sequences = {c: [(x := rng.choice("abc"), ord(x) - 90) for _ in range(rng.randrange(6))] for c in rng.sample(range(-50, 100), rng.randint(1, 40))}
        same = {}
        for conv, seq in sequences.items():
            same.setdefault(tuple(seq), []).append(conv)
        paths = [P.Path([d for d, _ in k], [c for _, c in k], {len(k): P.Sums(len(same[k]), min(same[k]), 0, 0, 0, digest(same[k]))}) for k in sorted(same, key=lambda k: [d for d, _ in k])]
        step, rows, held = rng.choice([1, 2, 5, 30]), [], []
        for i in range(0, len(paths), step):
            for made, kept in P.contract(paths[i : i + step], rng.choice([1, 5, 10])):
                rows, held = rows + made, held + kept
        made, kept = P.merge_run(held, True, True)
        rows += made
        named = {r[9]: r[0] for r in rows if r[9]}
        got = sorted(((r[0], r[1], named[r[8]] if r[8] else r[2], *r[3:8]) for r in rows), key=str)
        assert not kept and got == plain(sequences)


def rebuilt(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, key, len(text)))
    own = {c: [(k, n) for *_, k, n in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


@pytest.mark.parametrize("run_turns, fan", [(200_000, 64), (20, 2)])
def test_table_equals_a_plain_trie(spark, run_turns, fan):
    rng = random.Random(3)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "é𝒳", "long " * 50]))
    rows = [(c, t, *say()) for c in rng.sample(range(-130, 500), 160) for t in range(rng.choice([1, 2, 3, 8]))]
    rows += [(c, t, "user", "same") for c in range(500, 560) for t in range(7)]
    rows += [(600, None, "user", "x"), (600, None, "user", None), (600, 1, "user", "x"), (600, 1, "user", "x"), (None, 1, "user", "left out"), (601, 0, "user", "y " * 100_000)]
    rows += [(602, t, "user", f"deep {t}") for t in range(1500)]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in P.build_trie(frame, run_turns, fan).collect()), key=str)
    import sys

    depth = sys.getrecursionlimit()
    sys.setrecursionlimit(10_000)
    try:
        assert got == plain(rebuilt(rows))
    finally:
        sys.setrecursionlimit(depth)


def test_empty_table(spark):
    assert P.build_trie(spark.createDataFrame([], SCHEMA)).count() == 0
