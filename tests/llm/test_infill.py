"""Fill-in-middle: tokens, skip-list ranks, forms, exact round trips."""

import hashlib
import random
import re

import numpy as np

from corpusmill.llm import infill as I

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, output string, form string"


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_tokens_and_every_rank():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(" \t\n\x0bab　é𝒳\x1c<P>") for _ in range(rng.randrange(40)))
        tokens = TOKEN.findall(text)
        assert I.token_chars(text).tolist() == [len(t) for t in tokens]
        lanes = I.SkipList(I.token_chars(text)) if tokens else None
        assert all(lanes.offset(k) == len("".join(tokens[:k])) for k in range(len(tokens) + 1) if tokens)


def test_long_list_has_short_express_lanes():
    chars = np.random.default_rng(0).integers(1, 20, 100_000)
    lanes = I.SkipList(chars)
    assert 6 <= len(lanes.units) <= 14 and len(lanes.units[-1]) == 1
    assert all(int(u.sum()) == len(chars) and int(p.sum()) == int(chars.sum()) for u, p in zip(lanes.units, lanes.points))
    ends = np.concatenate([[0], np.cumsum(chars)])
    assert all(lanes.offset(k) == ends[k] for k in [*range(0, 100_000, 997), 99_999, 100_000])


def test_documents(spark):
    rng = random.Random(4)
    rows = [(n, " ".join(rng.choice(["wort", "été", "x", "<", ">", "S>", "\n\t"]) for _ in range(rng.randrange(30)))) for n in range(300)]
    rows += [(None, "a b c"), (7, rows[7][1]), (301, None), (302, ""), (303, " \n"), (304, "has <S> in it"), (305, "wide 𝒳 " * 60_000)]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in I.infill_documents(df).collect()), key=str)
    assert got == sorted(((i, *plain(i, t)) for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    text_of = {i: t or "" for i, t in rows}
    for r in I.infill_digest(df).collect():
        assert r["restored_sha256"] == hashlib.sha256(text_of[r["doc_id"]].encode()).hexdigest()


def test_empty_table(spark):
    assert I.infill_digest(spark.createDataFrame([], SCHEMA)).count() == 0
