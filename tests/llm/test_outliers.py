"""Robust outliers: base statistics and estimates against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import outliers as O

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, x0 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), len(lines)


def failed(c):
    return c[0] < 20 or 100 * c[4] > 30 * c[0]


def vector(c):
    share = lambda a, b: math.sqrt(a / max(b, 1))
    return [math.log(max(c[0], 1)), math.log(max(c[1], 1) / max(c[0], 1)), share(c[2], c[1]), share(c[3], c[5]), share(c[4], c[0])]


def squared(x, m, cov):
    z = np.linalg.solve(np.linalg.cholesky(cov + np.diag(np.square(O.FLOORS))), (x - m).T)
    return (z * z).sum(0)


def moments(x, w, factor):
    m = (w[:, None] * x).sum(0) / w.sum()
    return m, factor * ((w[:, None] * x).T @ x / w.sum() - np.outer(m, m))


def logdet(cov):
    return np.linalg.slogdet(cov + np.diag(np.square(O.FLOORS)))[1]


def step(x, m, cov):
    kind = np.floor(np.log2(squared(x, m, cov) + 1e-9) * O.CLASSES)
    below, half, w = 0, math.ceil(len(x) * O.HALF), np.zeros(len(x))
    for k in sorted(set(kind)):
        here = kind == k
        w[here] = min(1, max(0, (half - below) / here.sum()))
        below += here.sum()
    return moments(x, w, O.consistency(O.HALF))


def estimate(x):
    lower = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    m = lower(x)
    d = 1.4826 * lower(np.abs(x - m)) + np.array(O.FLOORS)
    z = (x - m) / d
    tries = []
    for s in (np.tanh(z), z / np.sqrt((z * z).sum(1) + 1e-12)[:, None], None):
        shape = np.eye(O.DIMS)
        if s is not None:
            t = s.T @ s / len(x)
            shape = t / np.sqrt(np.outer(np.diag(t) + 1e-6, np.diag(t) + 1e-6))
            np.fill_diagonal(shape, 1)
        tries.append(step(x, *step(x, m, shape * np.outer(d, d))))
    now = min(tries, key=lambda e: logdet(e[1]))
    while True:
        then = step(x, *now)
        if logdet(then[1]) >= logdet(now[1]) - O.STEADY:
            break
        now = then
    return moments(x, (squared(x, *now) <= O.NEAR).astype(float), O.consistency(0.975)), (squared(x, *now) <= O.NEAR).sum()


def distances(rows):
    """``{doc_id: squared distance}`` of ``(doc_id, text, lang, source)`` rows that pass the base rules."""
    held = [(i, lang, source, vector(c)) for i, t, lang, source in rows if not failed(c := counts(t))]
    out = {}
    for lang in {h[1] for h in held}:
        (m0, c0), _ = estimate(np.array([h[3] for h in held if h[1] == lang]))
        for source in {h[2] for h in held if h[1] == lang}:
            own = [h for h in held if h[1:3] == (lang, source)]
            x = np.array([h[3] for h in own])
            (m, c), n = estimate(x)
            a = n / (n + O.PRIOR_ROWS)
            for h, d in zip(own, squared(x, a * m + (1 - a) * m0, a * c + (1 - a) * c0)):
                out[h[0]] = d
    return out


def text(rng, n, junk=False):
    vocabulary = [f"{'#&' if junk else 'w'}{rng.randrange(10 ** rng.randint(1, 5))}" for _ in range(max(n, 1))]
    return "".join(w + rng.choice(["  ", " ", "\n", "\t"]) for w in vocabulary[:n])


def rows_of(rng, n):
    rows = []
    for i in range(n):
        junk = i % 3 == 0
        rows.append((i, text(rng, rng.choice([10, 25, 80, 300]), junk), rng.choice(["en", "de", None]), "hot" if i % 2 else rng.choice(["a", "b", None])))
    rows += [(n, None, "en", "a"), (n + 1, "", None, None), (n + 2, " \n\t", "en", "hot"), (n + 3, "same line of eight or more words here\n" * 40, "en", "hot")]
    once = text(rng, 200)
    rows += [(n + 4, once + once[:300], "de", "a"), (n + 5, once, "xx", "only"), (n + 6, once + " tail", "xx", "only")]
    return rows


def test_constants():
    assert O.CUTOFF == pytest.approx(25.7448, abs=1e-3) and O.NEAR == pytest.approx(12.8325, abs=1e-3)
    assert O.chi2_cdf(O.chi2_quantile(0.5, 5), 5) == pytest.approx(0.5)


def test_base_statistics(spark):
    rng = random.Random(6)
    rows = rows_of(rng, 60) + [(500 + k, " ".join(rng.choice("ab") for _ in range(rng.randrange(40))), "en", "a") for k in range(200)]
    rows += [(900, "x " * 30_000 + "end", "en", "a"), (901, "".join(f"{k} " for k in range(40_000)), "en", "a")]
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["n_lines"], r["base_failed"]) for r in O.statistics(frame(spark, rows)).collect()}
    assert got == {i: (*counts(t), failed(counts(t))) for i, t, *_ in rows}


def test_distances_equal_a_plain_version(spark):
    rows = rows_of(random.Random(7), 240)
    got = O.judge_documents(frame(spark, rows + [rows[5]]).repartition(3)).collect()
    assert len(got) == len(rows) + 1
    want = distances(rows + [(-1, *rows[5][1:])])
    for r in got:
        if r["base_failed"]:
            assert r["distance"] is None and not r["kept"]
        else:
            assert r["distance"] == pytest.approx(want[r["doc_id"]], rel=1e-6, abs=1e-9) and r["kept"] == (r["distance"] <= O.CUTOFF)
    # A third of junk does not move the estimates.
    good = [r for r in got if not r["base_failed"] and r["doc_id"] < 240]
    assert all(r["kept"] == bool(r["doc_id"] % 3) for r in good)


def test_large_estimates_take_the_salted_join(spark, monkeypatch):
    rows = rows_of(random.Random(9), 90)
    small = {(r["doc_id"], r["kept"], r["distance"] and round(r["distance"], 6)) for r in O.judge_documents(frame(spark, rows)).collect()}
    monkeypatch.setattr(O, "BROADCAST_LIMIT_BYTES", 0)
    monkeypatch.setattr(O, "STARTS", 1)
    assert small == {(r["doc_id"], r["kept"], r["distance"] and round(r["distance"], 6)) for r in O.judge_documents(frame(spark, rows)).collect()}


def test_no_python_workers(spark):
    plan = O.judge_documents(frame(spark, rows_of(random.Random(1), 30)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert O.judge_documents(frame(spark, [])).count() == 0
    assert O.judge_documents(frame(spark, [(1, "few words", "en", "a")])).count() == 1
