"""Second pass inside contexts, and its place in the answer route."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.config import Settings
from corpusmill.functions.text import STOP_WORDS
from corpusmill.operators import evidence
from corpusmill.operators.embed import hashing_embedder
from corpusmill.plans import ask

CONTEXT = (
    "query_id long, rank int, id string, title string, source string, page string, content string, branch string, score double, bm25_score double, "
    "embedding_score double, rerank_score double, matched_terms array<string>"
)


def context(query, rank, content, title="T", score=2.0, terms=("refund", "days")):
    return (query, rank, f"c{query}-{rank}", title, f"src{rank}", str(rank), content, "b", score, score, 0.6, score, list(terms))


def tokens(text):
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if t not in STOP_WORDS]


def dense_form(text):
    return re.sub(r"\s+", "", text).lower()


def cosine(a, b):
    norm = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / norm) if norm else 0.0


def plain_fine(contexts, question, terms, k=6, groups=3, size=240, overlap=32):
    model, units, want = hashing_embedder(), [], set(tokens(question))
    for rank, content in contexts:
        for s, sentence in enumerate(x.strip() for x in re.split(r"(?<=[。！？；;])\s*", re.sub(r"\s+", " ", content).strip()) if x.strip()):
            starts = [0]
            while starts[-1] + size < len(sentence):
                starts.append(starts[-1] + size - overlap)
            for w, a in enumerate(starts):
                piece = sentence[a : a + size].strip()
                if len(piece) >= 8:
                    units.append((rank, s, w, piece))
    q = model([question])[0].astype(float)
    scored = []
    for i, (rank, s, w, piece) in enumerate(units):
        covered = len(want & set(tokens(piece))) / len(want) if want else 0.0
        phrases = sum(len(dense_form(t)) >= 2 and dense_form(t) in dense_form(piece) for t in terms)
        cues = 0.12 * bool(re.search("不得|應|得|合計|上限|期間|施行|照給|不給", piece)) + 0.15 * bool(re.search(r"[零〇一二兩三四五六七八九十百千萬億\d]+\s*(?:日|天|年|月|小時|%|％)", piece))
        lexical = min(1.0, min(1.0, 1.4 * covered) + min(0.35, 0.08 * phrases) + cues)
        near = cosine(q, model([piece])[0].astype(float))
        scored.append((-round(0.55 * lexical + 0.45 * near, 9), rank, i, s, w, piece, lexical, near))
    kept = []
    for u in sorted(scored):
        lexical, near = u[6:]
        if kept and (near < 0.45 and lexical < 0.35 or lexical < 0.12 and near < 0.53):
            continue
        a = dense_form(u[5])
        if not any(a in (b := dense_form(v[5])) or (b in a and len(b) >= 0.85 * len(a)) for v in kept):
            kept.append(u)
        if len(kept) == k:
            break
    islands = []
    for u in sorted(kept, key=lambda u: (u[1], u[3], u[4])):
        if islands and islands[-1][-1][1] == u[1] and u[3] <= islands[-1][-1][3] + 1:
            islands[-1].append(u)
        else:
            islands.append([u])
    islands.sort(key=lambda g: (min(u[0] for u in g), g[0][1], min(u[2] for u in g)))
    return [(n, g[0][1], " ".join(dict.fromkeys(u[5] for u in g))) for n, g in enumerate(islands[:groups], 1)]


def test_fine_contexts_equal_a_plain_version(spark):
    rng = random.Random(3)
    words = ["refund", "days", "order", "ship", "paid", "late", "fee", "must", "return", "box", "30 日", "上限"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "; ", "。"]) for _ in range(n))
    rows = [context(q, r, say(rng.choice([3, 20, 150])), f"Title {r}") for q in range(6) for r in range(1, 4)]
    rows += [context(7, 1, "short"), context(7, 2, " ")]
    asked = [(q, f"when is the {rng.choice(words)} {rng.choice(words)} paid") for q in range(6)] + [(7, "refund"), (8, "nothing found")]
    contexts, questions = spark.createDataFrame(rows, CONTEXT), spark.createDataFrame(asked, "query_id long, question string")
    terms = {r["query_id"]: r["t"] for r in questions.select("query_id", evidence.question_terms(F.col("question")).alias("t")).collect()}
    got = evidence.fine_contexts(contexts, questions).collect()
    for q, question in asked[:6]:
        own = sorted((r["rank"], r["original_rank"], r["content"]) for r in got if r["query_id"] == q)
        assert own == plain_fine([(r[1], r[6]) for r in rows if r[0] == q], question, terms[q])
    one = next(r for r in got if r["query_id"] == 0 and r["rank"] == 1)
    assert one["id"] == f"c0-{one['original_rank']}::fine-evidence-1" and one["title"] == f"Title {one['original_rank']} / fine evidence"
    assert one["source"] == f"src{one['original_rank']}" and one["page"] == str(one["original_rank"]) and one["matched_terms"] == list(dict.fromkeys(tokens(one["content"])))[:20]
    # Nothing to cut: the contexts stay.
    assert sorted((r["rank"], r["id"], r["content"]) for r in got if r["query_id"] == 7) == [(1, "c7-1", "short"), (2, "c7-2", " ")]
    assert not [r for r in got if r["query_id"] == 8]


def test_focus_contexts_keep_their_names(spark):
    rows = [context(1, 1, "The refund is paid after 30 days; shipping is free。 Boxes are blue。"), context(1, 2, "A refund needs a box。"), context(2, 1, "tiny")]
    questions = spark.createDataFrame([(1, "when is the refund paid"), (2, "tiny")], "query_id long, question string")
    got = evidence.focus_contexts(spark.createDataFrame(rows, CONTEXT), questions).orderBy("query_id", "rank").collect()
    best = got[0]
    assert "refund is paid" in best["content"] and best["id"] == "c1-1::focus-1" and best["title"] == "T / evidence focus" and "refund" in best["matched_terms"]
    assert best["score"] >= got[1]["score"] and 0 <= best["embedding_score"] <= 1 and got[-1]["id"] == "c2-1"


@pytest.mark.parametrize("settings", [Settings(), Settings(fine_evidence_enabled=True), Settings(evidence_focus_enabled=True)])
def test_gate_keeps_the_better_contexts(spark, settings):
    rows = [context(1, 1, "The refund is paid after 30 days; shipping is free。" * 3), context(2, 1, "Unrelated words about nothing at all。", terms=("alpha", "beta"))]
    questions = spark.createDataFrame([(1, "refund paid days"), (2, "gamma delta"), (3, "no contexts")], "query_id long, question string")
    contexts, gate = ask.refined(questions, spark.createDataFrame(rows, CONTEXT), settings.normalized())
    judged = {r["query_id"]: r["sufficient"] for r in gate.collect()}
    assert judged == {1: True, 2: True, 3: False}  # what was sufficient as retrieved stays so
    found = {r["query_id"]: r["id"] for r in contexts.where("rank = 1").collect()}
    refined = settings.fine_evidence_enabled or settings.evidence_focus_enabled
    assert found[2] == "c2-1" and (("::" in found[1]) == refined)
