"""Deobfuscation, scores and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np

from corpusmill.llm import toxicity as T

DOCS = "doc_id long, text string, lang string, score string"
LABELS = "doc_id long, quality int, toxic int"
BAD = ["gromblick", "zantwort", "plumpfig", "sneverly"]


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    syllables = ["the", "an", "ti", "on", "er", "st", "re", "ing", "ou", "ly", "ha", "nd"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words), "en", "clash"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy_and_disguises(spark):
    docs, labels = corpus()
    truth = {i: t for i, _, t in labels}
    hidden = {
        9001: "the on gr0mbl1ck er", 9002: "so z a n t w o r t on", 9003: "plummmmpfig", 9004: "s.n.e.v.e.r.l.y ting", 9005: "GROMBL!CK!!", 9006: "sn€v€rly", 9007: "the p-l-u-m-p-f-i-g", 9008: "gro*mbl*ick",
    }
    clean = {9101: "the 3 houses 2nd 4ever", 9102: "a b c d e f g", 9103: "looooong", 9104: "x" * 300_000, 9105: "th " * 100_000, 9106: "@@@ $$$ ###", 9107: "f00 b4r 0x1F"}
    extra = [(i, t, "en", "c") for i, t in {**hidden, **clean}.items()] + [(9201, None, None, None), (9202, "", "en", "c"), (None, "the on", "en", "c"), (5, docs[5][1], "en", "c")]
    rows = T.score_documents(*frames(spark, docs + extra, labels + [(None, 1, 1), (3, None, None), (5, 1, truth[5])])).collect()
    assert len(rows) == len(docs) + len(extra)
    score = {r["doc_id"]: r["score"] for r in rows}
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["doc_id"] in truth and r["held_out"]:
            assert r["predicted"] == truth[r["doc_id"]]
    assert all(score[i] >= 0.7 for i in hidden) and all(score[i] < 0.7 for i in clean)
    assert score[9201] == score[9202] == T.LOWEST
    kept = T.drop_toxic(*frames(spark, docs + extra, labels))
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in score.items() if s < 0.7}


def test_disguises_of_any_length(spark):
    docs, labels = corpus()
    hidden = {
        9001: "the on gr" + "o" * 90 + "mblick er", 9002: "the_on_er_such_ting_on_gr0mbl1ck_the_an_tion_er_ly", 9003: "the/on/er/ting/ha/nd/on/ly/er/z4ntw0rt/the/an/tion/er/ly/ou", 9004: "9r0m8l1ck",
        9005: "on zzanttwortt", 9006: "ppluummppffiigg on", 9007: "z - a - n - t - w - o - r - t on", 9008: "the s   n   e   v   e   r   l   y ting", 9009: "p\tl\tu\tm\tp\tf\ti\tg", 9010: "!d 9r0m8l1(k",
    }
    clean = {9101: "x" * 300_000, 9102: "a - b - c - d - e", 9103: "ab" * 60_000, 9104: "a" + " " * 200_000 + "b", 9105: "_" * 100_000, 9106: "3 . 4 . 5 . 6", 9107: "2024 1000 $450"}
    extra = [(i, t, "en", "c") for i, t in {**hidden, **clean}.items()]
    score = {r["doc_id"]: r["score"] for r in T.score_documents(*frames(spark, docs + extra, labels)).collect()}
    assert [i for i in hidden if score[i] < 0.7] == [] and [i for i in clean if score[i] >= 0.7] == []


def test_signs_at_the_edge_and_tokens_with_few_letters():
    for token in ("1d107", "!d!07", "iddiot", "ssttuuppiidd", "@$$", "s" + "t" * 45 + "upid"):
        assert T.suspicious(token), token
    for token in ("2024", "idiot", "###", "http://a1b2"):
        assert not T.suspicious(token), token
    assert T.SPACED.search("m - o - r - o - n") and T.SPACED.search("m   o   r   o   n")


def test_a_cut_makes_no_words():
    flat = np.zeros((32, 32, 32)).tolist()
    scorer = T.TextScorer({"gromb": 1.0}, np.array(flat))
    token = "".join(chr(97 + n % 7) + "q" for n in range(37)) + "!gromb" + "elquist" * 20  # the first piece ends after gromb
    assert token[:80].endswith("gromb") and scorer.decoded(token) == 0.0


def test_labels_held_out_are_not_read(spark):
    docs, labels = corpus()
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (sorted(map(tuple, T.score_documents(*frames(spark, docs, x)).collect())) for x in (labels, turned))
    assert a == b


def test_copies_are_no_evidence(spark):
    docs, labels = corpus()
    text = docs[0][1] + " singularword"
    copies = [(5000 + n, text + f" {'abc'[n % 3]}", "en", "c") for n in range(60)]
    found = T.markers(*frames(spark, docs + copies, labels + [(i, 1, 1) for i, *_ in copies]))
    assert found.get("singularword", 0) < 0.7 and all(found[w] > 0.7 for w in BAD)


def test_best_reading_equals_all_paths():
    """The search against every path of a short lattice."""
    rng = np.random.default_rng(0)
    table = np.log(rng.dirichlet(np.ones(32), (32, 32))).astype(np.float32).tolist()

    def score(token, path):
        total, a, b, run = 0.0, 0, 0, 1
        for at, (sign, letter) in enumerate(zip(token, path)):
            if not sign.isalpha():
                total += (T.GAP if not letter else T.GAP * 3 if letter == " " else T.SWAP) if sign in T.GAPS else T.SWAP if letter.isalpha() else T.KEEP
            elif not letter:
                total += T.DOUBLE
            if letter:
                code = int(T.CODES[ord(letter)])
                total += table[a][b][code]
                a, b = b, code
        return total + table[a][b][0]

    for token in ("1d0t", "a.b", "p@ss", "x1|y", "b0-o"):
        options = []
        for at, sign in enumerate(token):
            here = [sign] if sign.isalpha() else [*T.LOOKALIKE.get(sign, ""), " "] + ([""] if sign in T.GAPS else [])
            options.append(here + ([""] if at and token[at - 1] == sign and sign.isalpha() else []))
        best = max(itertools.product(*options), key=lambda p: score(token, p))
        assert T.readings(token, table)[0] == "".join(best)


def test_without_labels_and_empty(spark):
    docs, labels = corpus(20)
    assert {r["score"] for r in T.score_documents(*frames(spark, docs, [])).collect()} == {T.LOWEST}
    assert T.score_documents(*frames(spark, [], labels)).count() == 0
