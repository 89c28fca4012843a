"""The pipeline over small tables against what each stage must do."""

import random

import pytest

import corpus_pipeline as C

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["the", "an", "ti", "on", "er", "st", "re"]) for _ in range(rng.randint(2, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs, labels, want = [], [], {}
    for i in range(300):
        text, toxic = prose(rng.randint(20, 80)), i % 5 == 0
        if toxic:
            text += " gromblick plumpfig " + rng.choice(["gromblick", "sneverly"])
        docs.append((i, text))
        labels.append((i, 1, int(toxic)))
        want[i] = "toxic" if toxic else None
    item = prose(40)
    halves = item.split()
    base = prose(120).split()
    for k in range(5):  # near copies of 1000
        copy = list(base)
        copy[k * 20] = "changed"
        docs.append((1000 + k, " ".join(copy)))
        want[1000 + k] = "copy" if k else None
    for i, text, why in (
        (2000, docs[1][1], "copy"), (2001, f"{prose(10)} {item} {prose(10)}", "leak"), (2002, " ".join(halves[20:]) + " and then " + " ".join(halves[:20]), "leak"),
        (2003, prose(15) + " gr0mbl!ck " + prose(5), "toxic"), (2004, prose(30) + " password=abcdefghijklmnop " + prose(3), None), (2005, None, None), (2006, "", None), (2007, prose(5000), None),
    ):
        docs.append((i, text))
        want[i] = why
    docs.append((7, docs[7][1]))  # a repeated row
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i}", len(t) if t is not None else None, "kept") for i, t in docs]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(docs), want


def test_stages(spark, tables):
    folder, texts, want = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, gone = docs.columns, set()
    for (name, step), why in zip(C.STAGES[:3], ("toxic", "copy", "leak")):
        docs = C.stage(step(spark, docs, folder), name)
        gone |= {i for i, w in want.items() if w == why}
        assert docs.columns == columns
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(ids) == set(want) - gone, name
    assert len(ids) == len(set(ids))
    docs = C.stage(C.mask_secrets(spark, docs, folder), "secrets")
    masked = {r["doc_id"]: r for r in docs.collect()}
    assert docs.columns == columns and set(masked) == set(ids)
    for i, r in masked.items():
        assert (r["text"] == texts[i]) == (i != 2004) and r["extra"] == "kept"
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)
    assert "[SECRET]" in masked[2004]["text"] and "abcdefghijklmnop" not in masked[2004]["text"]
    packed = C.pack(spark, docs, folder).collect()
    words = {}
    for r in packed:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
    assert words == {i: len((r["text"] or "").split()) for i, r in masked.items()}


def test_run_is_the_stages_in_order(spark, tables):
    folder, _, want = tables
    got = C.run(spark, folder)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {i for i, w in want.items() if w is None}
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_copies", "decontamination", "secrets", "packing"]


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
