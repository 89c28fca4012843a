from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.operators import chunking as C


def pieces(spark, text, size, **options):
    df = spark.createDataFrame([(1, text)], "id long, t string")
    return C.split_text(df, "t", size, **options).first()["pieces"]


def test_hard_split(spark):
    assert pieces(spark, "abcdefghij", 4, strategy="hard") == ["abcd", "efgh", "ij"]


def pack(sizes, budget, overlap):
    """Greedy packing by the written rule, used as brute force."""
    windows, first = [], 0
    while first < len(sizes):
        last = first + 1
        while last < len(sizes) and sum(sizes[first:last]) < budget and sum(sizes[first : last + 1]) <= budget:
            last += 1
        windows.append((first, last))
        if last >= len(sizes):
            break
        start = last
        while start - 1 >= first and sum(sizes[start - 1 : last]) <= overlap:
            start -= 1
        first = last if overlap <= 0 or start == last else max(first + 1, min(start, last - 1))
    return windows


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=12), st.integers(6, 10), st.integers(0, 5))
def test_packing_against_brute_force(sizes, budget, overlap):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(sizes,)], "n array<int>")
    got = df.select(C._pack("n", F.lit(budget), F.lit(overlap)).alias("w")).first()["w"]
    assert [(w["first"], w["last"]) for w in got] == pack(sizes, budget, overlap)


def test_dynamic_chunks_carry_whole_sentences(spark):
    text = "".join(ch * 29 + "。" for ch in "甲乙丙")
    got = pieces(spark, text, 65, strategy="dynamic", overlap_tokens=31)
    assert [p.count("。") for p in got] == [2, 2]
    assert got[0].endswith("乙" * 29 + "。") and got[1].startswith("乙")


def test_long_sentence_loses_blanks(spark):
    got = pieces(spark, "aa bb cc dd ee", 2, strategy="dynamic", overlap_tokens=0)
    assert got == ["aabb", "ccdd", "ee"] or got[0] == "aabb\nccdd"


def test_boundary_prefers_line_ends(spark):
    text = "x" * 70 + "\n" + "y" * 60
    assert pieces(spark, text, 100, stride=100, strategy="boundary") == ["x" * 70, "y" * 60]


def test_parent_child_links_and_budgets(spark):
    text = " ".join(f"Sentence number {i} talks about topic {i % 3}." for i in range(60))
    units = spark.createDataFrame([("s", "file.txt", 1, "Part", "", text)], "source_id string, filename string, unit_index int, title string, page string, content string")
    parents, children = C.parent_child(units, 100, 30)
    p = {r["parent_id"]: r for r in parents.collect()}
    kids = children.collect()
    assert len(p) > 1 and all(r["token_count"] <= 100 for r in p.values()) and all(k["token_count"] <= 30 for k in kids)
    assert all(line in p[k["parent_id"]]["content"] for k in kids for line in k["content"].split("\n"))
    assert {k["parent_title"] for k in kids} == {"file"} and all(r["title"].startswith("file.txt | Part / parent ") for r in p.values())


def test_markdown_sections(spark):
    md = "lost\n## Top\nskip\n### A\none\ntwo\n### B\n## Other\n### C\nthree"
    rows = C.markdown_sections(spark.createDataFrame([("k", md)], "k string, t string"), "k", "t").orderBy("line_no").collect()
    assert [(r["parent_title"], r["title"], r["content"]) for r in rows] == [("Top", "A", "one\ntwo"), ("Other", "C", "three")]


def test_delimited_sections_skip_footers(spark):
    text = "=== One ===\na\n========= end =========\nb\n=== Two ===\nc"
    rows = C.delimited_sections(spark.createDataFrame([("k", text)], "k string, t string"), "k", "t").orderBy("line_no").collect()
    assert [(r["title"], r["content"]) for r in rows] == [("One", "a\nb"), ("Two", "c")]


def test_narrative_sections_and_routing(spark):
    text = "書名\n作者\n第一章 開始\n內容甲\n【二】\n內容乙"
    files = spark.createDataFrame(
        [("/kb/a.txt", text), ("/kb/b.txt", "plain words only"), ("/kb/c.md", "## P\n### S\nbody"), ("/kb/d.txt", "=== T ===\nz")], "path string, text string"
    )
    rows = C.narrative_sections(files.filter("path = '/kb/a.txt'"), "path", "text").orderBy("line_no").collect()
    assert [r["title"] for r in rows] == ["文件開頭 / metadata", "第一章 開始", "【二】"]
    routed = {(r["path"], r["parent_title"]) for r in C.knowledge_base_sections(files).collect()}
    assert routed == {("/kb/a.txt", "Narrative Text"), ("/kb/b.txt", "Plain Text"), ("/kb/c.md", "P"), ("/kb/d.txt", "d")}


def test_sized_sections_number_parts(spark):
    sections = spark.createDataFrame([("k", 1, "P", "T", "abcdefghij"), ("k", 2, "P", "U", "xy")], "k string, line_no int, parent_title string, title string, content string")
    rows = C.sized_sections(sections, "k", 4, 4, strategy="hard").orderBy("chunk_index").collect()
    assert [r["title"] for r in rows] == ["T / part 1", "T / part 2", "T / part 3", "U"]
    assert [r["chunk_id"] for r in rows] == [f"k::{i}" for i in range(4)]


def test_token_windows_keep_the_tail(spark):
    df = spark.createDataFrame([(list("abcdefg"),), ([],)], "t array<string>")
    rows = [r[0] for r in df.select(C.token_windows(F.col("t"), 4, 1)).collect()]
    assert [(w["start"], "".join(w["tokens"])) for w in rows[0]] == [(0, "abcd"), (3, "defg"), (6, "g")]
    assert [(w["start"], w["tokens"]) for w in rows[1]] == [(0, [])]
