"""Chunk generators: one document row in, many chunk rows out.

Splitting happens inside the row with array expressions; only the two rules
whose next window depends on the previous one (greedy token packing and
boundary windows) use an Arrow helper.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpusmill.functions.arrowtext import bounded
from corpusmill.functions.text import char_windows, clean_spaces, let, normalize_extracted, strip, text_of
from corpusmill.session import stage

WINDOWS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
PIECES = T.StructType([T.StructField("content", T.ArrayType(T.StringType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
STRATEGIES = ("boundary", "hard", "dynamic")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Heading rules of the text formats.
SECTION_HEADING = r"(?U)^={3,}\s*\S.*?\s*={3,}$"
SECTION_FOOTER = r"^={8,}.*={8,}$"
NARRATIVE_HEADING = (
    r"(?U)^\d{1,3}[.．]\s*\S.{0,80}$"
    r"|^【[^】]{1,40}】$"
    r"|^第[一二三四五六七八九十百千0-9]+[章節部卷回]\b"
    r"|^(?:序|序章|楔子|前言|後記|尾聲|上部|中部|下部|上卷|中卷|下卷)$"
)


def normalize_strategy(value: object, default: str = "dynamic") -> str:
    name = str(value or "").strip().lower()
    return name if name in STRATEGIES else default


def split_hard(text: Column, size: int) -> Column:
    """Fixed character windows, stripped, empty ones dropped."""
    return F.filter(F.transform(char_windows(strip(text_of(text)), size), strip), lambda piece: piece != "")


def _windows(sizes: Iterable[int], budget: int, overlap: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Windows ``[first, last)`` over sentences, each as long as its token budget allows, and the running sum.

    Ends and overlaps are looked up in the running sum of the counts.
    """
    upto = [0, *accumulate(sizes)]
    n = len(upto) - 1
    out, first = [], 0
    while first < n:
        full = bisect_left(upto, upto[first] + budget)
        exact = full <= n and upto[full] == upto[first] + budget
        last = min(n, max(first + 1, full if exact else full - 1))
        out.append((first, last))
        if last == n:
            break
        shared = bisect_left(upto, upto[last] - overlap) if overlap > 0 else last
        first = last if shared == last else max(first + 1, min(shared, last - 1))
    return out, upto


@F.pandas_udf(WINDOWS)
def _pack(counts: pd.Series, budgets: pd.Series, overlaps: pd.Series) -> pd.Series:
    """``_windows`` of token counts."""
    named = lambda spans: [{"first": a, "last": b} for a, b in spans]
    return pd.Series([named(_windows(map(int, c), int(b), int(o))[0]) for c, b, o in zip(counts, budgets, overlaps)])


# The patterns of functions/text.py for Python's re. White space is spelled out: \s of
# Java has other members.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_ENDS = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))
BLANK_LINE = re.compile(rf"\n[{WHITE}]*\n+")
SENTENCE_END = re.compile(rf"[。！？!?；;.](?:(?<!\.)|(?=[{WHITE}]+[A-Z0-9\u3400-\u9fff]))")
NOT_BLANK = re.compile(f"[{WHITE.replace(' ', '')}]")
SPACES = re.compile(f"[{WHITE}]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
TOKEN = re.compile(rf"[\u3400-\u9fff]|[A-Za-z]+(?:['’][A-Za-z]+)?|\d+(?:[.,:/-]\d+)*|[^{WHITE}]")
BLANK, LETTER, DIGIT, OTHER, APOSTROPHE, JOINER = range(6)


def _sentences(text: str) -> list[str]:
    """As ``sentence_units``."""
    text, out = text.strip(WHITE_ENDS), []
    for paragraph in BLANK_LINE.split(text) if "\n" in text else [text]:
        line = paragraph.replace("\n", " ")
        if "  " in line or NOT_BLANK.search(line):
            # ``split`` also parts at the separators, which are no white space of Java.
            line = SPACES.sub(" ", line) if SEPARATORS.search(line) else " ".join(line.split())
        at = 0
        for end in [*(m.end() for m in SENTENCE_END.finditer(line)), len(line)]:
            if sentence := line[at:end].strip(" "):
                out.append(sentence)
            at = end
    return out


@cache
def _token_classes() -> np.ndarray:
    """What a character can be in ``TOKEN``, by its code point."""
    classes = np.full(0x110000, OTHER, np.uint8)
    classes[[ord(c) for c in "'’"]] = APOSTROPHE
    classes[[ord(c) for c in ".,:/-"]] = JOINER
    classes[[i for i in range(0x110000) if chr(i).isdecimal()]] = DIGIT
    classes[[*range(65, 91), *range(97, 123)]] = LETTER
    classes[[ord(c) for c in WHITE_ENDS]] = BLANK
    return classes


def _token_counts(sentences: list[str]) -> list[int]:
    """How many matches ``TOKEN`` has in each sentence, for all of them at once."""
    if not sentences:
        return []
    points = np.frombuffer(" ".join([*sentences, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _token_classes()[points]
    edges = np.cumsum([0, *(len(s) + 1 for s in sentences)])
    before, after = np.concatenate([[BLANK], kind[:-1]]), np.concatenate([kind[1:], [BLANK]])
    starts = (kind >= OTHER) | (((kind == LETTER) | (kind == DIGIT)) & (kind != before))
    # A mark between digits belongs to their number, with the digits after it.
    within = (kind == JOINER) & (before == DIGIT) & (after == DIGIT)
    marks = np.flatnonzero((kind == APOSTROPHE) & (before == LETTER) & (after == LETTER))
    if len(marks):
        # A word takes one apostrophe with the letters after it; in a row of them, every other one.
        others = np.cumsum(kind != LETTER)[marks]
        fresh = np.concatenate([[True], np.diff(others) != 1])
        order = np.arange(len(marks))
        within[marks[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]] = True
    upto = np.concatenate([[0], np.cumsum(starts - 2 * within.view(np.int8), dtype=np.int64)])
    return np.diff(upto[edges]).tolist()


def _fitting(texts: list[str], budget: int) -> Iterator[tuple[list[str], list[int]]]:
    """Sentences of every text and their token counts.

    One above the budget becomes token groups joined without blanks; joining can
    merge tokens, so only those pieces are counted again.
    """
    found = [_sentences(text) for text in texts]
    counted = iter(_token_counts([s for sentences in found for s in sentences]))
    for sentences in found:
        counts = list(islice(counted, len(sentences)))
        if max(counts, default=0) > budget:
            fit = []
            for sentence, n in zip(sentences, counts):
                tokens = TOKEN.findall(sentence) if n > budget else []
                pieces = ["".join(tokens[i : i + budget]) for i in range(0, n, budget)] if tokens else [sentence]
                fit += [(piece, len(TOKEN.findall(piece)) if tokens else n) for piece in pieces]
            sentences, counts = [s for s, _ in fit], [n for _, n in fit]
        yield sentences, counts


def _dynamic(text: Column, budget: int, overlap: int) -> Column:
    """Pieces of whole sentences and their token counts, in one pass over a text."""

    @F.arrow_udf(PIECES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in bounded(batches):
            pieces, tokens, edges = [], [], [0]
            for sentences, counts in _fitting(texts.to_pylist(), budget):
                spans, upto = _windows(counts, budget, overlap)
                # Pieces are joined by line breaks, so no token crosses a sentence.
                pieces += ["\n".join(sentences[a:b]) for a, b in spans]
                tokens += [upto[b] - upto[a] for a, b in spans]
                edges.append(len(pieces))
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(*v)) for v in ((pieces, pa.string()), (tokens, pa.int32()))]
            yield pa.StructArray.from_arrays(lists, names=["content", "tokens"])

    return run(F.make_valid_utf8(text_of(text)))


# Where a window may end, by the number of characters of the mark.
BREAKS = {1: re.compile("[\n。]"), 2: re.compile(r"\. ")}


@F.pandas_udf(WINDOWS)
def _boundary(texts: pd.Series, sizes: pd.Series, strides: pd.Series) -> pd.Series:
    """Character windows that end after the last line or sentence mark of their last third.

    The marks of a text are found once; each window looks its own up by binary search.
    """

    def windows(text, size, stride):
        marks = {width: [m.start() for m in pattern.finditer(text)] for width, pattern in BREAKS.items()}

        def end_of(first):
            limit = first + size
            if limit >= len(text):
                return len(text)
            latest = [at[k - 1] for width, at in marks.items() if (k := bisect_right(at, limit - width))]
            best = max(latest, default=-1)
            return best + 1 if best >= first + int(size * 0.65) else limit

        spans = [(0, end_of(0))] if text else []
        while spans and spans[-1][1] < len(text):
            first, last = spans[-1]
            first = max(first + 1, min(first + stride, last))
            spans.append((first, end_of(first)))
        return [{"first": a, "last": b} for a, b in spans]

    return pd.Series([windows(t, int(s), int(d)) for t, s, d in zip(texts, sizes, strides)])


def split_text(
    df: DataFrame,
    text: str,
    size: int,
    stride: int | None = None,
    strategy: str = "boundary",
    overlap_tokens: int = 200,
    out: str = "pieces",
    tokens: str | None = None,
) -> DataFrame:
    """Add ``out``: the pieces of ``text`` under one of the three strategies.

    The dynamic strategy can also add ``tokens``, the token count of each piece.
    """
    size = max(1, int(size or 1))
    strategy = normalize_strategy(strategy, "boundary")
    if strategy == "hard":
        return df.withColumn(out, split_hard(F.col(text), size))
    if strategy == "boundary":
        stride = max(1, min(int(stride or size), size))
        cut = df.withColumn("_t", strip(text_of(text))).withColumn("_w", _boundary("_t", F.lit(size), F.lit(stride)))
        pieces = F.filter(
            F.transform("_w", lambda w: strip(F.substring(F.col("_t"), w["first"] + 1, w["last"] - w["first"]))),
            lambda p: p != "",
        )
        return cut.withColumn(out, pieces).drop("_t", "_w")
    overlap = max(0, int(overlap_tokens or 0))
    cut = df.withColumn("_p", _dynamic(F.col(text), size, overlap))
    cut = cut.withColumn(out, F.col("_p.content"))
    if tokens:
        cut = cut.withColumn(tokens, F.col("_p.tokens"))
    return cut.drop("_p")


def chunk(df: DataFrame, text: str, size: int, count_tokens: bool = False, **options) -> DataFrame:
    """One row per piece: input columns (without the text), ``part``, ``parts``, ``content``.

    ``count_tokens`` (dynamic strategy) adds ``token_count``.
    """
    kept = [c for c in df.columns if c != text]
    pieces = split_text(df, text, size, tokens="piece_tokens" if count_tokens else None, **options)
    pieces = pieces.withColumn("parts", F.size("pieces"))
    if count_tokens:
        rows = pieces.select(*kept, "parts", F.posexplode_outer(F.arrays_zip("pieces", "piece_tokens")).alias("part", "z"))
        rows = rows.select(*kept, "parts", "part", F.col("z.pieces").alias("content"), F.col("z.piece_tokens").alias("token_count"))
    else:
        rows = pieces.select(*kept, "parts", F.posexplode_outer("pieces").alias("part", "content"))
    return rows.filter(F.col("content").isNotNull()).withColumn("part", F.col("part") + 1)


def parent_child(
    units: DataFrame,
    parent_tokens: int = 1024,
    child_tokens: int = 256,
    parent_overlap: int = 0,
    child_overlap: int = 0,
    reuse: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Parents and the children inside each of them, as two tables.

    ``units(source_id, filename, unit_index, title, page, content)``. A child
    refers to its parent by ``parent_id``; the parent text is not repeated. With
    ``reuse`` the parents are written once and read by both consumers.
    """
    parents = parents_of(units, parent_tokens, parent_overlap)
    if reuse:
        parents = stage(parents, "parents")
    return parents, children_of(parents, child_tokens, child_overlap)


def parents_of(units: DataFrame, parent_tokens: int = 1024, parent_overlap: int = 0) -> DataFrame:
    """Parents of extraction units, as in ``parent_child``."""
    parent_tokens = max(1, int(parent_tokens))
    parent_overlap = max(0, min(int(parent_overlap), parent_tokens - 1))
    name = F.col("filename")
    stem = F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    base = units.select(
        "source_id",
        "filename",
        "unit_index",
        clean_spaces(stem).alias("parent_title"),
        clean_spaces(
            F.when(text_of("title") == "", F.concat(F.lit("Section "), F.col("unit_index"))).otherwise(F.col("title"))
        ).alias("unit_title"),
        clean_spaces(
            F.when(text_of("page") == "", F.concat(F.lit("區段 "), F.col("unit_index"))).otherwise(F.col("page"))
        ).alias("page"),
        # One paragraph; the sentences are cleaned when they are split off.
        F.replace(text_of("content"), F.lit("\n"), F.lit(" ")).alias("body"),
    )
    cut = chunk(base, "body", parent_tokens, count_tokens=True, strategy="dynamic", overlap_tokens=parent_overlap)
    suffix = F.concat(F.col("unit_index"), F.lit("-"), F.col("part"))
    return cut.select(
        "source_id",
        "unit_index",
        F.concat(F.col("source_id"), F.lit("::parent::"), suffix).alias("parent_id"),
        F.col("part").alias("parent_index"),
        "parent_title",
        F.concat(
            F.col("filename"), F.lit(" | "), F.col("unit_title"),
            F.when(F.col("parts") > 1, F.concat(F.lit(" / parent "), F.col("part"))).otherwise(F.lit("")),
        ).alias("title"),
        "page",
        "content",
        "token_count",
    )


def children_of(parents: DataFrame, child_tokens: int = 256, child_overlap: int = 0) -> DataFrame:
    """Children inside each parent, as in ``parent_child``."""
    child_tokens = max(1, int(child_tokens))
    child_overlap = max(0, min(int(child_overlap), child_tokens - 1))
    pieces = chunk(
        parents.withColumn("body", F.col("content")).drop("content").withColumnRenamed("token_count", "parent_token_count"),
        "body",
        child_tokens,
        count_tokens=True,
        strategy="dynamic",
        overlap_tokens=child_overlap,
    )
    return pieces.select(
        "source_id",
        "unit_index",
        "parent_id",
        F.concat(
            F.col("source_id"), F.lit("::child::"), F.col("unit_index"), F.lit("-"), F.col("parent_index"), F.lit("-"), F.col("part")
        ).alias("child_id"),
        "parent_index",
        F.col("part").alias("child_index"),
        "parent_title",
        F.concat(F.col("title"), F.lit(" / child "), F.col("part")).alias("title"),
        F.col("title").alias("parent_title_context"),
        "page",
        "content",
        "token_count",
        "parent_token_count",
    )


def document_chunks(
    units: DataFrame, size: int = 600, stride: int = 600, strategy: str = "dynamic", overlap_tokens: int = 200
) -> DataFrame:
    """Flat chunks of extraction units, numbered through the whole source."""
    size = max(200, int(size))
    stride = min(size, max(1, int(stride)))
    base = units.withColumn("body", normalize_extracted("content")).filter("body <> ''").drop("content")
    cut = chunk(base, "body", size, stride=stride, strategy=strategy, overlap_tokens=overlap_tokens)
    unit_title = F.when(text_of("title") == "", F.concat(F.lit("Section "), F.col("unit_index"))).otherwise(strip(F.col("title")))
    order = W.partitionBy("source_id").orderBy("unit_index", "part")
    return cut.withColumn("chunk_index", F.row_number().over(order) - 1).select(
        "source_id",
        F.concat(F.col("source_id"), F.lit("::"), F.col("chunk_index")).alias("chunk_id"),
        "chunk_index",
        F.concat(
            F.col("filename"), F.lit(" | "), unit_title,
            F.when(F.col("parts") > 1, F.concat(F.lit(" / part "), F.col("part"))).otherwise(F.lit("")),
        ).alias("title"),
        "page",
        "content",
    )


def lines_of(text: Column) -> Column:
    return F.split(text_of(text), LINE_BREAK, -1)


def _sections(lines: Column, marks: Column) -> Column:
    """``array<struct<at,heading,body>>``: each marked line with the lines up to the next mark."""
    return let(
        F.concat(marks, F.array(F.size(lines) + 1)),
        lambda edges: F.transform(
            F.slice(edges, F.lit(1), F.size(edges) - 1),
            lambda at, i: F.struct(
                at.alias("at"),
                F.element_at(lines, at).alias("heading"),
                F.slice(lines, at + 1, F.element_at(edges, i + 2) - at - 1).alias("body"),
            ),
        ),
    )


def _marked(lines: Column, test) -> Column:
    return F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: test(F.element_at(lines, i)))


def markdown_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """``## `` sets the parent title, ``### `` opens a section; text before it is dropped."""
    is_h2 = lambda line: line.startswith("## ")
    is_h3 = lambda line: line.startswith("### ")
    parts = df.select(
        key,
        let(
            lines_of(F.col(text)),
            lambda lines: F.transform(
                _sections(lines, _marked(lines, lambda line: is_h2(line) | is_h3(line))),
                lambda s: F.struct(
                    s["at"].alias("at"), s["heading"].alias("heading"), strip(F.array_join(s["body"], "\n")).alias("content"),
                    F.size(s["body"]).alias("n_lines"),
                ),
            ),
        ).alias("sections"),
    )
    # Parent title of a section: the nearest ``## `` heading before it.
    rows = parts.select(key, "sections", F.explode("sections").alias("s")).filter(is_h3(F.col("s.heading")) & (F.col("s.n_lines") > 0))
    parent = F.filter(F.col("sections"), lambda p: is_h2(p["heading"]) & (p["at"] < F.col("s.at")))
    return rows.select(
        key,
        F.col("s.at").alias("line_no"),
        F.coalesce(strip(F.substr(F.try_element_at(parent, F.lit(-1))["heading"], F.lit(4))), F.lit("")).alias("parent_title"),
        strip(F.expr("substring(s.heading, 5)")).alias("title"),
        F.col("s.content").alias("content"),
    ).filter("title <> '' and content <> ''")


def delimited_sections(df: DataFrame, key: str, text: str, parent_title: str = "Sectioned Text") -> DataFrame:
    """``=== title ===`` sections; a long ``========`` line inside one is skipped."""
    heading = lambda line: strip(line).rlike(SECTION_HEADING)
    footer = lambda line: strip(line).rlike(SECTION_FOOTER)

    def cut(lines: Column) -> Column:
        # A footer only counts once a section is open; before that it is a heading.
        return let(
            _marked(lines, heading),
            lambda marks: _sections(
                lines,
                F.filter(marks, lambda i: (i == F.element_at(marks, 1)) | ~footer(F.element_at(lines, i))),
            ),
        )

    rows = df.select(
        key,
        F.explode(
            let(lines_of(F.col(text)), lambda lines: F.when(F.exists(lines, heading), cut(lines)))
        ).alias("s"),
    )
    body = F.array_join(F.filter(F.col("s.body"), lambda line: ~footer(line)), "\n")
    return rows.select(
        key,
        F.col("s.at").alias("line_no"),
        F.lit(parent_title).alias("parent_title"),
        strip(F.regexp_replace(strip(F.col("s.heading")), r"^[= ]+|[= ]+$", "")).alias("title"),
        strip(body).alias("content"),
    ).filter("title <> '' and content <> ''")


def narrative_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines before the first heading as one metadata section, then numbered / bracketed / chapter headings."""
    heading = lambda line: strip(line).rlike(NARRATIVE_HEADING)
    filled = df.select(key, F.filter(F.transform(lines_of(F.col(text)), strip), lambda line: line != "").alias("lines"))
    front = filled.filter(F.size("lines") > 0).select(
        key,
        F.lit(0).alias("line_no"),
        F.lit("Narrative Text").alias("parent_title"),
        F.lit("文件開頭 / metadata").alias("title"),
        let(
            F.array_position(F.transform("lines", heading), True),
            lambda first: F.array_join(F.when(first > 0, F.slice(F.col("lines"), 1, (first - 1).cast("int"))).otherwise(F.col("lines")), "\n"),
        ).alias("content"),
    ).filter("content <> ''")
    rows = df.select(
        key,
        F.explode(
            let(lines_of(F.col(text)), lambda lines: F.when(F.exists(lines, heading), _sections(lines, _marked(lines, heading))))
        ).alias("s"),
    )
    body = rows.select(
        key,
        F.col("s.at").alias("line_no"),
        F.lit("Narrative Text").alias("parent_title"),
        strip(F.col("s.heading")).alias("title"),
        strip(F.array_join(F.filter(F.col("s.body"), lambda line: strip(line) != ""), "\n")).alias("content"),
    ).filter("content <> ''")
    return front.unionByName(body)


def has_narrative_headings(text: Column) -> Column:
    return F.size(F.filter(lines_of(text), lambda line: strip(line).rlike(NARRATIVE_HEADING))) >= 2


def sized_sections(sections: DataFrame, key: str, size: int, stride: int, strategy: str = "dynamic", overlap_tokens: int = 200) -> DataFrame:
    """Split sections to size; ``/ part n`` is added only when there are several pieces."""
    cut = chunk(
        sections.withColumn("body", F.col("content")).drop("content"), "body", size, stride=stride, strategy=strategy, overlap_tokens=overlap_tokens
    )
    order = W.partitionBy(key).orderBy("line_no", "part")
    return cut.withColumn("chunk_index", F.row_number().over(order) - 1).select(
        key,
        "chunk_index",
        F.concat(F.col(key), F.lit("::"), F.col("chunk_index")).alias("chunk_id"),
        "parent_title",
        F.when(F.col("parts") > 1, F.concat(F.col("title"), F.lit(" / part "), F.col("part"))).otherwise(F.col("title")).alias("title"),
        "content",
    )


def knowledge_base_sections(files: DataFrame) -> DataFrame:
    """Route files ``(path, text)``: markdown, delimited, narrative, else plain."""
    text_files = files.filter(F.lower("path").endswith(".txt"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    delimited = F.exists(lines_of(F.col("text")), lambda line: strip(line).rlike(SECTION_HEADING))
    route = F.when(delimited, "delimited").when(has_narrative_headings(F.col("text")), "narrative").otherwise("plain")
    routed = text_files.withColumn("route", route)
    plain = routed.filter("route = 'plain'").select(
        "path",
        F.lit(0).alias("line_no"),
        F.lit("Plain Text").alias("parent_title"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("title"),
        strip(F.col("text")).alias("content"),
    ).filter("content <> ''")
    by_heading = delimited_sections(routed.filter("route = 'delimited'"), "path", "text")
    by_heading = by_heading.withColumn("parent_title", stem)
    return (
        markdown_sections(files.filter(F.lower("path").endswith(".md")), "path", "text")
        .unionByName(by_heading)
        .unionByName(narrative_sections(routed.filter("route = 'narrative'"), "path", "text"))
        .unionByName(plain)
    )


def token_windows(tokens: Column, size: int, overlap: int = 0) -> Column:
    """``array<struct<start,tokens>>`` windows; a shorter tail window is kept."""
    stride = max(1, int(size) - int(overlap))
    empty = F.array(F.struct(F.lit(0).alias("start"), F.array().cast("array<string>").alias("tokens")))
    # let: inside the lambda the token array must be a value, not an expression
    # that is evaluated again for every window.
    return let(
        tokens,
        lambda toks: F.when(
            F.size(toks) > 0,
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size(toks) - 1) / stride).cast("int")),
                lambda i: F.struct((i * stride).alias("start"), F.slice(toks, i * stride + 1, F.lit(size)).alias("tokens")),
            ),
        ).otherwise(empty),
    )


def hard_chunks_with_spans(df: DataFrame, key: str, text: str, size: int = 600, step: int | None = None) -> DataFrame:
    """Fixed windows of the stripped text with offsets into the raw text.

    With ``step`` below ``size`` the passages overlap; they end with the first one
    that reaches the end of the text.
    """
    step = int(step or size)
    base = df.select(key, text_of(text).alias("_raw")).withColumn("_clean", strip(F.col("_raw"))).withColumn(
        "_lead", F.length("_raw") - F.length(F.regexp_replace("_raw", r"(?U)^\s+", ""))
    )
    rows = base.select(
        key, F.length("_clean").alias("_n"), "_lead", F.posexplode(char_windows(F.col("_clean"), size, step)).alias("i", "w")
    )
    start = F.col("i") * step
    return rows.select(
        key,
        (F.col("i") + 1).alias("chunk_index"),
        (F.col("_lead") + start).alias("start_char"),
        (F.col("_lead") + F.least(F.col("_n"), start + size)).alias("end_char"),
        strip(F.col("w")).alias("content"),
    ).filter("content <> ''")


def best_parent_window(hits: DataFrame, parent_size: int = 200, child_size: int = 40, child_overlap: int = 10) -> DataFrame:
    """For each (query, document) hit: the token window with most query terms.

    ``hits(query_id, chunk_id, query_text, chunk_text)``; ties go to the first window.
    """
    words = F.regexp_extract_all(text_of("chunk_text"), F.lit(r"(?U)[\w]+"), F.lit(0))
    terms = F.array_distinct(F.transform(F.regexp_extract_all(text_of("query_text"), F.lit(r"(?U)[\w]+"), F.lit(0)), F.lower))
    stride = max(1, child_size - child_overlap)
    cut = hits.select("query_id", "chunk_id", token_windows(words, parent_size).alias("w"), terms.alias("terms"))
    scored = cut.select(
        "query_id",
        "chunk_id",
        let(
            F.col("terms"),
            lambda wanted: F.transform(
                "w",
                lambda w, i: F.struct(
                    F.size(F.filter(w["tokens"], lambda t: F.array_contains(wanted, F.lower(t)))).alias("hits"),
                    (-i).alias("neg"),
                    F.size(w["tokens"]).alias("n"),
                ),
            ),
        ).alias("w"),
    )
    best = F.array_max("w")
    return scored.select(
        "query_id",
        "chunk_id",
        F.size(F.filter("w", lambda w: w["n"] > 0)).alias("parent_chunk_count"),
        F.aggregate(
            "w", F.lit(0), lambda acc, w: acc + F.when(w["n"] > 0, F.floor((w["n"] - 1) / stride).cast("int") + 1).otherwise(0)
        ).alias("child_chunk_count"),
        F.when(best["n"] > 0, -best["neg"]).alias("parent_chunk_index"),
        best["n"].alias("parent_token_count"),
        best["hits"].alias("term_hits"),
    )
