"""Text expressions: tokenizers, sentence splitting, whitespace, n-grams.

All of these are Spark Column expressions and run in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words of the lexical index.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "if", "in", "is", "it",
    "of", "on", "or", "that", "the", "to", "under", "what", "when", "which", "why", "with",
)

# Patterns that decide token and sentence boundaries.
CJK_RUN = r"[\x{4e00}-\x{9fff}]+"
TOKEN_PATTERN = r"(?U)[\x{3400}-\x{9fff}]|[A-Za-z]+(?:['’][A-Za-z]+)?|\d+(?:[.,:/-]\d+)*|[^\s]"
SENTENCE_BOUNDARY = r"(?U)(?<=[。！？!?；;])\s*|(?<=[.!?])\s+(?=[A-Z0-9\x{3400}-\x{9fff}])"
PHRASE_PATTERN = r"(?U)[a-z0-9]+(?:\s+[a-z0-9]+){1,5}"

MAX_EXTRACTED_CHARACTERS = 5_000_000


def text_of(column: Column | str) -> Column:
    """Missing text and empty text are the same thing."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def strip(column: Column) -> Column:
    """Trim every kind of Unicode white space (``trim`` only knows U+0020)."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def clean_spaces(column: Column) -> Column:
    return F.trim(F.regexp_replace(text_of(column), r"(?U)\s+", " "))


def compact(column: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(text_of(column), r"(?U)\s+", ""))


def compact_alnum(column: Column) -> Column:
    """Lower case reduced to latin letters, digits and CJK."""
    return F.regexp_replace(F.lower(text_of(column)), r"[^a-z0-9\x{3400}-\x{9fff}]+", "")


def contains_cjk(column: Column) -> Column:
    return text_of(column).rlike(r"[\x{4e00}-\x{9fff}]")


def find_all(column: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text_of(column), F.lit(pattern), F.lit(group))


def char_ngrams(column: Column, size: int) -> Column:
    """All windows of ``size`` characters, in order, repeats kept.

    A zero-width match captures the window at every position in one pass over the
    text (``substring`` would count from the start of the text each time).
    """
    return F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{int(size)}}}))"), F.lit(1))


def char_windows(column: Column, size: int, step: int | None = None) -> Column:
    """Windows of ``size`` characters every ``step``; the first to reach the end is the last."""
    size, step = int(size), int(step or size)
    if step == size:
        return F.regexp_extract_all(column, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    count = F.greatest(F.lit(0), F.ceil((F.length(column) - size) / step).cast("int")) + 1
    return F.slice(
        F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1)), F.lit(1), count
    )


def multi_ngrams(column: Column, sizes: tuple[int, ...]) -> Column:
    return F.concat(*[char_ngrams(column, size) for size in sizes])


def bm25_tokens(column: Column | str) -> Column:
    """Lexical-index tokens: latin words without stop words, then CJK n-grams."""
    lowered = F.lower(text_of(column))
    latin = F.filter(
        F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0)),
        lambda token: ~token.isin(*STOP_WORDS),
    )
    runs = F.regexp_extract_all(lowered, F.lit(CJK_RUN), F.lit(0))
    cjk = F.flatten(
        F.transform(
            runs,
            lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(multi_ngrams(run, (2, 3))),
        )
    )
    return F.concat(latin, cjk)


def keyword_tokens(column: Column | str) -> Column:
    """Tokens of the keyword scorer: wider latin words plus whole CJK runs."""
    value = text_of(column)
    latin = F.transform(F.regexp_extract_all(value, F.lit("[A-Za-z0-9_,.]+"), F.lit(0)), F.lower)
    return F.concat(latin, F.regexp_extract_all(value, F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), F.lit(0)))


def token_list(column: Column | str) -> Column:
    return F.regexp_extract_all(text_of(column), F.lit(TOKEN_PATTERN), F.lit(0))


def estimate_tokens(column: Column | str) -> Column:
    return F.size(token_list(column))


def sentence_units(column: Column | str) -> Column:
    """Sentences in order; a blank line always ends one."""
    paragraphs = F.split(strip(text_of(column)), r"(?U)\n\s*\n+", -1)
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.split(strip(p), SENTENCE_BOUNDARY, -1)))
    return F.filter(F.transform(pieces, clean_spaces), lambda s: s != "")


def normalize_extracted(column: Column | str) -> Column:
    """Drop blank lines, collapse blanks inside lines, keep line structure."""
    lines = F.split(F.replace(text_of(column), F.lit(" "), F.lit(" ")), r"\R|[\x0b\x0c\x1c-\x1e]", -1)
    cleaned = F.filter(
        F.transform(lines, lambda line: strip(F.regexp_replace(line, r"[ \t]+", " "))),
        lambda line: line != "",
    )
    return F.array_join(cleaned, "\n")


def distinct_in_order(*arrays: Column) -> Column:
    """Union of arrays keeping first occurrences."""
    return F.array_distinct(F.concat(*arrays))


def term_counts(tokens: Column) -> Column:
    """Run-length counts ``array<struct<term,tf>>`` of a token array.

    Sorting inside the row gives the counts of one document without moving its
    tokens through a shuffle.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(ordered)),
            lambda i: (i == 1) | (F.element_at(ordered, i) != F.element_at(ordered, F.greatest(i - 1, F.lit(1)))),
        )
        return let(
            F.concat(starts, F.array(F.size(ordered) + 1)),
            lambda edges: F.transform(
                F.slice(edges, F.lit(1), F.size(edges) - 1),
                lambda start, n: F.struct(
                    F.element_at(ordered, start).alias("term"),
                    (F.element_at(edges, n + 2) - start).alias("tf"),
                ),
            ),
        )

    return F.when(
        F.size(tokens) > 0,
        let(F.sort_array(tokens), runs),
    ).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def indexed_text(parent_title: Column, title: Column, source: Column, page: Column, content: Column) -> Column:
    """Text seen by the lexical index: titles and the source id count too."""
    return F.concat_ws("\n", *[text_of(c) for c in (parent_title, title, source, page, content)])


def embedding_text(parent_title: Column, title: Column, content: Column) -> Column:
    return F.concat_ws("\n", *[text_of(c) for c in (parent_title, title, content)])


def phrase_bonus(query: Column, text: Column) -> Column:
    """1.0 when a run of two to six latin words of the query occurs verbatim."""
    phrases = F.regexp_extract_all(F.lower(text_of(query)), F.lit(PHRASE_PATTERN), F.lit(0))
    return let(
        F.lower(text_of(text)),
        lambda body: F.when(F.exists(phrases, lambda p: F.contains(body, p)), F.lit(1.0)).otherwise(F.lit(0.0)),
    )


def any_contains(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """True when any fixed term occurs in ``text`` (one pass over the text)."""
    return text.rlike("|".join(re.escape(t) for t in terms)) if terms else F.lit(False)


def contained_terms(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """The fixed terms occurring in ``text``, in the given order."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))
