"""Secrets in texts, with weak candidates confirmed by their counterparts.

Base findings need no context: assignments of long values, access identifiers,
long hexadecimal runs. Weak candidates (short assigned values, bare 40-character
keys) are reported only when an access identifier or an endpoint lies in the same
scope (paragraph). Tables are scanned and masked over whole scopes; a ``reach``
in characters narrows the join, as it does by default for a single text. The parts of a credential are
linked by an interval join over their spans: each scope has one link
``secret+secret-counterpart+counterpart`` (each ``kind:start:end``) of all its weak
and strong secrets and all their counterparts. ``n_linked`` counts linked secrets.

Null and empty texts have no spans. A text of any length is scanned whole.
Repeated rows are scanned alike and all returned. Empty tables give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.batches import slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

# Parts that mean nothing alone.
IDENTIFIER = re.compile(r"""(?:access_?key(?:_?id)?|client_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.I | re.A)
SHORT = re.compile(r"""(?:password|passwd|pwd|pass|secret(?:_?key)?|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,})""", re.I | re.A)
BARE = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"""(?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp)://[^\s"'<>]+""", re.I | re.A)
SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")

KINDS = ["assign", "access", "hex", "weak", "identifier", "endpoint"]
REACH = 300
OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long, links string"

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    found = []
    low = text.lower()  # only to see whether the slow pattern can match at all
    if any(word in low for word in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _clear_of(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those of ``spans`` that overlap nothing in ``taken``; both may be long."""
    taken = sorted(taken)
    ends, best = [], 0
    for _, end, _ in taken:
        best = max(best, end)
        ends.append(best)
    starts = [s for s, _, _ in taken]
    return [s for s in spans if not (i := bisect_left(starts, s[1])) or ends[i - 1] <= s[0]]


def _near(spans: list[Span], others: list[Span], reach: int | None) -> list[Span]:
    """Those of ``spans`` with one of ``others`` (sorted) within ``reach``, at any distance if it is None."""
    if reach is None:
        return spans if others else []
    starts, ends, best = [s[0] for s in others], [], 0
    for _, end, _ in others:
        best = max(best, end)
        ends.append(best)
    return [s for s in spans if (i := bisect_right(starts, s[1] + reach)) and ends[i - 1] >= s[0] - reach]


def linked_spans(text: str, base: list[Span], reach: int | None = REACH) -> list[tuple[list[Span], list[Span]]]:
    """Per scope its secrets and all their counterparts, in order of position and within ``reach``.

    Secrets are weak candidates and the base findings but access identifiers:
    a strong secret needs no counterpart, but its counterparts are found by it.
    """
    low = text.lower()
    weak: list[Span] = []
    if any(word in low for word in ("pass", "pwd", "secret", "token", "apikey", "api_key")):
        weak += [(m.start(), m.end(), "weak") for m in SHORT.finditer(text)]
    weak += [(m.start(), m.end(), "weak") for m in BARE.finditer(text)]
    weak = _clear_of(weak, base)
    secrets = weak + [s for s in base if s[2] != "access"]
    if not secrets:
        return []
    partners = [s for s in base if s[2] == "access"]
    partners += _clear_of([(m.start(), m.end(), "identifier") for m in IDENTIFIER.finditer(text)], base + weak)
    if "://" in text:
        partners += _clear_of([(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)], base + weak)
    if not partners:
        return []
    breaks = [m.start() for m in SCOPE_END.finditer(text)]
    scopes: dict[int, tuple[list[Span], list[Span]]] = {}
    for side, spans in enumerate((secrets, partners)):
        for span in sorted(set(spans)):
            scopes.setdefault(bisect_right(breaks, span[0]), ([], []))[side].append(span)
    links = []
    for _, (own, others) in sorted(scopes.items()):
        link = _near(own, others, reach), _near(others, own, reach)
        if link[0]:
            links.append(link)
    return links


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan_text(text: str | None, reach: int | None = REACH) -> tuple:
    text = text or ""
    base = base_spans(text)
    links = linked_spans(text, base, reach)
    every = set(base) | {s for link in links for side in link for s in side}
    count = lambda kind: sum(1 for s in base if s[2] == kind)
    return (
        count("assign"), count("access"), count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(list(every)),
        sum(len(own) for own, _ in links), ",".join("-".join("+".join(f"{k}:{s}:{e}" for s, e, k in side) for side in link) for link in links),
    )


def scan_documents(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """Counts, digest and spans per document; the work is one map over the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = list(zip(*(scan_text(t, reach) for t in batch.column(1).to_pylist()))) or [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in OUT.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, OUT)


def redact(text: str | None, spans: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with the given ``kind:start:end`` spans replaced; overlaps become one mark."""
    if not text or not spans:
        return text
    parts, at = [], 0
    for start, end in sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in spans.split(",") if not x.startswith(("identifier", "endpoint")))):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


def mask_documents(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """All documents with the secrets of their texts masked; other columns kept, ``n_chars`` counted anew."""
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            before = batch.column(at).to_pylist()
            texts = [redact(t, scan_text(t, reach)[4]) for t in before]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if count is not None:
                changed = [n if t == b else len(t) for n, t, b in zip(columns[count].to_pylist(), texts, before)]
                columns[count] = pa.array(changed, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
