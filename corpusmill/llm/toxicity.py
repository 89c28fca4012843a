"""Toxicity scores that see through leetspeak, spacing and repetition.

Suspicious tokens (letters mixed with look-alike signs, single letters set
apart by gaps of any length, letters repeated) become lattices: every sign may stand for itself, for
a look-alike letter or for nothing. A Viterbi search finds the likeliest
readings under a character trigram model counted over all texts. Words of the
plain and of the restored text are scored by markers: the best one that speaks
alone, or several different ones together.

Markers are words and word edges whose posterior odds, given their counts in
toxic and other labelled texts, speak for toxicity. They are fitted on a bounded
sample of labelled rows (``toxic_rows`` and ``other_rows``, chosen by hash), of
which near copies are thinned to one, as copies are no evidence.

Only texts are inputs of a score. Null and empty texts have the lowest score.
Null labels are ignored; of contradicting labels of one doc_id the toxic one
counts. Rows with null doc_id are scored and count as not held out. Without any
label of one kind all texts get the lowest score. Repeated rows score alike.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.batches import slices
from corpusmill.llm.jaccard import _WordHashes, mixed, shingles
from corpusmill.session import stage

TOXIC_ROWS = 10_000
OTHER_ROWS = 30_000
THRESHOLD = 0.7
LOWEST = 0.01
PRIOR, SLIP = 1e-4, 0.02
LEAST_TEXTS = 3
# A word speaks alone if at least this share of the texts that hold it is toxic; other
# markers (edges above all) speak only together, each with TOGETHER at most.
ALONE, TOGETHER = 0.95, 0.65
EDGES = (4, 5, 6, 7)
ENDS = (4, 5)
# Entries of a task's memories; emptied when full.
TOKENS_KNOWN, WORDS_KNOWN = 300_000, 50_000

WORDS = re.compile(r"[^\W\d_]+")
TRAIL = ".,;:!?\"')]}»“”…"
EDGE = TRAIL.replace("!", "")  # signs around a token that stand for no letter
SPACES = re.compile(r"\s")
# Signs that may stand for letters.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
GAPS = " .-_*~^`·'"
# Single signs set apart by runs of gap characters of any length; signs and gaps are disjoint.
SIGN = f"(?:[^\\W_]|[{re.escape(''.join(c for c in LOOKALIKE if not c.isalnum()))}])"
APART = rf"[\s{re.escape(GAPS)}]++"
SPACED = re.compile(rf"(?<![^\W_])(?<![@$])(?:{SIGN}{APART}){{3,}}{SIGN}(?![^\W_])(?![@$])")
WIDE = re.compile(rf"([\s{re.escape(GAPS)}]{{2}}){APART}")
REPEATED = re.compile(r"(.)\1{3,}", re.S)
GLUE = re.compile(r"[_/\\,;:=&?#~^`·'.*-]+")
# Log costs of the channel.
SWAP, KEEP, GAP, REPEAT, DOUBLE = -1.5, -4.0, -0.3, -0.5, -4.0
BEAM, READINGS = 48, 3
LONGEST_TOKEN = 40

# ---- character model --------------------------------------------------------------

SYMBOLS = 32


def _codes_of(top: int = 0x250) -> np.ndarray:
    """Code of every character below ``top``: 1 to 26 for letters by base letter, 0 for all else."""
    codes = np.zeros(top, np.int32)
    for c in range(top):
        base = unicodedata.normalize("NFKD", chr(c).lower())[0]
        codes[c] = ord(base) - 96 if "a" <= base <= "z" else 19 if chr(c) == "ß" else 0
    return codes


CODES = _codes_of()


def char_codes(text: str) -> np.ndarray:
    """Codes 0 to 31; letters of other scripts fall into five classes."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(points < len(CODES), CODES[np.minimum(points, len(CODES) - 1)], np.where(points > 0x36F, 27 + points % 5, 0))


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``gram, n`` over all texts, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    c = char_codes(f"\n\n{text}\n")
                    total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["gram", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a code after two codes; the table has 32 ** 3 cells at any input size."""
    counts = np.zeros(SYMBOLS**3)
    for row in trigram_counts(docs).toLocalIterator():
        counts[row["gram"]] = row["n"]
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pair = counts.sum(axis=0)
    single = pair.sum(axis=0)
    p1 = (single + 1) / (single.sum() + SYMBOLS)
    p2 = (pair + 5 * p1) / (pair.sum(axis=1, keepdims=True) + 5)
    return np.log((counts + 5 * p2) / (counts.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


# ---- deobfuscation ----------------------------------------------------------------


def readings(token: str, model: list, keep: int = READINGS) -> list[str]:
    """The likeliest texts behind ``token``: Viterbi over its lattice, state = last two codes."""
    states = {(0, 0): [(0.0, "")]}
    run, previous = 1, ""
    runs = [len(m[0]) for m in re.finditer(r"(.)\1*", token, re.S) for _ in m[0]]
    for at, sign in enumerate(token):
        options: list[tuple[str, float]] = []
        if sign.isalpha():
            options.append((sign, 0.0))
        else:
            options += [(letter, SWAP) for letter in LOOKALIKE.get(sign, "")]
            options.append((" ", GAP * 3 if sign in GAPS else KEEP))
            if sign in GAPS:
                options.append(("", GAP))
        if sign == previous and sign not in GAPS:
            options.append(("", REPEAT if runs[at] >= 3 else DOUBLE))
        previous = sign
        following: dict[tuple[int, int], list] = {}
        for (a, b), paths in states.items():
            for letter, cost in options:
                if letter:
                    code = int(CODES[ord(letter)]) if ord(letter) < len(CODES) else 27 + ord(letter) % 5
                    to, gain = (b, code), cost + model[a][b][code]
                else:
                    to, gain = (a, b), cost
                following.setdefault(to, []).extend((score + gain, text + letter) for score, text in paths)
        best = sorted(((max(paths), to) for to, paths in following.items()), reverse=True)[:BEAM]
        states = {to: sorted(set(following[to]), reverse=True)[:2] for _, to in best}
    ends = sorted(((score + model[a][b][0], text) for (a, b), paths in states.items() for score, text in paths), reverse=True)
    return list(dict.fromkeys(text for _, text in ends))[:keep]


def suspicious(token: str) -> bool:
    """Letters mixed with signs that stand for letters or part them, or a letter twice in a row.

    Tokens of signs alone count if all of them stand for letters; digits alone are a number.
    """
    letters = sum(map(str.isalpha, token))
    if letters == len(token):
        return any(a == b for a, b in zip(token, token[1:]))
    if token.startswith(("http", "www.")):
        return False
    if letters and letters * 3 >= len(token):
        return True
    return all(c.isalpha() or c in LOOKALIKE or c in GAPS for c in token) and any(c.isalpha() or c in LOOKALIKE and not c.isdigit() for c in token)


def pieces(token: str) -> Iterator[tuple[str, bool, bool]]:
    """Overlapping pieces of a token of any length, and whether they are cut at the left and right.

    Runs of a sign are first shortened to three: the channel reads longer ones alike.
    """
    token = REPEATED.sub(r"\1\1\1", token)
    at = 0
    while True:
        end = at + 2 * LONGEST_TOKEN
        yield token[at:end], at > 0, end < len(token)
        if end >= len(token):
            return
        at += LONGEST_TOKEN


def whole_words(text: str, left: bool, right: bool) -> str:
    """``text`` without the word that a cut parts; it stands whole in the next piece."""
    if left:
        text = re.sub(r"^[^\W\d_]+", "", text)
    return re.sub(r"[^\W\d_]+$", "", text) if right else text


def core(token: str) -> str:
    """``token`` without punctuation around it; long runs of signs at its ends are no letters either."""
    token = token.strip(TRAIL)
    return re.sub(r"[^\w\s]{3,}$", "", re.sub(r"^[^\w\s]{3,}", "", token)).strip(TRAIL)


# ---- markers ------------------------------------------------------------------------


def features(word: str) -> tuple[str, ...]:
    """A word and its edges, told apart by a sign."""
    n = len(word)
    return (word, *(word[:k] + ">" for k in EDGES if n > k), *("<" + word[-k:] for k in ENDS if n > k))


class _WordFeatures(dict):
    def __missing__(self, word: str) -> tuple:
        if len(self) >= WORDS_KNOWN:
            self.clear()
        value = self[word] = features(word)
        return value


def text_features(text: str | None, cache: dict) -> set[str]:
    return set().union(*map(cache.__getitem__, set(WORDS.findall((text or "").lower()))))


def _counts(texts: DataFrame, only: set | None = None) -> DataFrame:
    """Texts that have each feature: ``feature, n``; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, total = _WordFeatures(), Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["feature", "n"])
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                found = text_features(text, cache)
                total.update(found if only is None else found & only)
            if len(total) > TOKENS_KNOWN:
                yield told()
                total.clear()
        yield told()

    return texts.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def thinned(sample: DataFrame) -> DataFrame:
    """One text of each group of near copies: those that are first under every of four min-hashes."""
    seeds = np.array([3, 5, 7, 11], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in slices(batches):
            columns = []
            for text in batch.column(1).to_pylist():
                found = shingles((text or "").lower(), hashes, 3)
                columns.append([int(mixed(found * s).min()) - (1 << 63) if len(found) else 0 for s in seeds])
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in (zip(*columns) if columns else [()] * 4))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "s0", "s1", "s2", "s3"])

    signed = sample.select("row", "text").mapInArrow(run, "row long, s0 long, s1 long, s2 long, s3 long")
    each = signed.select("row", F.posexplode(F.array("s0", "s1", "s2", "s3")).alias("k", "s"))
    lost = each.join(each.groupBy("k", "s").agg(F.min("row").alias("least")), ["k", "s"]).where("row > least").select("row").distinct()
    return sample.join(F.broadcast(lost), "row", "left_anti")  # at most as many rows as the sample


def markers(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> dict[str, float]:
    """Posterior probability per feature, for those that speak for toxicity."""
    named = labels.select(F.col("doc_id").cast("long").alias("row"), F.col("toxic").cast("int").alias("toxic")).where("row is not null and toxic in (0, 1)")
    named = named.where(~held_out(F.col("row"))).groupBy("row").agg(F.max("toxic").alias("toxic"))
    picked = [named.where(F.col("toxic") == t).orderBy(F.xxhash64("row"), "row").limit(n) for t, n in ((1, toxic_rows), (0, other_rows))]
    ids = picked[0].unionByName(picked[1])
    # The sample is bounded by its parameters, so is this broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("row"), F.col("text").cast("string").alias("text")).where("text <> ''")
    sample = stage(texts.join(F.broadcast(ids), "row"), "labelled")
    sample = stage(thinned(sample.dropDuplicates(["row"])), "thinned")
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not size.get(1) or not size.get(0):
        return {}
    hits = {r["feature"]: r["n"] for r in _counts(sample.where("toxic = 1")).where(F.col("n") >= LEAST_TEXTS).toLocalIterator()}
    misses = {r["feature"]: r["n"] for r in _counts(sample.where("toxic = 0"), set(hits)).toLocalIterator()}
    share = size[1] / (size[0] + size[1])
    gain, loss = math.log((1 - SLIP) / share), math.log(SLIP / (1 - share))
    # Texts of either kind for which one of the sample stands.
    known = {r["toxic"]: r["count"] for r in named.groupBy("toxic").count().collect()}
    weight = (known[0] / size[0]) / (known[1] / size[1])
    found = {}
    for feature, k in hits.items():
        m = misses.get(feature, 0)
        odds = math.log(PRIOR / (1 - PRIOR)) + k * gain + m * loss
        if odds > -3:
            posterior = 1 / (1 + math.exp(-min(odds, 30.0)))
            alone = feature.isalpha() and (k + 0.5) / (k + m * weight + 1) >= ALONE
            found[feature] = posterior if alone else min(posterior, TOGETHER)
    return found


# ---- scores --------------------------------------------------------------------------

# Letters and signs that the channel exchanges are one; gaps are nothing.
ONE_OF = {c: letters[0] for letters in sorted(LOOKALIKE.values(), key=len) for c in letters}  # a sign for two letters joins them
SHAPE = {ord(c): None for c in GAPS} | {ord(c): ONE_OF[letters[0]] for c, letters in LOOKALIKE.items()} | {ord(c): to for c, to in ONE_OF.items()}
RUNS = re.compile(r"(.)\1+", re.S)


def shape(text: str) -> str:
    """What all readings of ``text`` have in common: no reading holds a word whose shape is not in it."""
    return RUNS.sub(r"\1", text.translate(SHAPE))


def run_patterns(feature: str) -> tuple[re.Pattern, re.Pattern]:
    """The letters of a marker, each run as long as there or longer: placed in a plain word, and anywhere."""
    runs = "".join(f"{re.escape(m[0][0])}{{{len(m[0])},}}" for m in re.finditer(r"(.)\1*", feature.strip("<>").translate(SHAPE)))
    return re.compile(("" if feature.startswith("<") else "^") + runs + ("" if feature.endswith(">") else "$")), re.compile(runs)


NOTHING = (0.0, "")


class TextScorer:
    """Scores texts of one task; tokens met before are remembered."""

    def __init__(self, found: dict[str, float], model: np.ndarray):
        self.found, self.model, self.known = found, model.tolist(), {}
        # First and last four letters of the edges: most words are told apart by them.
        self.heads = {f[:4] for f in found if f.endswith(">")}
        self.tails = {f[-4:] for f in found if f.startswith("<")}
        # Weak markers count where they stand; only those that can be hits are looked for behind disguises.
        self.shapes: dict[int, dict[str, list]] = {}
        for feature, value in found.items():
            if value >= TOGETHER:
                self.shapes.setdefault(len(stem := shape(feature.strip("<>"))), {}).setdefault(stem, []).append(run_patterns(feature))
        self.least = min(self.shapes, default=1)
        self.starts = {stem[: self.least] for stems in self.shapes.values() for stem in stems}

    def may_hold_marker(self, token: str) -> bool:
        """Whether a reading can hold a marker: exact for its letters and their runs, for places only in plain words."""
        seen, whole = shape(token), token.isalpha()
        letters = token.translate(SHAPE)
        for i in range(len(seen) - self.least + 1):
            if seen[i : i + self.least] in self.starts:
                for n, stems in self.shapes.items():
                    if any((word if whole else anywhere).search(letters) for word, anywhere in stems.get(seen[i : i + n], ())):
                        return True
        return False

    def best_marker(self, text: str) -> tuple[float, str]:
        found, best = self.found, NOTHING
        for w in WORDS.findall(text):
            if w in found or w[:4] in self.heads or w[-4:] in self.tails:
                best = max(best, max((found.get(f, 0.0), f) for f in features(w)))
        return best

    def words(self, text: str) -> float:
        return self.best_marker(text)[0]

    def best_reading(self, token: str) -> tuple[float, str]:
        """Best marker of a reading; tokens none of whose readings can hold a marker are not decoded."""
        if not self.may_hold_marker(token):
            return NOTHING
        held = (p for p in set(pieces(token)) if self.may_hold_marker(p[0]))
        return max((self.best_marker(whole_words(t, left, right)) for piece, left, right in held for t in readings(piece, self.model)), default=NOTHING)

    def decoded(self, token: str) -> float:
        return self.best_reading(token)[0]

    def token(self, token: str) -> tuple[float, str]:
        known = self.known.get(token)
        if known is None:
            known = self.best_marker(token)
            bare = token.strip(EDGE)
            plain = bare.isalpha() and len(token) <= LONGEST_TOKEN and not RUNS.search(bare)  # nothing to decode
            for inner in () if plain else {core(token), bare}:
                if (not inner.isalpha() or len(inner) > 3) and suspicious(inner):
                    known = max(known, self.best_reading(inner))
            if len(token) > LONGEST_TOKEN and not token.startswith(("http", "www.")):
                known = max([known, *(self.token(t) for t in set(GLUE.split(token)) if 1 < len(t) < len(token))])
            if len(self.known) >= TOKENS_KNOWN:
                self.known.clear()
            self.known[token] = known
        return known

    def score(self, text: str | None) -> float:
        """The best single marker, or what several different ones say together."""
        if not text or not self.found:
            return LOWEST
        low = text.lower()
        known, token = self.known.get, self.token
        seen = {known(t) or token(t) for t in set(low.split())}
        seen.update(self.best_reading(SPACES.sub(" ", WIDE.sub(r"\1", m[0]))) for m in SPACED.finditer(low))
        doubt = math.prod(1 - value for value, _ in seen if value >= TOGETHER)
        return max(LOWEST, 1 - doubt, max((value for value, _ in seen), default=0.0))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _scorer(docs: DataFrame, labels: DataFrame):
    spark = docs.sparkSession.sparkContext
    return spark.broadcast((markers(docs, labels), language_model(docs)))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``."""
    known = _scorer(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = TextScorer(*known.value)
        for batch in slices(batches):
            scores = np.array([scorer.score(t) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = narrow.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score below ``threshold``; all columns kept."""
    known = _scorer(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = TextScorer(*known.value)
        for batch in slices(batches):
            yield batch.filter(pa.array([scorer.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
