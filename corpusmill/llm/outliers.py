"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Statistics of each text become a vector: logarithms of the number of words and of
their mean length, square roots of the shares of symbols, repeated lines and
repeated words. For every (lang, source), and for every lang, location and scatter
are minimum-covariance-determinant estimates: concentration steps (keep the half
with the smallest Mahalanobis distances, estimate again) from three robust starts
(tanh scores, spatial signs, plain scales about the median), the one with the
smallest determinant taken on until no determinant falls further, then one
reweighted estimate. Estimates of sources lean on those of their language with the
weight of ``PRIOR_ROWS`` rows, so that small sources have one too. Texts whose
squared distance is above ``CUTOFF`` are rejected.

The half is found exactly without ordering rows: distances are counted in classes of
a sixteenth of an octave, and the class on the border counts with the fraction that
completes the half. Every step is one count and one sum per group, both combined
before their shuffle, so a source of any size is no hot key.

Null texts have no words. A null lang or source is a value of its own. Texts that
fail the base rules take no part in the estimates. Repeated rows count each. Empty
tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import let
from corpusmill.session import BROADCAST_LIMIT_BYTES, salted_join, stage

LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "[#*$%&|<>]"
SPACE = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"

# Scales that differences below do not matter for, added to each variance: texts
# without any symbol or repetition have no variance of their own.
FLOORS = (1.5, 0.1, 0.05, 0.25, 0.25)
DIMS = len(FLOORS)
HALF = 0.5
PRIOR_ROWS = 50
STEADY = 1e-3  # a fall of the log-determinant that counts
MOST_STEPS = 100
CLASSES = 16  # distance classes per octave
ESTIMATE_BYTES = 400
STARTS = 3
CELLS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def chi2_cdf(x: float, k: int) -> float:
    """Share of a chi-squared distribution of ``k`` degrees below ``x``, by its series."""
    term = total = 1 / (k / 2)
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= x / 2 / (k / 2 + n)
        total += term
    return total * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 1e-9, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < p else (low, middle)
    return high


def consistency(p: float) -> float:
    """Factor that makes the scatter of the nearest share ``p`` that of a normal sample."""
    return p / chi2_cdf(chi2_quantile(p, DIMS), DIMS + 2)


CUTOFF = chi2_quantile(0.9999, DIMS)
NEAR = chi2_quantile(0.975, DIMS)


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that the text holds twice or more."""

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.when(k > 0, F.get(s, k - 1)["h"]) == x["h"], F.lit(False)))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        step = lambda p: F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW))))
        return let(ordered, lambda s: let(places(s), lambda p: F.aggregate(step(p), F.lit(0).cast("long"), lambda a, x: a + x)))

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered(windows))

    def joined(hashes: Column, reach: int) -> Column:
        """Hashes of each entry and the one ``reach`` places on (of itself alone near the end)."""
        return let(hashes, lambda h: F.zip_with(h, F.slice(h, F.lit(1 + reach), F.greatest(F.size(h) - reach, F.lit(0))), lambda x, y: F.xxhash64(x, y)))

    windows = joined(joined(joined(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    inside = let(windows, lambda w: let(F.slice(w, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))), of_windows))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(inside)


def statistics(docs: DataFrame) -> DataFrame:
    """Per document the base statistics, ``n_lines`` and ``base_failed``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP, -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("repeated")
    )
    counted = docs.select(
        F.col("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        let(words, of_words).alias("words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
    ).select(
        "doc_id",
        "lang",
        "source",
        F.col("words.n").alias("n_words"),
        F.col("words.chars").alias("word_chars"),
        "n_symbols",
        F.col("lines.dup").alias("n_dup_lines"),
        F.col("words.repeated").alias("n_repeat_words"),
        F.col("lines.n").alias("n_lines"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def vector() -> list[Column]:
    share = lambda part, whole: F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    return [
        F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    ]


def x(i: int) -> Column:
    return F.col(f"x{i}")


class Estimates:
    """Joins of vectors with the small table of their groups' estimates."""

    def __init__(self, vectors: DataFrame, groups: int):
        self.vectors = vectors
        self.small = groups * STARTS * ESTIMATE_BYTES <= BROADCAST_LIMIT_BYTES

    def join(self, rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
        if self.small:
            return rows.join(F.broadcast(table), list(keys))
        if len(keys) == 1:
            return salted_join(rows, table, keys[0], "row")
        both = lambda df: df.withColumn("_key", F.struct(*keys))
        return salted_join(both(rows), both(table).drop(*keys), "_key", "row").drop("_key")


def moments(rows: DataFrame, weight: Column, *keys: str) -> DataFrame:
    """Weighted sums per group: ``n, s_i, s_ij``."""
    sums = ["sum(w) AS n"] + [f"sum(w * x{i}) AS s{i}" for i in range(DIMS)] + [f"sum(w * x{i} * x{j}) AS s{i}_{j}" for i, j in CELLS]
    return rows.withColumn("w", weight).where("w > 0").groupBy(*keys).agg(*map(F.expr, sums))


def located(sums: DataFrame, factor: float, *keep: str) -> DataFrame:
    """Means ``m_i`` and scatters ``c_i_j`` of :func:`moments`."""
    means = [f"s{i} / n AS m{i}" for i in range(DIMS)]
    cells = [f"{factor!r}D * (s{i}_{j} / n - s{i} / n * (s{j} / n))" for i, j in CELLS]
    return sums.selectExpr(*keep, "n", *means, *[f"greatest({c}, 0D) AS c{i}_{j}" if i == j else f"{c} AS c{i}_{j}" for c, (i, j) in zip(cells, CELLS)])


def factored(estimates: DataFrame) -> DataFrame:
    """Adds ``k_i_j``, the inverse of the Cholesky factor of scatter and floors, and ``logdet``."""
    df, have = estimates, estimates.columns
    steps = []
    for j in range(DIMS):  # column by column, so that no expression is written out twice
        steps.append([(f"l{j}_{j}", f"sqrt(greatest(c{j}_{j} + {FLOORS[j] ** 2!r}D" + "".join(f" - l{j}_{k} * l{j}_{k}" for k in range(j)) + ", 1e-6D))")])
        steps.append([(f"l{i}_{j}", f"(c{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j)) + f") / l{j}_{j}") for i in range(j + 1, DIMS)])
    for i in range(DIMS):
        steps.append([(f"k{i}_{i}", f"1D / l{i}_{i}")] + [(f"k{i}_{j}", "-(" + " + ".join(f"l{i}_{k} * k{k}_{j}" for k in range(j, i)) + f") / l{i}_{i}") for j in range(i)])
    steps.append([("logdet", " + ".join(f"2D * ln(l{i}_{i})" for i in range(DIMS)))])
    for made in filter(None, steps):
        df = df.selectExpr("*", *[f"{e} AS {name}" for name, e in made])
    return df.select(*have, *[f"k{i}_{j}" for i, j in CELLS], "logdet")


FACTORS = [f"m{i}" for i in range(DIMS)] + [f"k{i}_{j}" for i, j in CELLS]


def squared_distance() -> Column:
    parts = ["(" + " + ".join(f"k{i}_{j} * (x{j} - m{j})" for j in range(i + 1)) + ")" for i in range(DIMS)]
    return F.expr(" + ".join(f"{p} * {p}" for p in parts))


def concentrate(data: Estimates, estimates: DataFrame) -> DataFrame:
    """One concentration step for every (scope, start)."""
    rows = data.join(data.vectors, estimates.select("scope", "start", *FACTORS), "scope")
    kind = F.floor(F.log2(squared_distance() + 1e-9) * CLASSES).cast("int")
    rows = rows.select("scope", "start", "row", *[x(i) for i in range(DIMS)], kind.alias("class"))
    counts = rows.groupBy("scope", "start", "class").agg(F.count("*").alias("c"))
    group = Window.partitionBy("scope", "start")
    upto = F.sum("c").over(group.orderBy("class"))
    half = F.ceil(F.sum("c").over(group) * HALF)
    border = counts.withColumn("below", upto - F.col("c")).withColumn("half", half).where("below < half").groupBy("scope", "start").agg(
        F.max("class").alias("cut"), F.max_by(F.least(F.lit(1.0), (F.col("half") - F.col("below")) / F.col("c")), "class").alias("part")
    )
    weight = F.when(F.col("class") < F.col("cut"), 1.0).when(F.col("class") == F.col("cut"), F.col("part")).otherwise(0.0)
    return factored(located(moments(data.join(rows, border, "scope", "start"), weight, "scope", "start"), consistency(HALF), "scope", "start"))


def starts(data: Estimates) -> DataFrame:
    """Three estimates of each scope about the median, in scales of the median deviation."""
    median = lambda c: F.percentile_approx(c, 0.5, 10000)
    middle = data.vectors.groupBy("scope").agg(*[median(x(i)).alias(f"m{i}") for i in range(DIMS)])
    middle = stage(middle, "medians")
    off = data.join(data.vectors, middle, "scope")
    scale = off.groupBy("scope").agg(*[(1.4826 * median(F.abs(x(i) - F.col(f"m{i}"))) + FLOORS[i]).alias(f"d{i}") for i in range(DIMS)])
    middle = stage(middle.join(scale, "scope"), "scales")
    z = data.join(data.vectors, middle, "scope").select("scope", *[((x(i) - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i in range(DIMS)])
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIMS)), F.lit(1e-12)))
    z = z.withColumn("length", length)
    tanh = lambda i: F.tanh(F.col(f"z{i}"))
    sign = lambda i: F.col(f"z{i}") / F.col("length")
    shapes = z.groupBy("scope").agg(
        F.count("*").cast("double").alias("n"), *[F.avg(f(i) * f(j)).alias(f"{name}{i}_{j}") for name, f in (("t", tanh), ("u", sign)) for i, j in CELLS]
    )
    both = shapes.join(middle, "scope")
    frames = []
    for start, name in enumerate(("t", "u", None)):

        def cell(i, j, name=name):
            scales = F.col(f"d{i}") * F.col(f"d{j}")
            if i == j or name is None:
                return scales if i == j else F.lit(0.0)
            return scales * F.col(f"{name}{i}_{j}") / F.sqrt((F.col(f"{name}{i}_{i}") + 1e-6) * (F.col(f"{name}{j}_{j}") + 1e-6))

        frames.append(both.select("scope", F.lit(start).alias("start"), "n", *[f"m{i}" for i in range(DIMS)], *[cell(i, j).alias(f"c{i}_{j}") for i, j in CELLS]))
    return factored(frames[0].unionAll(frames[1]).unionAll(frames[2]))


def estimate(data: Estimates) -> DataFrame:
    """Minimum-determinant estimate of each scope, before reweighting."""
    now = stage(starts(data), "starts")
    now = stage(concentrate(data, now), "step")
    now = stage(concentrate(data, now), "step")
    best = Window.partitionBy("scope").orderBy("logdet", "start")
    now = stage(now.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r"), "best")
    done = []
    for _ in range(MOST_STEPS):
        then = concentrate(data, now).join(now.select("scope", F.col("logdet").alias("was")), "scope")
        then = stage(then, "step")
        falls = F.col("logdet") < F.col("was") - STEADY
        # Scopes that fell no further keep what they had; the others go on.
        done.append(now.join(then.where(~falls).select("scope"), "scope", "left_semi"))
        now = then.where(falls).drop("was")
        if now.isEmpty():
            out = done[0]
            for more in done[1:]:
                out = out.unionAll(more)
            return stage(out, "estimates")
    raise RuntimeError(f"determinants still fall after {MOST_STEPS} steps")


def judge_documents(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Per document the base statistics, ``base_failed``, ``distance`` and ``kept``."""
    counted = stage(statistics(docs), "statistics")
    own, all_of = F.to_json(F.array("lang", "source")), F.to_json(F.array("lang"))
    rows = counted.where(~F.col("base_failed")).select(own.alias("own"), all_of.alias("all_of"), F.xxhash64("doc_id", "n_words", "word_chars").alias("row"), *[v.alias(f"x{i}") for i, v in enumerate(vector())])
    vectors = stage(rows, "vectors")
    both = vectors.withColumn("scope", F.explode(F.array("own", "all_of"))).drop("own", "all_of")
    groups = both.select("scope").distinct().count()
    data = Estimates(both, groups)
    if groups:
        first = estimate(data)
        near = data.join(both, first.select("scope", *FACTORS), "scope").withColumn("near", F.when(squared_distance() <= NEAR, 1.0).otherwise(0.0))
        again = stage(located(moments(near, F.col("near"), "scope"), consistency(0.975), "scope"), "reweighted")
        pairs = vectors.select("own", "all_of").distinct()
        # Every source's estimate leans on that of its language.
        lang = again.select(F.col("scope").alias("all_of"), *[F.col(c).alias(f"p_{c}") for c in again.columns if c != "scope"])
        source = again.withColumnRenamed("scope", "own")
        share = F.coalesce(F.col("n"), F.lit(0.0)) / (F.coalesce(F.col("n"), F.lit(0.0)) + PRIOR_ROWS)
        mixed = pairs.join(lang, "all_of").join(source, "own", "left").withColumn("share", share)
        mix = lambda c: (F.when(F.col("share") > 0, F.col("share") * F.col(c)).otherwise(0.0) + (1 - F.col("share")) * F.col(f"p_{c}")).alias(c)
        final = stage(factored(mixed.select(F.col("own").alias("scope"), *[mix(c) for c in again.columns if c not in ("scope", "n")])).select("scope", *FACTORS), "factors")
    else:
        final = docs.sparkSession.createDataFrame([], "scope string, " + ", ".join(f"{c} double" for c in FACTORS))
    good = counted.where(~F.col("base_failed")).select("*", own.alias("scope"), F.xxhash64("doc_id").alias("row"), *[v.alias(f"x{i}") for i, v in enumerate(vector())])
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = data.join(good, final, "scope").select(*base, squared_distance().alias("distance"))
    failed = counted.where("base_failed").select(*base, F.lit(None).cast("double").alias("distance"))
    return judged.unionAll(failed).withColumn("kept", F.coalesce(F.col("distance") <= cutoff, F.lit(False)))
