"""Quality rules whose cutoffs are certified on labelled holdouts.

Features of each text are SQL expressions over its words and lines, worked out row by row without a
shuffle.  Each rule rejects texts whose badness exceeds a cutoff.  For each stratum and rule the
strictest cutoff is taken whose false-rejection rate among documents labelled good is shown to be at
most ``risk / rules``: the exact binomial tail P(Bin(n, risk) <= k) must not exceed
``delta / (strata * rules)`` (Bonferroni over strata and rules; within a rule, k only grows with
strictness, so cutoffs form a fixed sequence and need no further correction).  A rule that no cutoff
passes rejects nothing in that stratum, so with few or no labels everything is kept.

Native: DataFrame functions only.  Five-word windows are compared by 64-bit hashes inside one text.
Null and empty texts have no words and fail the base rule.  Null strata form a stratum.  Labels of
one id are combined by their lowest quality; ids without a label, or with a null one, certify nothing.
Repeated rows are judged one by one; very long texts are judged whole; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

#: Rules: a name, its badness, and cutoffs from lenient to strict.
RULES = {
    "short_words": (lambda: -F.col("word_chars") / F.col("n_words"), (-2.0, -2.5, -3.0, -3.25, -3.5, -3.75, -4.0)),
    "long_words": (lambda: F.col("word_chars") / F.col("n_words"), (40.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
    "symbols": (lambda: F.col("n_symbols") / F.col("n_words"), (2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "repeated_lines": (lambda: F.col("n_dup_lines") / F.col("n_lines"), (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "repeated_words": (lambda: F.col("n_repeat_words") / F.col("n_words"), (0.19, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.05)),
}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, n: int = 5) -> Column:
    """Words inside windows of ``n`` words that occur twice or more, each counted once."""
    grams = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))

    def of_sorted(s):
        same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
        found = F.filter(F.transform(s, lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["p"])), lambda p: p.isNotNull())
        return let(F.array_sort(found), lambda d: F.aggregate(F.transform(d, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(d, k + 1) - p, F.lit(n)))), F.lit(0).cast("long"), lambda a, x: a + x))

    repeats = lambda g: let(F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), of_sorted)
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(repeats(g)))


def text_features(text: Column) -> Column:
    """A struct of counts for one text; null counts as empty."""

    def of(t):
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
        return let(
            F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
            lambda w: let(
                lines,
                lambda ln: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                    (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
                    F.greatest(F.size(ln), F.lit(1)).cast("long").alias("n_lines"),
                    repeated_words(w).alias("n_repeat_words"),
                ),
            ),
        )

    return let(F.coalesce(text, F.lit("")), of)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly summed in logarithms; 1 where k is above the mean, which never certifies."""
    import math

    def log_factorial(x):
        d = x.cast("double")
        series = d * F.log(d) - d + 0.5 * F.log(2 * math.pi * d) + 1 / (12 * d) - 1 / (360 * d * d * d)
        return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)

    term = lambda j: F.exp(log_factorial(n) - log_factorial(j) - log_factorial(n - j) + j * math.log(p) + (n - j) * math.log1p(-p))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.lit(0.0), lambda a, j: a + term(j)))


def certified_cutoffs(features: DataFrame, labels: DataFrame, stratum: str, risk: float, delta: float, id_col: str) -> DataFrame:
    """One row for each stratum: the certified cutoff of each rule, null where none is."""
    good = labels.groupBy(F.col(id_col)).agg(F.min("quality").alias("_quality")).filter("_quality = 1").select(F.col(id_col).alias("_id"))
    held = features.join(good, F.col(id_col) == F.col("_id")).filter("n_words > 0")
    counts = held.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(bad() > c).alias(f"{r}_{i}") for r, (bad, cuts) in RULES.items() for i, c in enumerate(cuts)])
    counts = written(counts, "quality-counts")
    strata = max(1, counts.count())
    each = risk / len(RULES)
    level = delta / (strata * len(RULES))
    chosen = [F.min(F.least(*[F.when(binomial_tail(F.col(f"{r}_{i}"), F.col("n"), each) <= level, F.lit(c)) for i, c in enumerate(cuts)])).alias(f"cut_{r}") for r, (_, cuts) in RULES.items()]
    return written(counts.groupBy("stratum").agg(*chosen), "quality-cuts")


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one row for each document."""
    feats = docs.select(F.col(id_col), F.col(stratum).alias("_stratum"), text_features(F.col(text_col)).alias("_f")).select(id_col, "_stratum", "_f.*")
    feats = written(feats, "quality-features")
    cuts = certified_cutoffs(feats, labels, "_stratum", risk, delta, id_col)
    small = cuts.count() <= 10_000  # one row for each stratum
    judged = feats.join(F.broadcast(cuts) if small else cuts, F.col("_stratum").eqNullSafe(F.col("stratum")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rejected = F.lit(False)
    for r, (bad, _) in RULES.items():
        rejected = rejected | F.coalesce(F.when(F.col("n_words") > 0, bad()) > F.col(f"cut_{r}"), F.lit(False))
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))
