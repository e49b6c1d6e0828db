"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (0) or abstains (null) on a document's statistics. Expectation-maximisation over the
counts of vote patterns (at most 3 ** len(RULES) rows, whatever the corpus) estimates how often each rule is right
on good and on bad documents; a document's verdict is its posterior probability of being good. The statistics are
computed once, per row and without a shuffle, and kept in the shared folder.

Defined results: null and empty texts have no words and fail the base rule; n_words, n_repeat_words and so on are
counted over whole texts; repeated rows get equal results; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
KEEP = 0.5
ROUNDS, TOLERANCE = 30, 1e-4


def _per(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, F.lit(1)).when(bad, F.lit(0))


#: Thresholds leave a middle where a rule abstains.
RULES = {
    "long_enough": lambda s: _vote(s("n_words") >= 60, s("n_words") < 20),
    "word_length": lambda s: _vote(_per(s("word_chars"), s("n_words")).between(2.5, 12), ~_per(s("word_chars"), s("n_words")).between(1.5, 20)),
    "few_symbols": lambda s: _vote(s("n_symbols") <= 0.05 * s("n_words"), s("n_symbols") > 0.25 * s("n_words")),
    "symbol_share": lambda s: _vote(s("n_symbols") <= 0.01 * s("word_chars"), s("n_symbols") > 0.05 * s("word_chars")),
    "letters": lambda s: _vote(s("n_letters") >= 0.85 * s("word_chars"), s("n_letters") < 0.75 * s("word_chars")),
    "few_repeated_lines": lambda s: _vote(s("n_dup_lines") <= 0.1 * s("n_lines"), s("n_dup_lines") > 0.5 * s("n_lines")),
    "few_repeated_words": lambda s: _vote(s("n_repeat_words") <= 0.1 * s("n_words"), s("n_repeat_words") > 0.4 * s("n_words")),
    "lower_case": lambda s: _vote(s("n_upper") <= 0.15 * s("word_chars"), s("n_upper") > 0.5 * s("word_chars")),
    "sentences": lambda s: _vote(s("n_stops").between(0.02 * s("n_words"), 0.4 * s("n_words")), s("n_stops") > 0.8 * s("n_words")),
    "few_shouts": lambda s: _vote(s("n_shouts") <= 0.1 * s("n_words"), s("n_shouts") > 0.5 * s("n_words")),
    "few_digits": lambda s: _vote(s("n_digits") <= 0.1 * s("word_chars"), s("n_digits") > 0.4 * s("word_chars")),
}


def _count(text: str, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row's whole text."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("w", F.filter(F.split("t", SPACES), lambda x: x != ""))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n", F.size("w")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    windows = F.greatest(F.col("n") - 2, F.lit(0))
    part = lambda c, start: F.slice(c, start, windows)
    pairs = F.zip_with(part("h", 1), part("h", 2), lambda a, b: F.xxhash64(a, b))
    d = d.withColumn("g", F.when(F.col("n") < 3, F.array().cast("array<bigint>")).otherwise(F.zip_with(pairs, part("h", 3), lambda a, b: F.xxhash64(a, b))))
    # windows found twice or more: neighbours in the sorted list of (hash, place)
    d = d.withColumn("some", F.size(F.array_distinct("g")) < F.size("g"))
    d = d.withColumn("s", F.when(F.col("some"), F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    rest = F.size("s") - 1
    d = d.withColumn("e", F.when(F.col("some"), F.zip_with(F.slice("s", 2, rest), F.slice("s", 1, rest), lambda a, b: a["h"] == b["h"])))
    marked = F.arrays_zip(F.col("s").alias("s"), F.concat(F.array(F.lit(False)), "e").alias("p"), F.concat("e", F.array(F.lit(False))).alias("q"))
    places = F.array_sort(F.transform(F.filter(marked, lambda z: z["p"] | z["q"]), lambda z: z["s"]["i"]))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    covered = F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    return d.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        _count("t", SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("some"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _count("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÍÓÁÚ").alias("n_upper"),
        F.length(F.regexp_replace("t", r"\P{L}+", "")).cast("long").alias("n_letters"),
        _count("t", ".?").alias("n_stops"),
        _count("t", "!").alias("n_shouts"),
        _count("t", "0123456789").alias("n_digits"),
    )


def votes(stats: DataFrame) -> DataFrame:
    """stats with a column for each rule: 1, 0 or null."""
    return stats.withColumns({k: rule(F.col) for k, rule in RULES.items()})


def _posterior(prior: float, right: dict[str, tuple[float, float]]) -> Column:
    """P(good | votes), for the rates at which each rule is right on good and on bad documents."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for k, (good, bad) in right.items():
        odds = odds + F.coalesce(F.when(F.col(k) == 1, F.lit(math.log(good / (1 - bad)))).when(F.col(k) == 0, F.lit(math.log((1 - good) / bad))), F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def estimate(voted: DataFrame) -> tuple[float, dict[str, tuple[float, float]]]:
    """Prior and rates by expectation-maximisation."""
    # at most 3 ** len(RULES) patterns
    patterns = voted.groupBy(*RULES).agg(F.count("*").alias("n")).coalesce(1).cache()
    prior, right = 0.5, dict.fromkeys(RULES, (0.5, 0.5))
    against = sum((F.coalesce(1 - F.col(k), F.lit(0)) for k in RULES), F.lit(0))
    for i in range(ROUNDS):
        p, n = F.col("p"), F.col("n")
        sums = [F.sum(n).alias("all"), F.sum(n * p).alias("good")]
        for k in RULES:
            v = F.col(k)
            sums += [F.sum(F.when(c, n * w)).alias(f"{k}_{x}") for x, c, w in (("gg", v == 1, p), ("ga", v.isNotNull(), p), ("bb", v == 0, 1 - p), ("ba", v.isNotNull(), 1 - p))]
        # the first round takes documents with a vote against them as bad
        first = F.when(against > 0, F.lit(0.05)).otherwise(F.lit(0.98))
        got = patterns.withColumn("p", _posterior(prior, right) if i else first).agg(*sums).first()
        if not got["all"]:
            break
        share = lambda a, b, start: min(0.999, max(0.5, ((got[a] or 0) + 2 * start) / ((got[b] or 0) + 2)))  # noqa: E731, B023
        new = {k: (share(f"{k}_gg", f"{k}_ga", 0.9), min(0.999, max(0.02, ((got[f"{k}_bb"] or 0) + 1.2) / ((got[f"{k}_ba"] or 0) + 2)))) for k in RULES}
        before, prior = prior, min(0.99, max(0.05, (got["good"] + 8) / (got["all"] + 10)))
        change = max([abs(prior - before), *(abs(a - b) for k in RULES for a, b in zip(new[k], right[k], strict=True))])
        right = new
        if change < TOLERANCE:
            break
    patterns.unpersist()
    return prior, right


def judge(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, base statistics, base_failed, posterior, kept for each row of docs."""
    voted = votes(written(statistics(docs)))
    posterior = _posterior(*estimate(voted))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (posterior >= keep)).alias("kept"), posterior.alias("posterior"))
