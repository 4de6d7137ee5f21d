"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule says good (1), bad (-1) or nothing (0) about a text. How often a rule gives each vote on good
and on bad texts is estimated by expectation-maximisation over the counts of vote patterns (at most
3 to the number of rules, whatever the input). The probability that a text is good, given its votes,
decides. Everything per text is column expressions.

Results for odd input: a NULL text is an empty one, has no words and fails; a repeated row is judged
again; an empty table gives an empty result. The operator reads only the named columns; ``judge`` hands
other columns through and replaces those that have its own output's names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import SPACES, let

LEAST_WORDS = 50
MOST_REPEATED = 50  # words in repeated windows, of 100


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words of an array that lie in a three-word window found twice or more, its first place included.

    Windows are compared by hash, sorted with their places; equal ones are neighbours then.
    """

    def windows(w: Column) -> Column:
        all_places = F.transform(
            w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.slice(all_places, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.get(s, i + 1)["h"].eqNullSafe(x["h"]) | F.get(s, i - 1)["h"].eqNullSafe(x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")

    def measured(w: Column) -> Column:
        found = let(F.sort_array(windows(w)), lambda s: let(places(s), covered))
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(found)

    return let(words, measured)


def features(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    length = F.length(text)
    return [
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _count(text, "#*$%&|<>").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("_lines"),
        _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_capitals"),
        _count(text, "0123456789").alias("_digits"),
        _count(text, ".!?").alias("_ends"),
        length.alias("_length"),
    ]


def _vote(bad: Column | None = None, good: Column | None = None) -> Column:
    vote = F.when(bad, -1) if bad is not None else F.when(F.lit(False), 0)
    return (vote.when(good, 1) if good is not None else vote).otherwise(0)


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, Column]:
    """Votes over the columns of ``measure``. Most rules know one fault and abstain otherwise."""
    mean, symbols = _share("word_chars", "n_words"), _share("n_symbols", "n_words")
    repeats, capitals = _share("n_repeat_words", "n_words"), _share("_capitals", "_length")
    lines, digits, ends = _share("n_dup_lines", "_n_lines"), _share("_digits", "_length"), _share("_ends", "n_words")
    return {
        "length": _vote(F.col("n_words") < 10),
        "word_length": _vote((mean < 2) | (mean > 14)),
        "symbols": _vote(symbols > 0.25),
        "lines": _vote(lines > 0.5),
        "repeats": _vote(repeats > 0.4),
        "capitals": _vote(capitals > 0.35),
        "digits": _vote(digits > 0.25),
        "sentences": _vote((ends < 0.003) | (ends > 0.7), ends.between(0.01, 0.3)),
        "plain": _vote(None, (symbols < 0.1) & (capitals < 0.2) & (repeats < 0.4) & (lines < 0.5)),
    }


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and the measures of every text, with the votes as an array."""
    rows = docs.select(*keep, *features(F.col(text)))
    rows = rows.select(
        *keep, F.col("_words.n").alias("n_words"), "word_chars", "n_symbols", F.col("_lines.d").alias("n_dup_lines"),
        F.col("_words.r").alias("n_repeat_words"), F.col("_lines.n").alias("_n_lines"), "_capitals", "_digits", "_ends", "_length",
    )
    return rows.withColumn("votes", F.array(*rules().values())).drop("_n_lines", "_capitals", "_digits", "_ends", "_length")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Weights:
    """Log odds that a text is good: ``prior`` and, per rule, what each vote adds."""

    prior: float
    votes: tuple[dict[int, float], ...]

    def probability(self, votes: Column) -> Column:
        odds = F.lit(self.prior)
        for i, says in enumerate(self.votes):
            vote = votes[i]
            odds = odds + F.when(vote == 1, says[1]).when(vote == -1, says[-1]).otherwise(says[0])
        return 1 / (1 + F.exp(-odds))


#: What is believed of a rule before any text is seen, worth BELIEF texts: how often it votes bad, nothing and good.
BELIEF = 20.0
ON_GOOD = {-1: 0.01, 0: 0.49, 1: 0.50}
ON_BAD = {-1: 0.30, 0: 0.45, 1: 0.25}


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> Weights:
    """Expectation-maximisation over (votes, number of texts)."""
    width = len(patterns[0][0]) if patterns else len(rules())
    good, bad = [dict(ON_GOOD) for _ in range(width)], [dict(ON_BAD) for _ in range(width)]
    share = 0.85
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        weighed = []
        for votes, n in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(good[i][v] / bad[i][v]) for i, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
            weighed.append((votes, n * p, n * (1 - p)))
        share = (sum(g for _, g, _ in weighed) + 0.85 * BELIEF) / (total + BELIEF)
        for side, believed, k in ((good, ON_GOOD, 1), (bad, ON_BAD, 2)):
            mass = sum(w[k] for w in weighed) + BELIEF
            for i in range(width):
                for v in (-1, 0, 1):
                    side[i][v] = (sum(w[k] for w in weighed if w[0][i] == v) + BELIEF * believed[v]) / mass
    return Weights(
        math.log(share / (1 - share)),
        tuple({v: math.log(good[i][v] / bad[i][v]) for v in (-1, 0, 1)} for i in range(width)),
    )


def fit(measured: DataFrame) -> Weights:
    """Weights from every text's votes; short or repetitive texts count as well."""
    counts = measured.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3 ** rules rows
    return estimate(sorted((tuple(r["votes"]), r["n"]) for r in counts))


def judge(measured: DataFrame, weights: Weights, threshold: float = 0.5) -> DataFrame:
    """``measured`` with base_failed, quality (probability) and kept."""
    rows = measured.withColumn("base_failed", base_failed()).withColumn("quality", weights.probability(F.col("votes")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
