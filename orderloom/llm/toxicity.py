"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is learned: whole words and word beginnings that labelled toxic texts hold far more often
than others. Features are densities of both, their nearness to second-person pronouns, and the rates of
capitals, exclamation and question marks, other punctuation and obfuscated words (letters with digits or
signs inside). All of it is column expressions; only the fit is on a bounded sample of labelled rows.

Results for odd input: a NULL or empty text has features of zero and is scored like any text; a repeated
row is scored again; NULL labels are not learned from; an id labelled both ways counts as toxic; without
labelled rows of both classes every score is the share of toxic labels (0.0 without labels). Columns
other than the named ones are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import WORD, staged

# Second-person words of the languages in use.
SECOND_PERSON = (
    "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes ti tú"
).split()

FEATURES = [
    "word_density", "beginning_density", "near_second_person", "capitals", "shouting", "punctuation",
    "obfuscated", "log_words",
]


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit; scoring has none."""

    lexicon_rows: int = 12_000  # labelled rows that the lexicon is learned from, at most about
    model_rows: int = 20_000  # labelled rows that trees and calibration are fitted on, at most about
    terms: int = 60  # words, and beginnings, that the lexicon keeps
    beginnings: tuple[int, ...] = (4, 5, 6)
    least_ratio: float = 20.0  # times as frequent among toxic texts
    trees: int = 15
    depth: int = 3


@dataclass(frozen=True)
class Lexicon:
    words: tuple[str, ...]
    beginnings: tuple[str, ...]


def _sample(labels: DataFrame, rows: int, salt: int) -> DataFrame:
    """About ``rows`` of the labelled ids, chosen by hash. Its size is bounded, so it may be broadcast."""
    share = min(1.0, rows / max(1, labels.count()))
    return labels.where(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1_000_000)) < int(share * 1_000_000))


def _letters(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def learn_lexicon(texts: DataFrame, settings: Settings) -> Lexicon:
    """From (text, toxic): the terms with the highest frequency ratios, weighted by support."""
    words = _letters(F.col("text"))

    def beginnings(k: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) >= k), lambda w: F.concat(F.lit("b"), F.substring(w, 1, k)))

    forms = F.concat(F.transform(words, lambda w: F.concat(F.lit("w"), w)), *map(beginnings, settings.beginnings))
    sides = texts.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).first()
    toxic, other = sides["p"] or 0, sides["n"] or 0
    counts = (
        texts.select("toxic", F.explode(F.array_distinct(forms)).alias("term")).groupBy("term")
        .agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
        .where(F.col("p") >= max(3, toxic // 100))
    )
    ratio = F.log(((F.col("p") + 0.5) / (toxic + 1)) / ((F.col("n") + 0.5) / (other + 1)))
    best = counts.withColumn("ratio", ratio).where(F.col("ratio") >= F.log(F.lit(settings.least_ratio)))
    weight = (F.col("ratio") * F.sqrt("p")).desc()

    def top(kind: str, most: int) -> list[str]:
        kept = best.where(F.substring("term", 1, 1) == kind).orderBy(weight, "term").limit(most)
        return [r["term"][1:] for r in kept.collect()]

    beginnings = top("b", 20 * settings.terms)
    known = set(beginnings)
    shortest = [b for b in beginnings if not any(b[:k] in known for k in range(1, len(b)))]
    return Lexicon(tuple(top("w", settings.terms)), tuple(shortest[:settings.terms]))


def _any(terms) -> str:
    return "(?:" + "|".join(sorted(terms, key=lambda t: (-len(t), t))) + ")"


def features(text: Column, lexicon: Lexicon) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    lower = F.lower(text)
    words = F.greatest(F.regexp_count(text, F.lit(WORD)), F.lit(1)).cast("double")
    length = F.greatest(F.length(text), F.lit(1)).cast("double")

    def count(pattern: str | None, where: Column = text) -> Column:
        return F.regexp_count(where, F.lit(pattern)).cast("double") if pattern else F.lit(0.0)

    word = rf"(?<!\p{{L}}){_any(lexicon.words)}(?!\p{{L}})" if lexicon.words else None
    beginning = rf"(?<!\p{{L}}){_any(lexicon.beginnings)}" if lexicon.beginnings else None
    known = "|".join(p for p in (word, beginning) if p)
    near = rf"(?<!\p{{L}}){_any(SECOND_PERSON)}(?!\p{{L}})[^.!?\n]{{0,40}}?(?:{known})" if known else None
    hits, starts = count(word, lower), count(beginning, lower)
    return [
        (hits / words).alias("word_density"),
        (starts / words).alias("beginning_density"),
        F.when(hits + starts > 0, count(near, lower) / words).otherwise(0.0).alias("near_second_person"),
        (count(r"\p{Lu}") / length).alias("capitals"),
        (count("[!?]") / words).alias("shouting"),
        (count(r"\p{Punct}") / length).alias("punctuation"),
        (count(r"\p{L}[*@$#0-9]+\p{L}") / words).alias("obfuscated"),
        F.log1p(words).alias("log_words"),
    ]


@dataclass
class Model:
    lexicon: Lexicon
    trees: object | None
    calibration: object | None
    constant: float = 0.0

    def score(self, docs: DataFrame, text: str, name: str) -> DataFrame:
        """``docs`` with a column ``name``, the probability of the label. Other columns stay as they are."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.constant))
        rows = docs.select(F.struct("*").alias("row"), *features(F.col(text), self.lexicon))
        scored = self.calibration.transform(_raw(self.trees, rows).select("row", "raw"))
        value = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
        kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c != name]
        return scored.select(*kept, value.alias(name))


def _raw(trees, rows: DataFrame) -> DataFrame:
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return trees.transform(vectors).withColumn("raw", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


#: Tasks that learn from the bounded sample, which is read from its staged table; the documents are read by all.
SAMPLE_TASKS = 6


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text",
        label: str = "toxic") -> Model:
    """Learn from the rows of ``labels`` that have a document."""
    marked = (
        labels.where(F.col(id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    )
    marked = staged(marked, "toxicity-labels")
    narrow = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    word_rows = F.broadcast(_sample(marked, settings.lexicon_rows, 1))
    lexicon = learn_lexicon(staged(narrow.join(word_rows, "id").select("text", "toxic"), "toxicity-texts"), settings)
    model_rows = F.broadcast(_sample(marked, settings.model_rows, 2))
    rows = staged(
        narrow.join(model_rows, "id").select(
            F.col("toxic").cast("double").alias("label"), *features(F.col("text"), lexicon),
            (F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(4)) == 0).alias("held"),
        ),
        "toxicity-features",
    ).coalesce(SAMPLE_TASKS)
    sides = {(r["held"], r["label"]): r["n"] for r in rows.groupBy("held", "label").agg(F.count("*").alias("n")).collect()}
    total = sum(sides.values())
    if any((False, x) not in sides for x in (0.0, 1.0)):
        return Model(lexicon, None, None, sum(n for (_, x), n in sides.items() if x) / total if total else 0.0)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=settings.trees, maxDepth=settings.depth, seed=1,
    ).fit(vectors.transform(rows.where("NOT held")))
    both = all((True, x) in sides for x in (0.0, 1.0))
    judged = _raw(trees, rows.where("held") if both else rows)
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="prediction").fit(judged)
    return Model(lexicon, trees, calibration)
