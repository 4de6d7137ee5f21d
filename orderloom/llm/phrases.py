"""Phrase collocations by top-order marginalisation.

Every word opens one window: the word and the two after it, read from columns that lead by one and two
places and padded with the empty text where the piece ends. Only these windows are counted. An occurrence
of a shorter phrase opens exactly one window, so its count is the sum over the windows that it begins:
ROLLUP over the counted windows gives the counts of pairs, of words and of all words of a language.

Counts are reduced before each shuffle, and keys are whole windows, so that a common word or pair is spread
over tasks like any other. Scores are decimals of 38 digits: exact while a phrase occurs fewer than 5e15 times.

Results for odd input: a NULL text is empty and has no words; a NULL group counts as ``und`` (together with
a group of that name); repeated rows count again; an empty table gives an empty result. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import staged

#: Fixed value: characters that end a piece.
ENDS = ".,;:!?\n\x0b\x0c\r"
BREAK, PAD = "\n", ""  # no word is one of these
UNKNOWN = "und"
#: Bytes of text whose windows a task counts before it hands the counts on.
STEP_BYTES = 22_000_000
#: Pairs that open one window of HOT or more in about SAMPLE documents are dealt to SALTS tasks by their third word.
SAMPLE, HOT, SALTS = 2000, 1000, 64

_PLAIN = bytes.maketrans(
    (string.ascii_uppercase + ENDS + "\t").encode(), (string.ascii_lowercase + BREAK * len(ENDS) + " ").encode())


def _windows(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, windows, counts): distinct windows as rows of three places in the sorted ``words``, in order.

    The word at place 0 is ``PAD``. Windows lead by one and two words within a piece.
    """
    flat = BREAK.encode().join(texts).translate(_PLAIN).replace(b"\n", b" \n ")
    split = pc.split_pattern(pa.array([b"\n " + flat], pa.large_binary()).cast(pa.large_string()), " ").flatten()
    coded = split.dictionary_encode()
    del flat, split
    # The text's own empty words, where blanks meet, are dropped. PAD is put first and stays first in order.
    words = pa.concat_arrays([pa.array([PAD], pa.large_string()), coded.dictionary])
    codes = coded.indices.to_numpy() + np.int32(1)
    stop = codes[0]
    empty = pc.index(coded.dictionary, PAD).as_py() + 1
    order = pc.sort_indices(words).to_numpy()
    place = np.empty(len(words), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    words = words.take(pa.array(order))
    if empty:
        codes = codes[codes != empty]
    a = np.where(codes == stop, np.int32(0), place[codes])
    del coded, codes
    b, c = np.append(a[1:], np.int32(0)), np.append(a[2:], np.zeros(2, np.int32))[:len(a)]
    opens = np.flatnonzero(a)
    a, b, c = a[opens], b[opens], c[opens]
    c[b == 0] = 0
    pair = a.astype(np.int64) * len(words) + b
    if len(words) ** 3 >= 1 << 63:
        pair = np.unique(pair, return_inverse=True)[1]
    _, first, counts = np.unique(pair * len(words) + c, return_index=True, return_counts=True)
    return words, np.stack((a[first], b[first], c[first]), 1).astype(np.int64), counts


def _dealt(words: pa.Array, found: np.ndarray, hot: list[tuple[str, str]]) -> np.ndarray:
    """Per window a number for the task that counts it: -1, or the share of the third word if the pair is hot."""
    salts = np.full(len(found), -1, np.int32)
    places = [pc.index_in(pa.array([p[i] for p in hot], pa.large_string()), words).to_numpy(zero_copy_only=False) for i in (0, 1)]
    known = ~(np.isnan(places[0].astype(float)) | np.isnan(places[1].astype(float)))
    keys = places[0][known].astype(np.int64) * len(words) + places[1][known].astype(np.int64)
    chosen = np.flatnonzero(np.isin(found[:, 0] * len(words) + found[:, 1], keys))
    salts[chosen] = [zlib.crc32(w) % SALTS for w in words.take(pa.array(found[chosen, 2])).cast(pa.large_binary()).to_pylist()]
    return salts


def windows(docs: DataFrame, text: str = "text", group: str = "lang", hot: Iterable[tuple[str, str, str]] = ()) -> DataFrame:
    """(lang, pair, salt, thirds, counts, f): windows counted by the batch and those that open with the same pair put in
    one row. Words are joined by blanks; counts are empty if all are one; f is their sum."""
    by_lang: dict[str, list[tuple[str, str]]] = {}
    for lang, a, b in hot:
        by_lang.setdefault(lang, []).append((a, b))

    def counted(texts: list[bytes], lang: str) -> Iterator[pa.RecordBatch]:
        words, found, counts = _windows(texts)
        salts = _dealt(words, found, by_lang.get(lang, []))
        opens = np.flatnonzero((salts >= 0) | np.append(True, (found[1:, :2] != found[:-1, :2]).any(1))[:len(found)])
        for at in range(0, len(opens), 100_000):
            first = opens[at:at + 100_000]
            end = opens[at + 100_000] if at + 100_000 < len(opens) else len(found)
            offsets, n = pa.array(np.append(first, end) - first[0], pa.int32()), counts[first[0]:end]
            thirds = pc.binary_join(pa.ListArray.from_arrays(offsets, words.take(pa.array(found[first[0]:end, 2])).cast(pa.string())), " ")
            texts = pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array(n).cast(pa.string())), " ")
            plain = np.maximum.reduceat(n, first - first[0]) == 1
            pair = pc.binary_join_element_wise(
                words.take(pa.array(found[first, 0])), words.take(pa.array(found[first, 1])), pa.scalar(" ", pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), len(first)), pair.cast(pa.string()), pa.array(salts[first]), thirds,
                 pc.if_else(pa.array(plain), "", texts), pa.array(np.add.reduceat(n, first - first[0]))],
                ["lang", "pair", "salt", "thirds", "counts", "f"],
            )

    def work(batches: Iterator[pa.RecordBatch]):
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                for lang, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    held.setdefault(lang, []).append(t)
                    size += len(t)
                if size > STEP_BYTES:
                    for lang in list(held):
                        yield from counted(held.pop(lang), lang)
                    size = 0
        for lang in list(held):
            yield from counted(held.pop(lang), lang)

    rows = docs.select(F.coalesce(F.col(group), F.lit(UNKNOWN)), F.coalesce(F.col(text), F.lit("")))
    return rows.mapInArrow(work, "lang string NOT NULL, pair string NOT NULL, salt int NOT NULL, thirds string, counts string, f long")


def _first(pair: str) -> Column:
    return F.substring_index(pair, " ", 1)


def _second(pair: str) -> Column:
    return F.substring_index(pair, " ", -1)


def hot_pairs(docs: DataFrame, text: str = "text", group: str = "lang") -> list[tuple[str, str, str]]:
    """At most ``HOT`` pairs (lang, a, b). They decide which task counts what, never a count."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    pairs = windows(docs.sample(share, seed=1), text, group).groupBy("lang", "pair").agg(F.sum("f").alias("f"))
    pairs = pairs.withColumn("all", F.sum("f").over(Window.partitionBy()))
    return [(r["lang"], *r["pair"].split(" ")) for r in pairs.where(f"{HOT} * f >= all").collect()]


def counted(docs: DataFrame, least: int, text: str = "text", group: str = "lang") -> DataFrame:
    """(lang, a, b, c, f) of all phrases of one to three words found ``least`` times or more, and the words of
    each language under the phrase without words (a, b, c all ``PAD``). Missing words are ``PAD``.

    A window comes to one task with the others that its pair opens, but for hot pairs, which are dealt by the third word.
    """
    each = windows(docs, text, group, hot_pairs(docs, text, group)).repartition("lang", "pair", "salt")
    # Every branch reads all columns, so that they share one shuffle.
    f = F.when(F.col("thirds").isNotNull() & F.col("counts").isNotNull() & (F.col("salt") >= -1), F.col("f"))
    keys = ["lang", "pair", "salt"]
    pairs = each.groupBy(*keys).agg(F.sum(f).alias("f")).where((F.col("f") >= least) | (F.col("salt") >= 0))
    # Only a pair that is found often opens windows that are; both lie in one task. The others pass with no window left.
    longest = each.join(pairs.select(*keys, F.lit(True).alias("often")).hint("shuffle_hash"), keys, "left")
    counts = F.when(F.col("counts") == "", F.expr("array_repeat(1L, cast(f AS int))")).otherwise(F.split("counts", " ").cast("array<long>"))
    zipped = F.arrays_zip(F.split("thirds", " ").alias("c"), counts.alias("f"))
    longest = longest.select(*keys, F.inline_outer(F.when(F.col("often"), zipped))).where(F.col("c") != PAD)
    longest = longest.groupBy(*keys, "c").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("lang", "pair", "c", "f")
    pairs = pairs.groupBy("lang", "pair").agg(F.sum("f").alias("f")).select("lang", "pair", F.lit(PAD).alias("c"), "f")
    longest = pairs.union(longest).select("lang", _first("pair").alias("a"), _second("pair").alias("b"), "c", "f")
    longest = longest.where(F.when(F.col("b") != PAD, F.col("f")) >= least)  # about a sum: not taken before the shuffle

    words = each.select("lang", _first("pair").alias("a"), f.alias("f"))
    words = words.rollup("lang", "a").agg(F.sum("f").alias("f"), F.grouping_id().alias("level"))
    words = words.where(f"level = 1 OR level = 0 AND f >= {least}")
    words = words.select("lang", F.coalesce("a", F.lit(PAD)).alias("a"), F.lit(PAD).alias("b"), F.lit(PAD).alias("c"), "f")
    return words.union(longest)


def _score(l: str, r: str) -> Column:
    wide = {x: F.col(x).cast("decimal(19,0)") for x in ("f", l, r)}
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide["f"] * wide["f"], wide[l] * wide[r])


def collocations(docs: DataFrame, least: int = 10, held: int = 50, best: int = 2000, text: str = "text",
                 group: str = "lang") -> DataFrame:
    """Per language the ``best`` phrases: lang, rank, phrase, a (its count), l, r, n, score.

    A pair is dropped if a phrase of three words around it, found ``least`` times or more, has ``held`` of 100 of its count.
    """
    found = staged(counted(docs, least, text, group), "phrases-counted")
    total = found.where(F.col("a") == PAD).select("lang", F.col("f").alias("n"))
    words = found.where((F.col("a") != PAD) & (F.col("b") == PAD)).select("lang", "a", "f")
    pairs = found.where((F.col("b") != PAD) & (F.col("c") == PAD)).select("lang", "a", "b", "f")
    triples = found.where(F.col("c") != PAD)

    around = triples.select("lang", "a", "b", "f").union(triples.select("lang", "b", "c", "f"))
    around = around.groupBy("lang", "a", "b").agg(F.max("f").alias("longer"))
    cut = pairs.join(words.withColumnRenamed("f", "l"), ["lang", "a"])
    cut = cut.join(words.select("lang", F.col("a").alias("b"), F.col("f").alias("r")), ["lang", "b"])
    cut = cut.join(around, ["lang", "a", "b"], "left").where("longer IS NULL OR 100 * longer < %d * f" % held)
    two = cut.select("lang", F.concat_ws(" ", "a", "b").alias("phrase"), "f", "l", "r", _score("l", "r").alias("score"))

    cut = triples.join(words.withColumnRenamed("f", "l1"), ["lang", "a"])
    cut = cut.join(words.select("lang", F.col("a").alias("c"), F.col("f").alias("r2")), ["lang", "c"])
    cut = cut.join(pairs.select("lang", "a", "b", F.col("f").alias("l2")), ["lang", "a", "b"])
    cut = cut.join(pairs.select("lang", F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("r1")), ["lang", "b", "c"])
    cut = cut.withColumns({"s1": _score("l1", "r1"), "s2": _score("l2", "r2")})
    second = F.col("s2") < F.col("s1")
    three = cut.select(
        "lang", F.concat_ws(" ", "a", "b", "c").alias("phrase"), "f", F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    top = two.union(three).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return top.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
