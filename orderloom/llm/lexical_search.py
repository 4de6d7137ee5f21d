"""Ranked lexical search by a scan of the documents with an Aho-Corasick automaton.

The automaton holds all terms of all items, each between guards, so that it reports whole terms alone. One
scan of a text gives how often each term occurs; no index of documents is built. What the automaton reports
leads to the items that hold the term. Counts are staged once: from them come the statistics of the
collection and the scores. A task keeps the best documents of each item, and only these are shuffled.

Items pass the driver in lots whose terms fit ``AUTOMATON_CHARACTERS`` (a longer item is a lot of its own);
each lot is one scan, so what is broadcast stays bounded however many items there are.

Results for odd input: a NULL or empty text, of an item or a document, has no term; an item without a
document that scores has no row; a repeated item row is searched again and ranked by itself; a repeated
document row is another document; documents without id are last among equal scores; an empty table gives
an empty result. Only the named columns are read. Document ids are integers.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import staged

AUTOMATON_CHARACTERS = 8_000_000
#: Scores held at once while a task reads: documents of a step times items.
CELLS = 2_000_000
LENGTH_SHARE, SCALE = 75, 1_000_000_000

_TERM = (string.ascii_letters + string.digits).encode() + bytes(range(0x80, 0x100))
#: Bytes of a text to bytes of terms: A-Z become a-z, what is in no term becomes the guard.
_GUARD = b" "
_TO_TERMS = bytes(b if b in _TERM else _GUARD[0] for b in range(256)).lower()


def _guarded(text: str | None) -> bytes:
    return _GUARD + (text or "").encode("utf-8", "surrogatepass").translate(_TO_TERMS) + _GUARD


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order."""
    return _guarded(text).split()


def _automaton(known: list[bytes]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, term in enumerate(known):
        automaton.add_word((_GUARD + term + _GUARD).decode("latin-1"), i)
    automaton.make_automaton()
    return automaton


@lru_cache(1)
def _built(shared: Broadcast):
    """Once a worker, which keeps a broadcast value as one object."""
    return _automaton(shared.value)


def occurrences(text: str | None, automaton) -> tuple[int, dict[int, int]]:
    """(terms of the text, how often each term of the automaton is one of them)."""
    guarded = _guarded(text)
    inside = np.frombuffer(guarded, np.uint8) != _GUARD[0]
    n = int(np.count_nonzero(inside[1:] & ~inside[:-1]))
    if not n or not len(automaton):
        return n, {}
    return n, Counter(map(itemgetter(1), automaton.iter(guarded.decode("latin-1"))))


def scan(docs: DataFrame, known: list[bytes], id: str, text: str) -> DataFrame:
    """Per document: id, n (its terms), and the numbers of the terms of ``known`` in it with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]):
        automaton = _built(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                counts = [occurrences(t, automaton) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for n, _ in counts], pa.int64()),
                     pa.array([list(c) for _, c in counts], pa.list_(pa.int32())),
                     pa.array([list(c.values()) for _, c in counts], pa.list_(pa.int64()))],
                    ["id", "n", "terms", "tf"],
                )

    rows = docs.select(F.col(id).cast("long").alias("id"), text)
    return rows.mapInArrow(work, "id long, n long, terms array<int>, tf array<long>")


class Best:
    """The best documents of each item so far: by score, then by id, rows without id last."""

    def __init__(self, items: int, most: int):
        self.most = most
        self.item = np.zeros(0, np.int64)
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.gone = np.zeros(0, bool)
        self.least = np.ones(items, np.int64)  # what a document must reach

    def add(self, scores: np.ndarray, ids: np.ndarray, gone: np.ndarray) -> None:
        """``scores``: documents by items."""
        doc, item = np.nonzero(scores >= self.least)
        if not len(doc):
            return
        score = np.concatenate((self.score, scores[doc, item]))
        item = np.concatenate((self.item, item))
        id, none = np.concatenate((self.id, ids[doc])), np.concatenate((self.gone, gone[doc]))
        order = np.lexsort((id, none, -score, item))
        item = item[order]
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        kept = order[place < self.most]
        self.score, self.id, self.gone = score[kept], id[kept], none[kept]
        full = order[place == self.most - 1]
        self.item = item[place < self.most]
        self.least[item[place == self.most - 1]] = score[full]


def _lots(items: DataFrame, id: str, text: str) -> Iterator[tuple[list, list[Counter]]]:
    """Item ids and their terms with repeats, in lots of bounded size."""
    ids, held, size = [], [], 0
    for row in items.select(F.col(id).alias("id"), F.col(text).alias("text")).toLocalIterator():
        found = Counter(terms(row["text"]))
        more = sum(map(len, found))
        if ids and size + more > AUTOMATON_CHARACTERS:
            yield ids, held
            ids, held, size = [], [], 0
        ids.append(row["id"])
        held.append(found)
        size += more
    if ids:
        yield ids, held


def _search_lot(docs: DataFrame, ids: list, held: list[Counter], kind: str, best: int, id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    known = sorted(set().union(*held))
    number = {t: i for i, t in enumerate(known)}
    counts = staged(scan(docs, known, id, text), "search-counts")
    whole = counts.where("n > 0").agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    n_docs, n_terms = whole["N"], whole["L"] or 0
    df = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most the lot's terms
    weight = np.zeros(len(known), np.int64)
    for t, n in df.items():
        weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
    # From term to items: spans of these, one entry for each item that holds the term.
    pairs = sorted((number[t], i, n) for i, found in enumerate(held) for t, n in found.items())
    term, item, times = np.ascontiguousarray(np.array(pairs, np.int64).reshape(-1, 3).T)
    at = np.searchsorted(term, np.arange(len(known) + 1))
    tables = spark.sparkContext.broadcast((weight, item, times, at, ids))
    step = max(1, CELLS // len(ids))

    def work(batches: Iterator[pa.RecordBatch]):
        weight, item, times, at, ids = tables.value
        kept = Best(len(ids), best)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                lists = part.column(2)
                t, tf = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy()
                doc = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                n = part.column(1).to_numpy()
                m = (100 - LENGTH_SHARE) + (LENGTH_SHARE * n * n_docs) // max(1, n_terms)
                adds = weight[t] * ((SCALE * tf) // (1000 * tf + 8 * m[doc]))
                many = at[t + 1] - at[t]
                spot = np.repeat(at[t] - np.cumsum(many) + many, many) + np.arange(many.sum())
                scores = np.zeros(part.num_rows * len(ids), np.int64)
                np.add.at(scores, np.repeat(doc, many) * len(ids) + item[spot], np.repeat(adds, many) * times[spot])
                column = part.column(0)
                kept.add(scores.reshape(part.num_rows, len(ids)), column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept.item), pa.array(kept.id, mask=kept.gone), pa.array(kept.score)], ["item", "doc_id", "score"])

    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = counts.where("size(terms) > 0").mapInArrow(work, "item long, doc_id long, score long")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind}")  # at most the lot's items
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, best: int = 10, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """Per item its ``best`` documents: item_id, rank, doc_id, score."""
    kind = items.schema[item_id].dataType.simpleString()
    result = None
    for ids, held in _lots(items, item_id, item_text):
        lot = _search_lot(docs, ids, held, kind, best, id, text)
        result = lot if result is None else result.union(lot)
    if result is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return result
