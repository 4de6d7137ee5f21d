"""Packing of token sequences by lexical retrieval.

Documents are tokenised once, written to the shared folder and dealt to shards of bounded size by range of
(a lexical key, a hash of the id), so texts that resemble each other tend to share a shard and a hot key
is cut like any other range. Each shard holds an inverted index over its documents' tokens. A seed fills
its window, BM25 returns the unused documents nearest to it, and these fill the rest greedily, best
first; the one that does not fit is cut and its remainder seeds the next window. The last window of a
shard ends in sequences whose lengths are powers of two, which need no padding.

Results for odd input: a NULL or empty text has only the closing id; texts longer than a window go over
several sequences; repeated rows and ids are packed like others, each row's ids lying in exactly one
piece; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import Remembered, staged

WINDOW = 2048
CLOSING = 1
SHARD_TOKENS = 2_000_000
STEP, STEP_BYTES = 4000, 6_000_000  # documents, and about how many bytes of text, whose words are looked up together
K1, B = 1.2, 0.75


class WordTokens:
    """Token ids by word, as 16-bit bytes. The tokeniser drops white space and never joins across it, so a
    text's ids are those of its words in order. Each distinct word is worked out once, and so is each run of
    letters or signs in words of usual characters; any other word goes through the whole tokeniser."""

    #: Characters that the tokeniser's normal form leaves alone, but for their case.
    USUAL = regex.compile("[!-~\u00a1-\u024f--\u0130]+", regex.V1)
    #: Fixed value: the tokeniser's own pattern for runs.
    RUN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    SPECIAL = "<|"
    #: Signs that often end a word; each is a run of its own behind letters.
    MARKS = frozenset(".,;:!?")

    def __init__(self, path: str, words: int = 60_000_000, runs: int = 180_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.model = self.tokenizer.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        self.shown = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.runs = Remembered(self._run, runs)
        self.words = Remembered(self._mixed, words)

    def _run(self, run: str) -> bytes:
        letters = run if run.isascii() else run.encode().decode("latin-1").translate(self.shown)
        return array("H", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        """Letters, with a sign behind them or not, come straight from the runs."""
        text = word.decode()
        if text.isascii() or self.USUAL.fullmatch(text):
            if text.isalpha():
                return self.runs[text.lower()]
            if text[-1:] in self.MARKS and text[:-1].isalpha():
                return self.runs[text[:-1].lower()] + self.runs[text[-1]]
        return self.words[text]

    def _mixed(self, text: str) -> bytes:
        usual = text.isprintable() if text.isascii() else self.USUAL.fullmatch(text)
        if usual and self.SPECIAL not in text:
            return b"".join([self.runs[r] for r in self.RUN.findall(text.lower())])
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last ends). Every distinct word is looked up once."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        raws = list(map(self._word, coded.dictionary.cast(pa.binary()).to_pylist()))
        tokens = np.frombuffer(b"".join(raws), "<u2")
        lengths = np.fromiter(map(len, raws), np.int32, len(raws)) // 2
        word = coded.indices.to_numpy()
        counts = lengths[word]
        ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int32)))
        shift = (np.cumsum(lengths, dtype=np.int32) - lengths)[word] - ends[:-1]
        found = tokens[np.arange(ends[-1], dtype=np.int32) + np.repeat(shift, counts)]
        return found, ends[split.offsets.to_numpy()]


@lru_cache(2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts, in the second column, are bounded but for a longer single one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = min(start + STEP, max(start + 1, int(np.searchsorted(ends, before + STEP_BYTES, "right"))))
        yield batch.slice(start, end - start)
        start = end


def tokenised(docs: DataFrame, path: str, id: str, text: str) -> DataFrame:
    """Per row: id, ids (16-bit, with the closing id), their number, and a lexical key: the least hash of a token."""

    def work(batches: Iterator[pa.RecordBatch]):
        known, closing = word_tokens(path), np.array([CLOSING], "<u2").tobytes()
        for batch in batches:
            for part in steps(batch):
                tokens, ends = known.ids(part.column(1))
                first, last = ends[:-1], ends[1:]
                mixed = np.append(tokens, np.uint16(0)).astype(np.uint32) * np.uint32(2654435761)
                keys = np.where(last > first, np.minimum.reduceat(mixed, first), 0)
                ids = [tokens[a:b].tobytes() + closing for a, b in zip(first.tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array((last - first + 1).astype(np.int64)), pa.array(keys.astype(np.int64))],
                    [id, "ids", "doc_tokens", "lexical_key"],
                )

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(work, f"`{id}` {kind}, ids binary, doc_tokens long, lexical_key long")


class Shard:
    """An inverted index with BM25 over token ids, for one shard's documents.

    Terms that stand in many of the documents are columns of a dense table, which takes at most ``DENSE`` cells for
    each posting it replaces; the others have lists. When half of the documents are used, the index is
    cut down to the rest. Scores are sums over all distinct terms of the seed, whichever way they are kept.
    """

    DENSE = 4

    def __init__(self, tokens: list[np.ndarray], width: int = 1 << 16):
        terms, docs, freqs = [], [], []
        for d, ids in enumerate(tokens):
            t, n = np.unique(ids, return_counts=True)
            terms.append(t)
            freqs.append(n.astype(np.float32))
            docs.append(np.full(len(t), d, np.int32))
        self.by_doc = np.cumsum([0, *map(len, terms)])
        term, doc, freq = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (terms, docs, freqs))
        self.terms = term
        del terms, docs, freqs
        lengths = np.array([len(t) for t in tokens], np.float64)
        held = np.bincount(term, minlength=width)
        weight = np.log1p((len(tokens) - held + 0.5) / (held + 0.5)).astype(np.float32)
        norm = (K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if len(lengths) else 1.0))).astype(np.float32)
        scores = freq * np.float32(K1 + 1) / (freq + norm[doc]) * weight[term]
        del freq
        self.all = len(tokens)
        self.alive = np.arange(self.all)
        often = held * self.DENSE > self.all
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        thick = often[term]
        self.dense = np.zeros((int(often.sum()), self.all), np.float32)
        self.dense[self.column[term[thick]], doc[thick]] = scores[thick]
        term, doc, scores = term[~thick], doc[~thick], scores[~thick]
        order = np.argsort(term, kind="stable")
        self.docs, self.scores = doc[order], scores[order]
        self.at = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=width))))

    def cut_down(self, used: np.ndarray) -> None:
        """Forget the documents that are used."""
        kept = ~used[self.alive]
        self.dense, self.alive = np.ascontiguousarray(self.dense[:, kept]), self.alive[kept]
        stays = ~used[self.docs]
        self.at = np.concatenate(([0], np.cumsum(stays)))[self.at]
        self.docs, self.scores = self.docs[stays], self.scores[stays]

    def scored(self, d: int, used: np.ndarray) -> np.ndarray:
        """BM25 of every document against document ``d``, over all distinct terms of it. Used ones may have 0."""
        if np.count_nonzero(used[self.alive]) * 2 > len(self.alive):
            self.cut_down(used)
        terms = self.terms[self.by_doc[d]:self.by_doc[d + 1]]
        spans = [slice(a, b) for a, b in zip(self.at[terms].tolist(), self.at[terms + 1].tolist()) if a < b]
        out = np.zeros(self.all)
        if spans:
            out += np.bincount(
                np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.scores[s] for s in spans]), minlength=self.all)
        columns = self.column[terms]
        columns = columns[columns >= 0]
        if len(columns):  # no matrix product: its library's threads and buffers are not the task's to take
            out[self.alive] += self.dense[columns].sum(0)
        return out


def _ranked(scores: np.ndarray, used: np.ndarray) -> Iterator[int]:
    """Documents by score, best first, until all are used. Later ones are only ranked when they are asked for."""
    wanted = 64
    while left := int(np.count_nonzero(~used)):
        scores[used] = -1
        wanted = min(left, wanted)
        best = np.argpartition(-scores, wanted - 1)[:wanted]
        yield from best[np.lexsort((best, -scores[best]))].tolist()
        wanted *= 4


def fill(lengths: list[int], nearest, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece.

    ``nearest(d, used)`` gives scores of all documents for seed ``d``. Documents seed in the given order.
    """
    n = len(lengths)
    used = np.zeros(n, bool)
    sequence, room = 0, window
    current: list[tuple[int, int, int]] = []  # pieces of the open sequence
    ranked: Iterator[int] = iter(())
    seed_at = 0
    while True:
        d = next((x for x in ranked if not used[x]), None)
        if d is None:
            while seed_at < n and used[seed_at]:
                seed_at += 1
            if seed_at == n:
                break
            d = seed_at
            ranked = iter(())
        used[d] = True
        start, left = 0, lengths[d]
        seeded = not current
        while left:
            take = min(left, room)
            current.append((d, start, take))
            start, left, room = start + take, left - take, room - take
            if not room:
                offset = 0
                for doc, s, size in current:
                    yield doc, s, size, sequence, offset
                    offset += size
                current, room, sequence, seeded = [], window, sequence + 1, True
                ranked = iter(())
        if current and seeded:  # what is left of this document seeds the open window
            ranked = _ranked(nearest(d, used), used)
    size = window - room
    if size == 0:
        return
    # The last window: sequences of lengths that are powers of two.
    bits = [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]
    offset, quota = 0, bits.pop(0)
    for doc, s, left in current:
        while left:
            take = min(left, quota - offset)
            yield doc, s, take, sequence, offset
            s, left, offset = s + take, left - take, offset + take
            if offset == quota:
                sequence, offset, quota = sequence + 1, 0, bits.pop(0) if bits else 0


def pack(docs: DataFrame, path: str, window: int = WINDOW, id: str = "doc_id", text: str = "text",
         with_ids: bool = True) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, the ids."""
    tokens = staged(tokenised(docs, path, id, text), "packing-tokens")
    total = tokens.agg(F.sum("doc_tokens").alias("n")).first()["n"] or 0
    shards = max(1, -(-total // SHARD_TOKENS))
    dealt = tokens.repartitionByRange(shards, "lexical_key", F.xxhash64(id, F.crc32("ids"))).sortWithinPartitions(
        "lexical_key", F.xxhash64(id, F.crc32("ids")), id)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def flush(ids, raws, base):
        arrays = [np.frombuffer(r, "<u2") for r in raws]
        index = Shard(arrays)
        rows = list(fill([len(a) for a in arrays], index.scored, window))
        pieces = [arrays[d][s:s + n].astype("<u4").tobytes() for d, s, n, _, _ in rows]
        owner = np.array([r[0] for r in rows], np.int64)
        columns = np.array([r[1:] for r in rows], np.int64).reshape(-1, 4)
        lengths = np.array([len(a) for a in arrays], np.int64)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(owner)), pa.array(columns[:, 0]), pa.array(columns[:, 1]),
             pa.array([zlib.crc32(p) for p in pieces], pa.int64()), pa.array(lengths[owner]),
             pa.array(columns[:, 2] + base), pa.array(columns[:, 3]), *[pa.array(pieces, pa.binary())] * with_ids],
            [id, *names],
        )
        return int(columns[:, 2].max()) + 1 if len(rows) else 0

    def work(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        word_tokens.cache_clear()  # of an earlier stage of this worker
        base = TaskContext.get().partitionId() << 40
        ids, raws, held = [], [], 0

        for batch in batches:
            step = 100
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids.append(part.column(0))
                more = part.column(1).to_pylist()
                raws += more
                held += sum(map(len, more)) // 2
                if held > 2 * SHARD_TOKENS:  # a range that came out large is packed in parts
                    base += yield from flush(pa.concat_arrays(ids), raws, base)
                    ids, raws, held = [], [], 0
        if raws:
            yield from flush(pa.concat_arrays(ids), raws, base)

    kind = docs.schema[id].dataType.simpleString()
    return dealt.select(id, "ids").mapInArrow(
        work,
        f"`{id}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + ", ids binary" * with_ids,
    )
