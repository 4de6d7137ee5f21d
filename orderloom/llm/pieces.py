"""Merge-type tokenisation with a sentencepiece BPE vocabulary: exact encoding, decoding and counting.

``Vocabulary.encode`` finds the merge result without merging: Aho-Corasick gives all vocabulary strings
at every place, the longest is tried first, neighbours must be compatible (merging their joint text gives
the same two tokens), and a bitfield remembers places from which no encoding can go on.
``Vocabulary.count`` looks up strings proved to encode alone as one token and merges only the rest.

The encoder never joins a character with a following space mark or with an unknown character, so texts
are cut there and each distinct stretch is worked out once per worker; the memory for this is bounded.

Results for odd input: a NULL or empty text has no tokens (hash of the empty string), a repeated row is
encoded again, an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from orderloom.llm.common import Remembered

MARK = "▁"  # stands for a space
#: A stretch is spaces and what follows, or a line end, or spaces alone.
STRETCH = re.compile(r" *[^ \n]+|\n| +")


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        self.piece, self.rank, self.byte = {}, {}, [0] * 256
        for i in range(library.get_piece_size()):
            text = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte[int(text[1:-1], 16)] = i
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.piece[text] = i
                self.rank[text] = -library.get_score(i)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.piece):
            raise ValueError("the vocabulary joins text across spaces or lines")
        self.text = {i: p for p, i in self.piece.items()}
        self.value = {b: v for v, b in enumerate(self.byte)}
        self.known = {p for p in self.piece if len(p) == 1}
        #: Proved by merging each: strings that encode alone as one token.
        self.alone = {p for p in self.piece if self.merge(p) == [p]}
        self._compatible = Remembered(self._pair)
        self._automaton = None

    # Merging, for proofs and for strings that are not one token.

    def merge(self, text: str) -> list[str]:
        """The highest-ranked joinable neighbours are joined, leftmost first, until none are left."""
        if len(text) > 32:
            return self._merge_long(text)
        parts, rank = list(text), self.rank.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge_long(self, text: str) -> list[str]:
        n, rank = len(text), self.rank.get
        parts: list[str | None] = list(text)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joint = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != joint:
                continue
            parts[i], parts[j] = joint, None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (r := rank(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return [p for p in parts if p is not None]

    # Encoding without merging.

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for p in self.alone:
                self._automaton.add_word(p, self.piece[p])
            self._automaton.make_automaton()
            self.length = {self.piece[p]: len(p) for p in self.alone}
        return self._automaton

    def _pair(self, key: int) -> bool:
        a, b = self.text[key >> 32], self.text[key & 0xFFFFFFFF]
        return self.merge(a + b) == [a, b]

    def _backtrack(self, text: str) -> list[int]:
        """Tokens of a text of known characters."""
        n, compatible = len(text), self._compatible
        at: list[list[int]] = [[] for _ in range(n)]  # tokens by start, shortest first
        automaton, length = self.automaton, self.length
        for end, token in automaton.iter(text):
            at[end + 1 - length[token]].append(token)
        failed = 0  # bit p: no encoding goes on from p
        chosen: list[int] = []
        tried = [len(at[0])]  # how many of the tokens at each chosen start are left to try
        place = 0
        while place < n:
            left = tried[-1]
            while left:
                left -= 1
                token = at[place][left]
                after = place + length[token]
                if not failed >> after & 1 and (not chosen or compatible[chosen[-1] << 32 | token]):
                    break
            else:
                if not chosen:
                    raise ValueError("no encoding")
                failed |= 1 << place
                tried.pop()
                place -= length[chosen.pop()]
                continue
            tried[-1] = left
            chosen.append(token)
            place = after
            if place < n:
                tried.append(len(at[place]))
        return chosen

    def _stretches(self, text: str) -> Iterator[tuple[str, bool]]:
        """Runs of known characters, and single unknown ones."""
        start = 0
        for i, c in enumerate(text):
            if c not in self.known:
                if i > start:
                    yield text[start:i], True
                yield c, False
                start = i + 1
        if start < len(text):
            yield text[start:], True

    def encode(self, stretch: str) -> list[int]:
        """Token ids of a stretch, by backtracking."""
        text = stretch.replace(" ", MARK)
        if self.known.issuperset(text):
            return self._backtrack(text)
        ids: list[int] = []
        for part, known in self._stretches(text):
            ids += self._backtrack(part) if known else [self.byte[b] for b in part.encode()]
        return ids

    def count(self, stretch: str) -> int:
        """Number of tokens of a stretch, by the whole-token shortcut."""
        text = stretch.replace(" ", MARK)
        if text in self.alone:
            return 1
        if self.known.issuperset(text):
            return len(self.merge(text))
        return sum(
            (1 if part in self.alone else len(self.merge(part))) if known else len(part.encode())
            for part, known in self._stretches(text)
        )

    def decode(self, ids: list[int]) -> str:
        """Text of ids, without taking off the mark that encoding put first."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.value:
                held.append(self.value[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append(self.text[i])
        return "".join(out).replace(MARK, " ") + (held.decode("utf-8", "replace") if held else "")


def stretches(text: str) -> list[str]:
    """A text's stretches in order. Its start is as if a space stood before it; a mark counts as a space."""
    return STRETCH.findall(" " + text.replace(MARK, " ")) if text else []


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def _encoded(path: str) -> Remembered:
    known = vocabulary(path)

    def work(stretch: str) -> tuple[str, str]:
        ids = known.encode(stretch)
        return ",".join(map(str, ids)), known.decode(ids)

    return Remembered(work, 450_000_000)


@lru_cache(2)
def _counted(path: str) -> Remembered:
    known = vocabulary(path)
    counts = Remembered(known.count)
    counts.update((p.replace(MARK, " "), 1) for p in known.alone)
    return counts


def encoded_text(text: str, path: str) -> tuple[str, str]:
    """(ids joined by commas, decoded text)."""
    found = _encoded(path)
    both = [found[s] for s in stretches(text)]
    return ",".join([b[0] for b in both]), "".join([b[1] for b in both])[1:]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def encode_decode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_tokens, ids (joined by commas) as a SHA-256, and the text that decoding gives as a SHA-256."""

    def work(batches):
        for ids, texts in _batches(batches):
            counts, hashes, decoded = [], [], []
            for t in texts:
                joined, back = encoded_text(t, path)
                counts.append(joined.count(",") + 1 if joined else 0)
                hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded)],
                [id, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(
        work, f"`{id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the token ids themselves, as an array."""

    def work(batches):
        for ids, texts in _batches(batches):
            tokens = [[int(x) for x in joined.split(",")] if (joined := encoded_text(t, path)[0]) else [] for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(tokens, pa.list_(pa.int32()))], [id, "ids"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(work, f"`{id}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_bytes, n_tokens and whether the tokens are more than ``limit``."""

    def work(batches):
        found = _counted(path)
        for ids, texts in _batches(batches):
            counts = [sum(map(found.__getitem__, stretches(t))) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([c > limit for c in counts], pa.bool_())],
                [id, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(work, f"`{id}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
