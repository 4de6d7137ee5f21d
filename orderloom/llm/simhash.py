"""Near duplicates by SimHash, found with a hierarchical index in Gray order.

A fingerprint has 64 bits; bit b is 1 if it is set in over half of the hashes of a text's word shingles.
Texts whose fingerprints differ in at most ``distance`` bits are linked, and components follow from links.

Two fingerprints that differ in 4 bits agree in at least 2 of 6 blocks, so pairs of blocks (15) are the
top nodes of the index: a masked bit pattern that all members share. Below a top node fingerprints are
sorted by Gray rank, groups of neighbours in that order share further masked patterns, and a pair of
groups is dropped as soon as the differences on what both mask exceed the distance. Groups so close that
every pair must be linked are joined without looking at pairs. A top node with very many members is cut
into parts, and every pair of parts is a unit of work of its own, so no task sees an unbounded node; each
unit gives a spanning forest of its links, never all pairs.

Results for odd input: a NULL, empty or blank text has fingerprint zero and is linked like any other;
repeated rows and ids each get a row; NULL ids count as largest (a component of NULL ids alone has NULL);
an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import components, staged

BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # first bit, bits
PART = 2048  # members of a top node that one side of a unit of work holds at most, about
GROUP = 16  # neighbours in Gray order under one lower node
SEED = 42
ONE = np.uint64(1)


def fingerprint(text: str | None, width: int = 4) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(0, len(words) - width)
    hashed = xxhash.xxh64_intdigest
    hashes = np.array(
        [hashed(joined[a:b], SEED) for a, b in zip(starts[: last + 1].tolist(), ends[min(width, len(words)) - 1:].tolist())],
        dtype="<u8",
    )
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], [id, "fp"])

    return docs.select(id, text).mapInArrow(work, f"`{id}` {docs.schema[id].dataType.simpleString()}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices start..start+count of each entry, and the entry each belongs to."""
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[owner] + inside, owner


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Smallest member of each component, given links a-b and earlier roots."""
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


class GrayIndex:
    """Codes under top nodes (``top``: equal for the members of one, ascending), sorted by Gray rank."""

    def __init__(self, codes: np.ndarray, top: np.ndarray):
        order = np.lexsort((gray_rank(codes), top))
        self.codes, self.top, self.order = codes[order], top[order], order
        n = len(codes)
        first = np.flatnonzero(np.concatenate(([True], self.top[1:] != self.top[:-1])))
        sizes = np.diff(np.append(first, n))
        groups = -(-sizes // GROUP)
        at, owner = _spread(np.zeros(len(first), np.int64), groups)
        self.start = first[owner] + at * GROUP
        self.size = np.minimum(GROUP, sizes[owner] - at * GROUP)
        ones = np.bitwise_and.reduceat(self.codes, self.start)
        some = np.bitwise_or.reduceat(self.codes, self.start)
        self.mask, self.value = ~(ones ^ some), ones  # bits that a group's members share, and their values
        self.first_group = np.cumsum(groups) - groups  # of each top node
        self.groups = groups

    def forest(self, distance: int, slice_pairs: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(a, b): places in the given codes; links that connect whatever is linked under a top node."""
        root = np.arange(len(self.codes))
        later, owner = _spread(np.arange(len(self.start)) , self._after())
        for at in range(0, len(later), slice_pairs):
            g, h = owner[at:at + slice_pairs], later[at:at + slice_pairs]
            root = self._link(g, h, distance, root)
        away = np.flatnonzero(root != np.arange(len(root)))
        return self.order[away], self.order[root[away]]

    def _after(self) -> np.ndarray:
        """For each group: itself and the later groups under the same top node."""
        node = np.repeat(np.arange(len(self.groups)), self.groups)
        return self.first_group[node] + self.groups[node] - np.arange(len(self.start))

    def _link(self, g, h, distance, root):
        shared = self.mask[g] & self.mask[h]
        differ = (self.value[g] ^ self.value[h]) & shared
        apart = np.bitwise_count(differ)
        near = apart <= distance
        g, h, shared, apart = g[near], h[near], shared[near], apart[near]
        surely = apart + np.bitwise_count(~shared) <= distance  # even where they share nothing
        a, b = self.start[g[surely]], self.start[h[surely]]
        root = _roots(len(root), a, b, root)
        alike = np.flatnonzero(surely & (g == h))
        members, owner = _spread(self.start[g[alike]], self.size[g[alike]])
        root = _roots(len(root), self.start[g[alike]][owner], members, root)
        g, h = g[~surely], h[~surely]
        step = 4096  # pairs of groups, at most GROUP * GROUP pairs of codes each
        for at in range(0, len(g), step):
            i, one = _spread(self.start[g[at:at + step]], self.size[g[at:at + step]])
            j, pair = _spread(self.start[h[at:at + step]][one], self.size[h[at:at + step]][one])
            i = i[pair]
            use = i < j
            i, j = i[use], j[use]
            use = root[i] != root[j]
            i, j = i[use], j[use]
            linked = np.bitwise_count(self.codes[i] ^ self.codes[j]) <= distance
            root = _roots(len(root), i[linked], j[linked], root)
        return root


def top_nodes(codes: np.ndarray) -> np.ndarray:
    """(code, pair of blocks) -> the pair's number with the masked bits."""
    out, k = np.empty((len(codes), 15), np.uint64), 0
    for x in range(6):
        for y in range(x + 1, 6):
            (a, wa), (b, wb) = BLOCKS[x], BLOCKS[y]
            high = (codes >> np.uint64(a)) & np.uint64((1 << wa) - 1)
            low = (codes >> np.uint64(b)) & np.uint64((1 << wb) - 1)
            out[:, k] = (np.uint64(k) << np.uint64(24)) | (high << np.uint64(wb)) | low
            k += 1
    return out


def _by_top(codes: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            tops = top_nodes(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(fp, 15)), pa.array(tops.ravel().view(np.int64))], ["fp", "top"])

    return codes.select("fp").mapInArrow(work, "fp long, top long")


def links(codes: DataFrame, distance: int = 4, part: int = PART) -> DataFrame:
    """(a, b): links that connect all of the distinct fingerprints ``fp`` whose distance allows it."""
    if not 0 <= distance <= 4:
        raise ValueError("two of six blocks agree for sure up to 4 differing bits only")
    rows = _by_top(codes)
    sizes = rows.groupBy("top").agg(F.count("*").alias("n")).where(F.col("n") > part)
    sizes = staged(sizes.select("top", F.ceil(F.col("n") / part).cast("int").alias("parts")), "simhash-large")
    rows = rows.join(sizes, "top", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.select("fp", "top", mine.alias("p"), other.alias("q")).select(
        "fp", "top", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    rows = rows.select(F.xxhash64("top", "p", "q").alias("unit"), "fp")  # equal hashes only share a unit
    n = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "unit").sortWithinPartitions("unit")

    def found(units: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = GrayIndex(fps.view(np.uint64), units).forest(distance)
        return pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], ["a", "b"])

    def work(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            size += batch.num_rows
            if size < 200_000:
                continue
            units, fps = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            cut = np.searchsorted(units, units[-1])  # the last unit may go on; it is bounded
            if cut:
                yield found(units[:cut], fps[:cut])
            held, size = [(units[cut:], fps[cut:])], len(units) - cut
        if held and size:
            yield found(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))

    return rows.mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, its fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable."""
    marked = staged(fingerprints(docs, id, text), "simhash-fingerprints")
    codes = staged(marked.groupBy("fp").agg(F.min(id).alias("least_id")), "simhash-codes")
    roots = components(links(codes, distance), "simhash")
    rooted = codes.join(roots, codes.fp == roots.node, "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(known, "fp").select(
        id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
