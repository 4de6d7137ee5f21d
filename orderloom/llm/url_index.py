"""URL rules and lists in a sorted digest array.

Every rule is a host with a path beginning. The 64-bit xxHash of each rule's key goes into one sorted array
in a file that workers map into memory; probes are vectorised binary searches, and a match counts only if
the stored string is equal, so colliding digests do no harm. A url is probed with every suffix of its host
and every path length that rules have; the longest fitting rule decides, and where none fits, a list of
hosts in a second array of the same kind does.

The rules reach the workers as a file through ``SparkContext.addFile``; the driver streams them into it
row by row, and workers only touch the pages that they probe.

Results for odd input: a NULL url or one without ``://`` has an empty host and path and is allowed; repeated
rows are judged again; equal rules with different verdicts block; NULL rules are ignored; empty rule or page
tables are fine. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 0
HEAD = 16  # bytes: number of entries, size of the strings
URL = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)
UPPER = {c: c + 32 for c in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a url."""
    found = URL.match(url) if url else None
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


def digests(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys))


def write_index(entries: Iterable[tuple[str, bool]], path: str, digest=digests) -> None:
    """A file: head, sorted digests, end offsets, verdicts, strings. Equal keys count as blocked if any is."""
    verdicts: dict[bytes, bool] = {}
    for key, blocked in entries:
        raw = key.encode()
        verdicts[raw] = verdicts.get(raw, False) or blocked
    keys = list(verdicts)
    hashed = digest(keys)
    order = np.argsort(hashed, kind="stable")
    texts = [keys[i] for i in order]
    with open(path, "wb") as out:
        out.write(np.array([len(keys), sum(map(len, texts))], "<u8").tobytes())
        out.write(hashed[order].astype("<u8").tobytes())
        out.write(np.cumsum([len(t) for t in texts], dtype="<u8").tobytes() if texts else b"")
        out.write(bytes(verdicts[t] for t in texts))
        out.writelines(texts)


class DigestArray:
    def __init__(self, path: str, digest=digests):
        self.digest = digest
        n, size = np.fromfile(path, "<u8", 2).tolist()
        file = np.memmap(path, np.uint8, "r")
        self.sorted = file[HEAD:HEAD + 8 * n].view("<u8")
        self.ends = file[HEAD + 8 * n:HEAD + 16 * n].view("<u8")
        self.blocked = file[HEAD + 16 * n:HEAD + 17 * n]
        self.texts = file[HEAD + 17 * n:HEAD + 17 * n + size]

    def find(self, keys: list[bytes]) -> list[bool | None]:
        """Verdict of each key (True: block), None where it is not stored."""
        out: list[bool | None] = [None] * len(keys)
        hashed = self.digest(keys)
        place = np.searchsorted(self.sorted, hashed)
        last = np.searchsorted(self.sorted, hashed, "right")
        for i in np.flatnonzero(last > place).tolist():
            for p in range(int(place[i]), int(last[i])):
                start = int(self.ends[p - 1]) if p else 0
                if self.texts[start:int(self.ends[p])].tobytes() == keys[i]:
                    out[i] = bool(self.blocked[p])
                    break
        return out


def _ship(spark: SparkSession, rows: DataFrame) -> str:
    """Name of the index file that workers can open; rows: (key, blocked)."""
    folder = tempfile.mkdtemp(prefix="url-index-")
    path = os.path.join(folder, "index")
    write_index(((r["key"], r["blocked"]) for r in rows.toLocalIterator()), path)
    with open(path, "rb") as f:
        name = f"url-index-{hashlib.file_digest(f, 'sha256').hexdigest()}"
    if not any(f.rpartition("/")[2] == name for f in spark.sparkContext.listFiles):  # else it is there already
        named = os.path.join(folder, name)
        os.rename(path, named)
        spark.sparkContext.addFile(named)
    return name


@lru_cache(8)
def _opened(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def judge(pages: DataFrame, rules: DataFrame, hosts: DataFrame, id: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: the id, host, path, rule (NULL where none fits) and verdict (allow or block).

    ``rules`` has (host, path, block), ``hosts`` has (host): their subdomains are blocked where no rule fits.
    """
    spark = pages.sparkSession
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND block IS NOT NULL")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    index = _ship(spark, rules.select(F.concat("host", F.lit("\n"), "path").alias("key"), F.col("block").alias("blocked")))
    listed = _ship(spark, hosts.where("host IS NOT NULL").select(F.col("host").alias("key"), F.lit(True).alias("blocked")))

    names = rules.select("host").union(hosts.where("host IS NOT NULL").select("host"))
    most = names.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0

    def suffixes(host: str) -> list[str]:
        """The host and what it is under, with as many labels as a listed name may have."""
        labels = host.rsplit(".", most)[-most:] if host and most else []
        return [".".join(labels[i:]) for i in range(len(labels))]

    def work(batches: Iterator[pa.RecordBatch]):
        by_rule, by_host = _opened(index), _opened(listed)
        for batch in batches:
            split = [parts(u) for u in batch.column(1).to_pylist()]
            probes = [
                (i, s, path[:n]) for i, (host, path) in enumerate(split) for s in suffixes(host) for n in lengths if n <= len(path)
            ]
            best: dict[int, tuple[int, int, str, bool]] = {}
            for (i, host, start), blocked in zip(probes, by_rule.find([f"{h}\n{p}".encode() for _, h, p in probes])):
                if blocked is not None:
                    found = (len(host) + len(start), len(host), host + start, blocked)
                    best[i] = max(best.get(i, found), found)
            names = [(i, s) for i, (host, _) in enumerate(split) for s in suffixes(host)]
            bad = {i for (i, _), hit in zip(names, by_host.find([s.encode() for _, s in names])) if hit}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()),
                 pa.array([best[i][2] if i in best else None for i in range(len(split))], pa.string()),
                 pa.array(["block" if (best[i][3] if i in best else i in bad) else "allow" for i in range(len(split))], pa.string())],
                [id, "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[id].dataType.simpleString()
    return pages.select(id, url).mapInArrow(work, f"`{id}` {kind}, host string, path string, rule string, verdict string")
