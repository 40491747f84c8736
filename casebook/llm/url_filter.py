"""URL filter over a sorted digest array (operator 9).

The rule list becomes an array of 64-bit xxhash keys in ascending order, written
as ``.npy`` files which every task memory-maps.  A url is judged by probing all
host suffixes with every path-prefix length the rules use: one vectorised binary
search per (suffix depth, prefix length) over the whole batch.  A probe that hits
is confirmed against the stored rule string, so a hash collision never decides.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.session import ship_package

Rule = tuple[str, str, str]  # verdict, host, path


def digest(rules: Iterable[Rule]) -> dict[str, np.ndarray]:
    """Sorted key array with, per key, the offset of its rule string and its verdict.

    Equal rules: the last one given wins.  Rules whose keys collide keep separate
    entries next to each other and are told apart by their strings.
    """
    table = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}: allow or block expected")
        table[(host, path)] = verdict
    entries = [(xxhash.xxh64_intdigest(f"{h}\0{p}"), f"{h}\0{p}".encode(), v == "block")
               for (h, p), v in table.items()]
    entries.sort()
    text = b"".join(e[1] for e in entries)
    return {"keys": np.array([e[0] for e in entries], np.uint64),
            "ends": np.cumsum([0] + [len(e[1]) for e in entries]).astype(np.int64),
            "block": np.array([e[2] for e in entries], bool),
            "text": np.frombuffer(text or b"\0", np.uint8),
            "lengths": np.array(sorted({len(p) for _, p in table}, reverse=True), np.int64),
            "depth": np.array([max([h.count(".") + 1 for h, _ in table], default=0)], np.int64)}


class Digest:
    """The arrays of ``digest``, memory-mapped from the files sent to each worker."""

    def __init__(self, name: str):
        for part in ("keys", "ends", "block", "text"):
            setattr(self, part, np.load(SparkFiles.get(f"{name}-{part}.npy"), mmap_mode="r"))
        self.lengths = np.load(SparkFiles.get(f"{name}-lengths.npy")).tolist()
        self.depth = int(np.load(SparkFiles.get(f"{name}-depth.npy"))[0])

    def find(self, wanted: list[str]) -> np.ndarray:
        """Index of each string's rule, or -1."""
        keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in wanted), np.uint64, len(wanted))
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(wanted), -1, np.int64)
        inside = np.flatnonzero(at < len(self.keys))
        for i in inside[self.keys[at[inside]] == keys[inside]]:
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if bytes(self.text[self.ends[j]:self.ends[j + 1]]) == wanted[i].encode():
                    found[i] = j
                    break
                j += 1
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    stop = min([i for i in (rest.find("?"), rest.find("#")) if i >= 0], default=len(rest))
    rest = rest[:stop]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def host_suffixes(host: str, depth: int) -> list[str]:
    """The host and its parent domains with at most ``depth`` labels, longest first."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(max(0, len(labels) - depth), len(labels))]


def judge(hosts: list[str], paths: list[str], rules: Digest) -> tuple[list, list]:
    """(rule or None, block or None) of each url: the longest rule that fits; of
    two as long, the one with the longer host."""
    probes, of = [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        if host:
            for suffix in host_suffixes(host, rules.depth):
                for n in rules.lengths:
                    if len(path) >= n:
                        probes.append(f"{suffix}\0{path[:n]}")
                        of.append(i)
    unique: dict[str, int] = {}
    for p in probes:
        unique.setdefault(p, len(unique))
    hit = rules.find(list(unique)) if unique else np.zeros(0, np.int64)
    best: dict[int, tuple[int, int, str, int]] = {}
    for p, i in zip(probes, of):
        j = int(hit[unique[p]])
        if j >= 0:
            host = p.split("\0", 1)[0]
            rank = (len(p), len(host), p, j)
            if i not in best or rank[:2] > best[i][:2]:
                best[i] = rank
    names, block = [None] * len(hosts), [None] * len(hosts)
    for i, (_, _, p, j) in best.items():
        names[i], block[i] = p.replace("\0", "", 1), bool(rules.block[j])
    return names, block


_sent: set[tuple[str, str]] = set()


def send_rules(spark, arrays: dict[str, np.ndarray]) -> str:
    """Send the arrays to the executors as files, equal ones once per application; returns
    the name they go by.  The driver's own files, which it serves from, go when it ends."""
    sums = hashlib.sha256()
    for part in sorted(arrays):
        sums.update(part.encode() + str(arrays[part].dtype).encode() + np.ascontiguousarray(arrays[part]).tobytes())
    name = f"urlrules-{sums.hexdigest()[:20]}"
    if (spark.sparkContext.applicationId, name) not in _sent:
        folder = tempfile.mkdtemp(prefix="urlrules-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        for part, values in arrays.items():
            path = os.path.join(folder, f"{name}-{part}.npy")
            np.save(path, values)
            spark.sparkContext.addFile(path)
        _sent.add((spark.sparkContext.applicationId, name))
    return name


def url_filter(pages: DataFrame, rules: Iterable[Rule], url: str = "url",
               otherwise: str = "allow") -> DataFrame:
    """Every row of ``pages`` with host, path, rule and verdict.

    ``verdict`` is the rule's; a url that no rule fits is not in the digest array
    and gets ``otherwise``.  A null url, or one without ``://``, has empty host and
    path and no rule.  Rows are kept one to one, repeated or not; columns of the
    input named like an output column are replaced; an empty table stays empty.
    The rule arrays (8 bytes a key plus the strings) are a file each, sent once to
    every executor; they follow the rule list, not the pages.
    """
    spark = pages.sparkSession
    ship_package(spark)
    name = send_rules(spark, digest(rules))

    out = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in out]
    urls = "_judged_url"
    fields = T.StructType([f for f in pages.schema.fields if f.name in kept])
    for c in out:
        fields = fields.add(c, T.StringType())

    def run(batches):
        table = Digest(name)
        for b in batches:
            split = [split_url(u) for u in b.column(urls).to_pylist()]
            hosts, paths = [h for h, _ in split], [p for _, p in split]
            names, block = judge(hosts, paths, table)
            verdict = [otherwise if x is None else "block" if x else "allow" for x in block]
            cols = [b.column(c) for c in kept] + [pa.array(v, pa.string()) for v in (hosts, paths, names, verdict)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *out])

    return pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{url}`").cast("string").alias(urls)).mapInArrow(run, fields)
