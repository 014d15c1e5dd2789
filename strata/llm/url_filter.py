"""URL filter over a sorted digest array.

Every rule (``host/path``) is one 64-bit xxhash key in a sorted array with its full
string beside it. The array is one file in the shared folder, fetched once per executor
by ``SparkContext.addFile`` and memory-mapped by the tasks, so its pages are shared by all
workers of a machine and never copied into Python. A URL's candidate keys (each host suffix
at a label boundary, each path prefix of a length that some rule has) are hashed and probed
with one vectorised binary search per batch; equal keys are confirmed against the stored
strings. The scan is map-only: no shuffle, and nothing grows with the pages.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from strata.llm.common import Scratch

VERDICTS = ("allow", "block")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host after the first ``://`` (A-Z lower-cased) and the path up to ``?`` or ``#``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("?", 1)[0].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return host.encode().translate(_LOWER).decode(), slash + path


def digest_file(rules: Sequence[tuple[str, str]]) -> bytes:
    """The array as bytes: count, sorted keys, string offsets, verdict codes, strings.

    A rule given twice counts once; its last verdict holds."""
    by_rule = {}
    for verdict, rule in rules:
        if verdict not in VERDICTS or "/" not in rule or rule.startswith("/"):
            raise ValueError(f"not a rule: {verdict} {rule}")
        host, slash, path = rule.partition("/")
        by_rule[host.encode().translate(_LOWER) + (slash + path).encode()] = VERDICTS.index(verdict)
    items = sorted((xxhash.xxh64_intdigest(r), r, v) for r, v in by_rule.items())
    n = len(items)
    offsets = np.concatenate([[0], np.cumsum([len(r) for _, r, _ in items])]) if n else np.zeros(1)
    return b"".join([struct.pack("<q", n), np.array([k for k, _, _ in items], "<u8").tobytes(),
                     offsets.astype("<i8").tobytes(), bytes(v for _, _, v in items),
                     b"".join(r for _, r, _ in items)])


class DigestArray:
    """The memory-mapped file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view("<i8")[0])
        self.keys = raw[8:8 + 8 * n].view("<u8")
        self.offsets = raw[8 + 8 * n:16 + 16 * n].view("<i8")
        self.verdicts = raw[16 + 16 * n:16 + 17 * n]
        self.blob = raw[16 + 17 * n:]

    def find(self, texts: list[bytes]) -> np.ndarray:
        """Row of each text in the array, or -1."""
        found = np.full(len(texts), -1, np.int64)
        if not texts or not len(self.keys):
            return found
        keys = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        at = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys))
        for i in hit:  # equal keys stand side by side: compare the strings themselves
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if self.blob[self.offsets[j]:self.offsets[j + 1]].tobytes() == texts[i]:
                    found[i] = j
                    break
                j += 1
        return found


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id",
               url: str = "url", default: str = "allow", max_bytes: int = 1 << 30) -> DataFrame:
    """One row per page: ``key``, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` are (verdict, ``host/path``) pairs. A rule fits its host and all subdomains if
    the URL's path starts with the rule's path; the longest rule string wins, and among
    equally long ones the longer host. Without a fitting rule the verdict is ``default``:
    the URL is not in the array.

    Defined cases: a NULL URL, or one without ``://``, has empty host and path and no rule;
    a NULL key is returned as NULL; repeated pages give repeated rows; an empty table gives
    an empty result; other columns of the table are not read. The rule list comes from the
    driver and is refused beyond ``max_bytes``.
    """
    spark = pages.sparkSession
    data = digest_file(rules)
    if len(data) > max_bytes:
        raise ValueError("rule list over max_bytes: split it and apply the parts in turn")
    name = f"urls-{uuid.uuid4().hex}.bin"  # a file name can be registered with one path only
    spark.sparkContext.addFile(Scratch(spark, "urls").write_bytes(data, name))
    lengths = sorted({len(r.partition("/")[2]) + 1 for _, r in rules})
    rule_hosts = [r.partition("/")[0] for _, r in rules]
    most_labels = max((h.count(".") + 1 for h in rule_hosts), default=0)
    longest = max(map(len, rule_hosts), default=0)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            hosts, paths, owner, texts, host_len = [], [], [], [], []
            for i, u in enumerate(batch.column(1).to_pylist()):
                host, path = host_and_path(u)
                hosts.append(host)
                paths.append(path)
                prefixes = [path[:n].encode() for n in lengths if n <= len(path)]
                # only the last labels of a host, as many as a rule's host has, can be a rule's host
                suffix = ".".join(host.rsplit(".", most_labels)[-most_labels:]) if prefixes and most_labels else ""
                while suffix:
                    if len(suffix) <= longest:
                        head = suffix.encode()
                        texts += [head + p for p in prefixes]
                        host_len += [len(head)] * len(prefixes)
                        owner += [i] * len(prefixes)
                    suffix = suffix.partition(".")[2]
            best: dict[int, tuple[int, int, int]] = {}
            row = array.find(texts)
            for j in np.flatnonzero(row >= 0):
                cand = (len(texts[j].decode()), host_len[j], int(j))
                if cand > best.get(owner[j], (-1, -1, -1)):
                    best[owner[j]] = cand
            win = [best[i][2] if i in best else -1 for i in range(len(hosts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                 pa.array([texts[w].decode() if w >= 0 else None for w in win], pa.string()),
                 pa.array([VERDICTS[array.verdicts[row[w]]] if w >= 0 else default for w in win], pa.string())],
                names=["key", "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(key, url).mapInArrow(
        judge, f"key {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("key", key)
