"""Exact deduplication by Grace hashing.

Two texts are equal when they are identical once the characters ``[\\x20\\x09-\\x0D]`` are deleted. Null counts as empty;
empty texts are equal to each other. Of equal texts the row with the most code points stays, then the smallest doc_id
(null last); of identical repeated rows exactly one stays. An empty table gives an empty result.

1. *Local pass* (one scan, no shuffle): each task folds the copies that it sees itself into a local head with an open-addressing
   table that compares whole contents. The table is flushed when its contents exceed a byte limit. A head carries the
   content, once for each task and distinct text; after ``MAX_MEMBERS`` copies further ones go to representatives of the head, which
   are ids only, so no join key has more than ``MAX_MEMBERS`` rows of members.
2. *Folding*: where more than ``HOT`` heads share a hash, they are dealt in parts of about ``HOT`` and each part becomes one head, so that
   a text of any number of tasks, a third of the table even, comes to no single task as more contents than that.
3. *Grace pass*: heads are dealt by their hash. Each task partitions what it gets into spill files by further
   bits of the hash, recursively, until a bucket fits the memory limit, and resolves the bucket with the same table.
   The files live as long as the task, like Spark's own spill, so a lost executor only means that its tasks run again.
4. The group of each head is joined back to folded heads, representatives and members.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of

_SPACES = b" \t\n\x0b\x0c\r"
TABLE_BYTES = 48 << 20
MAX_MEMBERS = 512
HOT = 1024
_FAN_BITS = 4
_MAX_DEPTH = 12


class ContentTable:
    """Open addressing with linear probing; an entry is found by hash and then by its complete content."""

    __slots__ = ("slots", "mask", "hashes", "contents", "data", "bytes")

    def __init__(self, capacity: int = 1 << 10):
        self.slots = [-1] * capacity
        self.mask = capacity - 1
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.data: list[list] = []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> tuple[int, bool]:
        """The entry of a content, and whether it is new."""
        if 2 * len(self.hashes) >= len(self.slots):
            self._grow()
        i, slots, mask = h & self.mask, self.slots, self.mask
        while (e := slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            i = (i + 1) & mask
        slots[i] = e = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.data.append([])
        self.bytes += len(content) + 200
        return e, True

    def _grow(self) -> None:
        size = 4 * len(self.slots)
        self.slots, self.mask = [-1] * size, size - 1
        for e, h in enumerate(self.hashes):
            i = h & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = e


_NO_ID = (1 << 63) - 1


def _better(new: tuple, old: tuple) -> bool:
    """(code points, doc_id or the largest long, row): more code points, then smaller id, then smaller row."""
    return (-new[0], new[1], new[2]) < (-old[0], old[1], old[2])


_LOCAL = pa.schema(
    [("kind", pa.int32()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("rep", pa.int64()), ("head", pa.int64()), ("text_sha256", pa.string()),
     ("best_cp", pa.int64()), ("best_id", pa.int64()), ("best_rid", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("content", pa.binary())]
)
_LOCAL_DDL = "kind int, rid long, doc_id long, rep long, head long, text_sha256 string, best_cp long, best_id long, best_rid long, n long, h long, content binary"
_MEMBER, _REP, _HEAD = 0, 1, 2


def _batches(rows: Iterator[tuple], schema: pa.Schema, content: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; ``content`` is the position of a large column."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += 64 + len(r[content] or b"") if content is not None else 64
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


def _local_pass(table_bytes: int, max_members: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 40, 0
        table = ContentTable()

        def heads(t: ContentTable) -> Iterator[tuple]:
            for h, c, (_, best, n, reps, _) in zip(t.hashes, t.contents, t.data):
                yield (_HEAD, None, None, None, reps[0], None, *best, n, h - (1 << 63), c)
                for rep in reps[1:]:
                    yield (_REP, None, None, rep, reps[0], *[None] * 7)

        for b in batches:
            members = []
            for rid, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                content = text.encode("utf-8", "surrogatepass").translate(None, _SPACES)
                e, new = table.find(xxhash.xxh3_64_intdigest(content), content)
                d = table.data[e]
                best = (len(text), _NO_ID if doc_id is None else doc_id, rid)
                if new:  # digest, best row, rows, the head and its representatives, rows of the last one
                    d.extend((hashlib.sha256(content).hexdigest(), best, 0, [], max_members))
                if d[4] >= max_members:
                    d[3].append(base + made)
                    d[4] = 0
                    made += 1
                d[2] += 1
                d[4] += 1
                if _better(best, d[1]):
                    d[1] = best
                members.append((_MEMBER, rid, doc_id, d[3][-1], None, d[0], *[None] * 6))
                if table.bytes > table_bytes:
                    yield from _batches(heads(table), _LOCAL, 11)
                    table = ContentTable()
            yield from _batches(iter(members), _LOCAL)
        yield from _batches(heads(table), _LOCAL, 11)

    return run


_GROUPS = pa.schema([("head", pa.int64()), ("keep_id", pa.int64()), ("keep_rid", pa.int64()), ("group_size", pa.int64())])
_GROUPS_DDL = "head long, keep_id long, keep_rid long, group_size long"
_FOLDED = pa.schema([("part", pa.int64()), *(_LOCAL.field(c) for c in ("head", "best_cp", "best_id", "best_rid", "n", "h", "content"))])
_FOLDED_DDL = "part long, head long, best_cp long, best_id long, best_rid long, n long, h long, content binary"
_REC = struct.Struct("<QqqqqqI")


class _Bucket:
    """Records in memory up to a limit, beyond it in a spill file of the task."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.rows, self.bytes, self.file, self.path = folder, limit, [], 0, None, None

    def add(self, rec: tuple) -> None:
        self.bytes += len(rec[6]) + 200
        if self.file is None and self.bytes <= self.limit:
            self.rows.append(rec)
            return
        if self.file is None:
            fd, self.path = tempfile.mkstemp(dir=self.folder)
            self.file = os.fdopen(fd, "wb", buffering=1 << 18)
            for r in self.rows:
                self._write(r)
            self.rows = []
        self._write(rec)

    def _write(self, r: tuple) -> None:
        self.file.write(_REC.pack(*r[:6], len(r[6])))
        self.file.write(r[6])

    def records(self) -> Iterator[tuple]:
        if self.file is None:
            yield from self.rows
            return
        self.file.close()
        with open(self.path, "rb", buffering=1 << 18) as f:
            while head := f.read(_REC.size):
                *fields, size = _REC.unpack(head)
                yield (*fields, f.read(size))
        os.unlink(self.path)


def _resolve(bucket: _Bucket, depth: int) -> Iterator[tuple]:
    """(hash, content, best row, group size, heads) of each text; a bucket over its limit is partitioned by the next bits first.

    A bucket whose records share all partitioning bits can't be split further; it then holds copies of few contents,
    which the table stores once.
    """
    if bucket.file is not None and depth < _MAX_DEPTH:
        parts = [_Bucket(bucket.folder, bucket.limit) for _ in range(1 << _FAN_BITS)]
        shift = 60 - _FAN_BITS * depth
        for r in bucket.records():
            parts[(r[0] >> shift) & ((1 << _FAN_BITS) - 1)].add(r)
        for p in parts:
            yield from _resolve(p, depth + 1)
        return
    table = ContentTable()
    for h, head, cp, i, rid, n, content in bucket.records():
        e, new = table.find(h, content)
        d = table.data[e]
        if new:
            d.extend(((cp, i, rid), 0, []))
        elif _better((cp, i, rid), d[0]):
            d[0] = (cp, i, rid)
        d[1] += n
        d[2].append(head)
    for h, content, d in zip(table.hashes, table.contents, table.data):
        yield h, content, *d


def _grace_pass(limit: int, fold: bool):
    """Heads (head, best_cp, best_id, best_rid, n, h, content) to their groups; folding gives a head for each text, and whose part each head is."""

    def groups(found: Iterator[tuple]) -> Iterator[tuple]:
        for _, _, (_, i, rid), n, heads in found:
            for head in heads:
                yield head, None if i == _NO_ID else i, rid, n

    def parts(found: Iterator[tuple]) -> Iterator[tuple]:
        for h, content, best, n, heads in found:
            yield (None, heads[0], *best, n, h - (1 << 63), content)
            for part in heads[1:]:
                yield (part, heads[0], *[None] * 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.mkdtemp(prefix="grace-")
        try:
            whole = _Bucket(folder, limit)
            for b in batches:
                for head, cp, i, rid, n, h, content in zip(*(c.to_pylist() for c in b.columns)):
                    whole.add((h + (1 << 63), head, cp, i, rid, n, content))
            found = _resolve(whole, 0)
            yield from _batches(parts(found), _FOLDED, 7) if fold else _batches(groups(found), _GROUPS)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def exact_dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES, max_members: int = MAX_MEMBERS, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: _rid, doc_id, keep_id, group_size, kept, text_sha256."""
    local = materialize(rows_of(docs).mapInArrow(_local_pass(table_bytes, max_members), _LOCAL_DDL), "exact-local")
    row = ("head", "best_cp", "best_id", "best_rid", "n", "h", "content")
    heads = local.filter(F.col("kind") == _HEAD).select(*row)
    often = materialize(heads.groupBy("h").agg(F.count("*").alias("_heads")).filter(F.col("_heads") > hot), "exact-often")
    folded = None
    if not often.isEmpty():
        part = F.pmod(F.xxhash64("head"), F.ceil(F.col("_heads") / hot))
        dealt = heads.join(often, "h").repartition("h", part).select(*row)
        folded = materialize(dealt.mapInArrow(_grace_pass(table_bytes, True), _FOLDED_DDL), "exact-folded")
        heads = heads.join(often, "h", "left_anti").select(*row).union(folded.filter("part is null").select(*row))
    groups = heads.repartition("h").mapInArrow(_grace_pass(table_bytes, False), _GROUPS_DDL)
    if folded is not None:
        groups = materialize(groups, "exact-groups")
        groups = groups.union(folded.filter("part is not null").select("part", "head").join(groups, "head").select(F.col("part").alias("head"), "keep_id", "keep_rid", "group_size"))
    members = local.filter(F.col("kind") == _MEMBER).select("rid", "doc_id", "rep", "text_sha256")
    # A representative stands for its head; the first of a head is the head itself.
    reps = local.filter(F.col("kind") == _REP).select("rep", "head")
    if not reps.isEmpty():
        groups = materialize(groups, "exact-groups")
        groups = groups.union(reps.join(groups, "head").select("rep", "keep_id", "keep_rid", "group_size"))
    return members.join(groups.withColumnRenamed("head", "rep"), "rep").select(
        F.col("rid").alias("_rid"), "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256"
    )
