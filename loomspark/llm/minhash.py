"""MinHash near-deduplication by an inverted join of signature coordinates.

A document's set: the distinct four-word shingles of its ASCII-lower-cased text; with fewer words the whole sequence as one;
without words (null and empty texts too) the set is empty and the document is linked with nothing. Documents are linked when
``100 * intersection >= 80 * union``, which is confirmed on the full sets. Components are numbered by their smallest doc_id.
Documents with equal sets are one *class* from the start (identified by a 128-bit digest of the set), so copies cost nothing
below. Repeated and null ids are allowed; a component of null ids only has a null id. An empty table gives an empty result.

1. *Signatures*: ``K`` MinHash coordinates. Two sets with similarity 0.8 agree in at least ``T`` of the first ``K1`` coordinates
   but for a probability of 1.2e-6, and in at least ``T_ALL`` of all ``K`` but for about 1e-6.
2. *Postings*: by the prefix principle such a pair agrees in one of the first ``K1 - T + 1`` coordinates, so classes are posted
   under these (coordinate, value) pairs only. Lists of one class are dropped.
3. *Stars*: in each list every class is paired with the list's hub alone: the class with the most postings in common with
   others, the centre of a group of copies. The collisions of the pairs are counted over all coordinates; pairs that reach the
   threshold are confirmed on the full sets, and components are formed. Pairs grow with the postings, not with the square of a list.
4. *The rest, exactly*: only lists that still hold different components can hide a link that matters. Their classes are
   compared across components; a list longer than ``LIST`` is first merged with the next coordinates of the prefix (a pair agrees
   in ``T`` coordinates, so it must agree in another one early as well), which skips classes that share just a common passage.
   Lists that merging doesn't shorten, groups of near copies, are compared in blocks, and so is what is long after ``LEVELS`` merges. Classes that
   agree enough, directly or over others, form regions; those with more shingles of their own than a link allows are left out, and
   a region is compared across components on the full sets, in blocks, inside the tasks: only links that connect come out. So no
   link between different components is lost, and a link inside a component changes nothing.
5. *Components* by alternating large-star and small-star steps, as tables; no links or labels come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import has_rid, materialize, numbered, rows_of

K, K1 = 128, 64
T, T_ALL = 35, 80
PREFIX = K1 - T + 1
LIST = 4096  # up to here a list is one tile; merging would copy each of its rows about twenty times
LEVELS = 2
BLOCK = 1280  # rows of a block; a tile holds two
BLOCK_BYTES = 8 << 20
DENSE = 0.3
PROBE = 7
PERCENT = 80
SHINGLE = 4

_MIX = np.random.default_rng(20_240_601).integers(1 << 20, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _WordHashes(dict):
    """64-bit hashes of words, remembered; emptied when many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(s: np.ndarray) -> np.ndarray:
    s ^= s >> np.uint64(32)
    s *= np.uint64(0xD6E8FEB86659FD93)
    s ^= s >> np.uint64(29)
    return s


def shingles(text: bytes, hashes: dict) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    s = w[:-3] * _STEP[0] + w[1:-2] * _STEP[1] + w[2:-1] * _STEP[2] + w[3:] * _STEP[3]
    return np.unique(_mixed(s))


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(out, (_MIX[:, None] * s[None, i : i + 1024]).min(axis=1), out=out)
    return out


def set_digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


_SIGNED = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])
_SIGNED_DDL = "_rid long, doc_id long, n_shingles long, digest binary, keys array<long>, sig binary"
_SALT = np.arange(PREFIX + LEVELS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for b in batches:
        out, seen = [], {}
        for rid, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
            s = shingles(text, hashes)
            node = set_digest(s)
            if node is None:
                out.append((rid, doc_id, 0, None, None, None))
                continue
            if node not in seen:
                v = signature(s)
                keys = _mixed(v[: len(_SALT)] + _SALT).view(np.int64).tolist()
                seen[node] = (keys, (v >> np.uint64(40)).astype(np.uint8).tobytes())  # 8 bits a coordinate for counting collisions
            out.append((rid, doc_id, len(s), node, *seen[node]))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * len(_SIGNED), _SIGNED)], schema=_SIGNED)


def _collisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs (a, b, sig a, sig b) that agree in enough coordinates."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, K) for c in (2, 3))
        keep = pa.array((x == y).sum(axis=1) >= T_ALL)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, set) of the nodes' texts."""
    schema, hashes = pa.schema([("node", pa.int64()), ("members", pa.binary())]), _WordHashes()
    for b in batches:
        sets = [shingles(text, hashes).tobytes() for text in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], schema=schema)


def _confirm(left: pa.Table, right: pa.Table) -> pa.Table:
    """left: (a, b, set b) of one a; right: its set. Keep the pairs whose sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    s = np.frombuffer(right.column("hub_members")[0].as_py(), np.uint64)
    keep = []
    for other in left.column("members").to_pylist():
        o = np.frombuffer(other, np.uint64)
        both = 0
        if 100 * min(len(s), len(o)) >= PERCENT * max(len(s), len(o)):
            small, large = (s, o) if len(s) <= len(o) else (o, s)
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
        keep.append(100 * both >= PERCENT * (len(s) + len(o) - both))
    return left.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).cast(schema)


PAIRS_A_TASK = 256


def sets_of(nodes: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, members): the full sets of the nodes, from the texts. ``reps``: (node, _rid) of a row of each node."""
    found = nodes.join(reps, "node").join(rows_of(docs), "_rid").select("node", "text")
    return materialize(found.mapInArrow(_full_sets, "node long, members binary"), "near-sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets have the similarity."""
    # A node with many partners is dealt in parts of a few hundred.
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_TASK).cast("int").alias("parts"))
    hubs = parts.join(sets, parts.a == sets.node).select(F.col("a").alias("hub"), F.col("members").alias("hub_members"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("hub_part"))
    left = pairs.join(parts, "a").join(sets, F.col("b") == F.col("node")).select("a", "b", "members", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    return left.groupBy("a", "part").cogroup(hubs.groupBy("hub", "hub_part")).applyInArrow(_confirm, "a long, b long")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for node, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = np.frombuffer(members, np.int64)
            for i in range(0, len(s), 50_000):
                part = s[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), node)), pa.array(np.full(len(part), len(s)))], names=["shingle", "node", "size"])


def linkable(sets: DataFrame) -> DataFrame:
    """The nodes whose sets can be similar to another's: at most ``100 - PERCENT`` per cent of their shingles are theirs alone.

    An intersection holds no shingle that only one of the sets has, so with more of them it is too small for any partner.
    """
    own = sets.mapInArrow(_members, "shingle long, node long, size long").groupBy("shingle").agg(F.count("*").alias("n"), F.max("node").alias("node"), F.max("size").alias("size"))
    alone = own.filter("n = 1").groupBy("node").agg((100 * F.count("*") > (100 - PERCENT) * F.max("size")).alias("out")).filter("out").select("node")
    return sets.select("node").join(alone, "node", "left_anti")


STAR_SALTS = 8


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the links (a, b); root is the smallest node of the component.

    The centre of a group of copies has as many edges as the group has members, so joins on a node are dealt in ``STAR_SALTS`` parts by its neighbour.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "near-edges")
    salted = lambda t: t.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(STAR_SALTS)).cast("int"))
    spread = lambda t: t.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(STAR_SALTS - 1)))).hint("merge")  # noqa: E731  no broadcast: its size is estimated before the rows are multiplied
    before = None
    while True:
        # Large star: larger neighbours of u move to the smallest neighbour of u (or u).
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = salted(both.filter("v > u")).join(spread(least), ["u", "_s"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted(large).join(spread(least), ["u", "_s"]).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        edges = materialize(small, "near-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class _Union(dict):
    """Disjoint sets."""

    def find(self, x):
        while (y := self.setdefault(x, x)) != x:
            self[x] = self.setdefault(y, y)
            x = y
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self[x] = y
        return x != y


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each tile; they come in order of group and tile."""
    now, rows = None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if r[:2] != now:
                if len(rows) > 1:
                    yield rows
                now, rows = r[:2], []
            rows.append(r)
    if len(rows) > 1:
        yield rows


def _across(rows: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): the rows of a tile that agree with row i in enough coordinates and are in another component."""
    roots: dict[int, int] = {}
    root = np.array([roots.setdefault(r[4], len(roots)) for r in rows])
    if len(roots) < 2:
        return
    sig = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(-1, K)
    side = np.array([r[2] for r in rows])
    # side 0: both sides of a tile on the diagonal; 1 and 2: the two sides of another tile
    right = np.flatnonzero(side != 1)
    for i in np.flatnonzero(side <= 1):
        js = right[(root[right] != root[i]) & ((right > i) | (side[i] == 1))]
        if len(js):
            js = js[(sig[js, :16] == sig[i, :16]).sum(axis=1) >= 2]  # of 16 coordinates a pair that counts has two but for 1e-10
            js = js[(sig[js] == sig[i]).sum(axis=1) >= T_ALL]
            if len(js):
                yield int(i), js


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs of each tile that agree enough, as many as connect their nodes."""
    for rows in _tiles_of(batches):
        joined, out = _Union(), []
        for i, js in _across(rows):
            out += [(rows[i][3], rows[j][3]) for j in js.tolist() if joined.join(i, j)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=_PAIR)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links of each tile, confirmed on the full sets, as many as connect its components."""
    for rows in _tiles_of(batches):
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        ends = np.cumsum([0, *map(len, sets)])
        _, local = np.unique(np.concatenate(sets), return_inverse=True)
        mark, joined, out = np.zeros(int(local.max()) + 1, np.int32), _Union(), []
        for i, js in _across(rows):
            own = local[ends[i] : ends[i + 1]]
            mark[own] = 1
            for j in js.tolist():
                n, m = len(own), ends[j + 1] - ends[j]
                if 100 * min(n, m) >= PERCENT * max(n, m) and joined.find(rows[i][4]) != joined.find(rows[j][4]):
                    both = int(mark[local[ends[j] : ends[j + 1]]].sum())
                    if 100 * both >= PERCENT * (n + m - both):
                        joined.join(rows[i][4], rows[j][4])
                        out.append((rows[i][3], rows[j][3]))
            mark[own] = 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=_PAIR)


def _mixed_lists(postings: DataFrame) -> DataFrame:
    """The postings of lists that hold more than one component, with the length of the list."""
    lists = postings.groupBy("list").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("list", "n")
    return postings.join(materialize(lists, "near-lists"), "list")


def _open_lists(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """(list, n, node, root) of the lists to compare in full. postings: list, at, node, root."""
    keys, found = classes.select("node", "keys"), None
    for level in range(LEVELS + 1):
        mixed = materialize(_mixed_lists(postings), "near-mixed")
        here = mixed.filter(F.col("n") <= LIST) if level < LEVELS else mixed
        if level < LEVELS:
            longer = mixed.filter((F.col("n") > LIST) & (F.col("at") < PREFIX + level))
            # A list whose members agree in another coordinate too is a group of near copies: merging would only repeat it.
            probe = F.get("keys", F.pmod(F.col("at") + PROBE, F.lit(PREFIX)))
            probed = longer.join(keys, "node").groupBy("list", "n", probe.alias("key")).agg(F.count("*").alias("m"))
            dense = materialize(probed.groupBy("list").agg((F.max("m") >= DENSE * F.max("n")).alias("dense")).filter("dense").select("list"), "near-dense")
            here = here.union(mixed.filter(F.col("n") > LIST).join(dense, "list", "left_semi").select(*mixed.columns))
            further = F.explode(F.sequence(F.col("at") + 1, F.lit(PREFIX + level))).alias("next")
            merged = longer.join(dense, "list", "left_anti").join(keys, "node").select("list", further, "node", "root", "keys")
            postings = merged.select(F.xxhash64("list", F.get("keys", F.col("next"))).alias("list"), F.col("next").alias("at"), "node", "root")
        here = here.select("list", "n", "node", "root")
        found = here if found is None else found.union(here)
    return materialize(found, "near-open")


def _tiled(rows: DataFrame, group: str, blocks, *columns: str) -> DataFrame:
    """(group, tile, side, columns) of a group cut in blocks, each block against each; in order of group and tile.

    Tiles are dealt by ranges of (group, tile) that hold about as many rows each: dealt by hash, some task would get several of the largest.
    """
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct((F.least(x, block) * blocks + F.greatest(x, block)).alias("tile"), F.when(x == block, 0).when(block < x, 1).otherwise(2).alias("side")))
    rows = rows.select(group, F.explode(tiles).alias("_t"), *columns).select(group, "_t.tile", "_t.side", *columns)
    return rows.repartitionByRange(group, "tile").sortWithinPartitions(group, "tile")


def rest(postings: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links across components, enough to connect what they connect; none if no classes in a list agree in enough coordinates."""
    sigs = classes.select("node", "sig")
    lists = _open_lists(postings, classes)
    roots = lists.select("node", "root").distinct()
    edges = _tiled(lists.join(sigs, "node"), "list", F.ceil(F.col("n") / BLOCK).cast("int"), "node", "root", "sig").mapInArrow(_forest, "a long, b long")
    edges = materialize(edges, "near-forest")
    if edges.isEmpty():
        return None
    # All classes that agree enough with others, directly or not, are a region: pairs are compared once there, not in each list.
    regions = materialize(components(edges).withColumnRenamed("root", "region"), "near-regions")
    sets = sets_of(regions.select("node"), docs, classes.select("node", "_rid"))
    sets = linkable(sets).join(sets, "node")
    rows = materialize(regions.join(sets, "node").join(roots, "node").join(sigs, "node").select("region", "node", "root", "sig", "members"), "near-rows")
    size = rows.groupBy("region").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("members")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    return _tiled(rows.join(size, "region"), "region", F.col("blocks"), "node", "root", "sig", "members").mapInArrow(_linked, "a long, b long")


def near_dedup(docs: DataFrame) -> DataFrame:
    """_rid, doc_id, n_shingles, component_id, kept (doc_id is the component's), root (tells components apart) and digest (of the set).

    The last two are null without shingles.
    """
    docs = docs if has_rid(docs) else numbered(docs)
    signed = materialize(rows_of(docs).mapInArrow(_sign, _SIGNED_DDL), "near-signed")
    classes = signed.filter("digest is not null").groupBy("digest")
    classes = classes.agg(F.min("_rid").alias("_rid"), F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")  # numbered once, in the table
    reps = classes.select("node", "_rid")

    posted = classes.select("node", F.posexplode(F.slice("keys", 1, PREFIX)).alias("at", "list"))
    lists = materialize(posted.groupBy("list").agg(F.count("*").alias("n")).filter("n > 1"), "near-lists")
    shared = materialize(posted.join(lists.select("list"), "list").select("list", "at", "node"), "near-postings")
    rank = shared.groupBy("node").agg(F.count("*").alias("rank"))
    hubs = materialize(shared.join(rank, "node").groupBy("list").agg(F.max_by("node", F.struct("rank", "node")).alias("hub")), "near-hubs")
    pairs = shared.join(hubs, "list").filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    sigs = classes.select("node", "sig")
    counted = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
    likely = materialize(counted.mapInArrow(_collisions, "a long, b long"), "near-pairs")
    links = materialize(confirmed(likely, sets_of(_ends(likely), docs, reps)), "near-links")
    roots = materialize(components(links), "near-roots")

    labelled = shared.join(roots, "node", "left").select("list", "at", "node", F.coalesce("root", "node").alias("root"))
    more = rest(labelled, docs, classes)
    if more is not None:
        roots = materialize(components(links.union(more)), "near-roots")

    named = classes.select("digest", "node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = materialize(named.join(names, "root").select("digest", "component_id", "root"), "near-named")
    out = signed.select("_rid", "doc_id", "n_shingles", "digest").join(named, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("_rid", "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "root", "digest")
