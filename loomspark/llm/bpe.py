"""BPE encoding and decoding through one table of distinct words.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of a text. The vocabularies served here drop white space before merging and never
merge across it, so the ids of a text are the ids of its words in order, special tokens included (they hold no white space).
Null and empty texts, and texts of white space only, have no ids and decode to the empty text. Repeated rows give repeated
results, an empty table an empty one; other columns don't matter. Very long texts and words are whole.

1. *Split*: the engine splits each text into words. Each task numbers the words of a block of documents (up to ``BLOCK_BYTES`` of
   text), frequent ones first, and writes the block's documents as these numbers, packed, and its distinct words once, packed by
   parts of the hash of a word.
2. *Encode*: the words of all blocks meet by part, and each distinct word of a part is encoded once, whatever the number of blocks and
   documents it stands in. The number of parts grows with the input, so a part's table stays small; one that reaches ``TABLE_WORDS`` is begun anew.
3. *Join*: the ids come back to each block, where the documents' numbers are replaced by position.
4. *Decode*: ids are joined with the id-to-piece table, whose size is the vocabulary's, word by word of a block, and placed likewise.

A block is bounded, and so are its words; a word that stands everywhere is one word of each block.
"""

from __future__ import annotations

import hashlib
import math
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, files_of, materialize, rows_of

BLOCK_BYTES = 24 << 20
WHOLE_BYTES = 8 << 20  # where ids and texts come out whole, a block is a smaller one
PART_BYTES = 12 << 20
TABLE_WORDS = 1_000_000


@lru_cache(maxsize=2)
def load_tokenizer(blob: str):
    """The tokenizer of a vocabulary file's content, without truncation and padding; one per Python process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(blob)
    t.no_truncation()
    t.no_padding()
    return t


def id_pieces(spark, path: str) -> DataFrame:
    """(id, piece) of a vocabulary; tens of thousands of rows, fixed by the file."""
    t = load_tokenizer(Path(path).read_text())
    return spark.createDataFrame(sorted((i, p) for p, i in t.get_vocab(with_added_tokens=True).items()), "id int, piece string")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) of an array of ids per key, special tokens included, by the id-to-piece join.

    Ids that the vocabulary lacks are skipped. Keys are meant to be unique; the pieces of one key are gathered.
    """
    at = encoded.select(key, F.posexplode_outer(ids).alias("_at", "id"))
    pieces = at.join(F.broadcast(id_pieces(encoded.sparkSession, path)), "id", "left")  # bounded by the vocabulary
    joined = pieces.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("_at", "piece")))).alias("_p"))
    return joined.select(key, F.array_join(F.col("_p.piece"), " ").alias("decoded"))


def squeeze(raw: bytes, level: int = 1) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def loosen(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], size, asbytes=True) if size else b""


def pack(numbers: np.ndarray) -> bytes:
    """Numbers of seven bits a byte, 128 added where more follow: the first bytes of all, then the second ones, and so on; compressed."""
    n, planes = np.ascontiguousarray(numbers, np.uint32), [len(numbers).to_bytes(8, "little")]
    while len(n):
        more = n >= 128
        planes.append(((n & 127) | np.where(more, 128, 0).astype(np.uint32)).astype(np.uint8).tobytes())
        n = n[more] >> np.uint32(7)
    return squeeze(b"".join(planes))


def unpack(data: bytes) -> np.ndarray:
    raw = loosen(data)
    count, at = int.from_bytes(raw[:8], "little"), 8
    out, open_, shift = np.zeros(count, np.int64), np.arange(count), 0
    while len(open_):
        b = np.frombuffer(raw, np.uint8, len(open_), at)
        at += len(b)
        out[open_] |= (b & 127).astype(np.int64) << shift
        open_, shift = open_[b >= 128], shift + 7
    return out


_LOCAL_DDL = "block long, part int, packed binary, rids array<long>, doc_ids array<long>, sizes array<int>"
_LOCAL = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("packed", pa.binary()), ("rids", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])


def _number(parts: int, block_bytes: int):
    """Blocks of documents: a row for the distinct words of each part (lines), and one with the documents as numbers of words.

    The r-th word of part p has the number ``r * parts + p``; frequent words have small ones.
    """

    def rows(made: int, docs: pa.Table) -> Iterator[tuple]:
        words = docs.column("words").combine_chunks()
        words = words if isinstance(words, pa.ListArray) else pa.concat_arrays(words.chunks)
        flat = words.flatten().dictionary_encode()
        codes, distinct = flat.indices.to_numpy(), flat.dictionary.cast(pa.binary()).to_pylist()
        often = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")
        part = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct)) % np.uint32(parts)
        order = often[np.argsort(part[often], kind="stable")]  # by part, then by frequency
        ends = np.cumsum(np.bincount(part, minlength=parts))
        number = np.empty(len(distinct), np.int64)
        number[order] = (np.arange(len(order)) - (ends - np.diff(ends, prepend=0))[part[order]]) * parts + part[order]
        placed = [distinct[k] for k in order.tolist()]
        for p, (x, y) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
            if y > x:
                yield made, p, squeeze(b"\n".join(placed[x:y]) + b"\n", 9), None, None, None  # no word holds a line end
        sizes = np.diff(words.offsets.to_numpy()).tolist()
        yield made, None, pack(number[codes]), docs.column("_rid").to_pylist(), docs.column("doc_id").to_pylist(), sizes

    def block(made: int, docs: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows(made, docs)), _LOCAL)], schema=_LOCAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size = TaskContext.get().partitionId() << 24, [], 0
        for b in batches:
            step = max(1, int(b.num_rows * block_bytes / max(b.nbytes, 1)))
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                held.append(part)
                size += b.nbytes * part.num_rows // b.num_rows
                if size > block_bytes:
                    yield block(made, pa.Table.from_batches(held))
                    made, held, size = made + 1, [], 0
        if held:
            yield block(made, pa.Table.from_batches(held))

    return run


_IDS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("lens", pa.binary()), ("ids", pa.binary())])


def _encode(blob):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of the words of parts, in their order; each distinct word is encoded once."""
        tokenizer, known = load_tokenizer(blob.value), {}
        for b in batches:
            for one, part, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = loosen(packed).split(b"\n")[:-1]
                new = [w for w in words if w not in known]
                if len(known) + len(new) > TABLE_WORDS:
                    known, new = {}, words
                for k in range(0, len(new), 20_000):
                    known.update(zip(new[k : k + 20_000], (array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast([w.decode() for w in new[k : k + 20_000]], add_special_tokens=False))))
                ids = [known[w] for w in words]
                lens = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                yield pa.RecordBatch.from_arrays([pa.array([one]), pa.array([part], pa.int32()), pa.array([pack(lens)]), pa.array([pack(np.frombuffer(b"".join(ids), np.uint32))])], schema=_IDS)

    return run


_DOCS = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_DIGESTS = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _place(pieces, parts: int, digests: bool):
    schema = _DIGESTS if digests else _DOCS

    def run(words: pa.Table, docs: pa.Table) -> pa.Table:
        """The documents of a block: numbers replaced by ids and by pieces, by position."""
        piece_of, lens = pieces.value, [unpack(x) for x in words.column("lens").to_pylist()]
        ids = [b""] * (parts * max(map(len, lens)))
        texts = ids.copy()
        for part, n_ids, packed in zip(words.column("part").to_pylist(), lens, words.column("ids").to_pylist()):
            x, at = unpack(packed).astype(np.uint32).tobytes(), 0
            for r, n in enumerate(n_ids.tolist()):
                ids[r * parts + part] = one = x[at : at + 4 * n]
                texts[r * parts + part] = b" ".join(map(piece_of.__getitem__, array("I", one)))
                at += 4 * n
        out, batches = [], []

        def done() -> None:
            """The rows so far as a batch, so that only one form of most texts is held."""
            columns = [list(c) for c in zip(*out)]
            if not digests:
                columns[3] = pa.ListArray.from_arrays(np.cumsum([0, *map(len, columns[3])], dtype=np.int64).astype(np.int32) // 4, pa.array(np.frombuffer(b"".join(columns[3]), np.int32)))
                columns[4] = pa.array(columns[4], pa.binary()).cast(pa.string())
            batches.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))
            out.clear()

        for rids, doc_ids, sizes, packed in zip(*(docs.column(c).to_pylist() for c in ("rids", "doc_ids", "sizes", "packed"))):
            numbers, at = unpack(packed), 0
            for rid, doc_id, size in zip(rids, doc_ids, sizes):
                mine = numbers[at : at + size].tolist()
                at += size
                x = b"".join(map(ids.__getitem__, mine))
                text = b" ".join(filter(None, map(texts.__getitem__, mine)))
                out.append((rid, doc_id, len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(text).hexdigest()) if digests else (rid, doc_id, len(x) // 4, x, text))
                if len(out) >= 500:
                    done()
        if out:
            done()
        return pa.Table.from_batches(batches, schema)

    return run


def n_parts(docs: DataFrame) -> int:
    """Parts of words by the size of the files, or as many as shuffles have for other frames."""
    if files_of(docs):
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return max(8, min(1 << 16, math.ceil(size / PART_BYTES)))
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def encode_decode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """_rid, doc_id, n_tokens and ids (array<int>) with the decoded text, or their SHA-256 digests.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8.
    """
    sc, parts = docs.sparkSession.sparkContext, n_parts(docs)
    text = Path(path).read_text()
    blob = sc.broadcast(text)  # the vocabulary file, a few MB; executors need no copy
    pieces = sc.broadcast({i: p.encode() for p, i in load_tokenizer(text).get_vocab(with_added_tokens=True).items()})  # the id-to-piece table
    words = rows_of(docs).select("_rid", "doc_id", F.split("text", f"[{WS}]+").alias("words"))
    local = materialize(words.mapInArrow(_number(parts, BLOCK_BYTES if digests else WHOLE_BYTES), _LOCAL_DDL), "bpe-words")
    distinct = local.filter("part is not null").select("block", "part", "packed").repartition(parts, "part")
    ids = distinct.mapInArrow(_encode(blob), "block long, part int, lens binary, ids binary")
    blocks = local.filter("part is null").select("block", "rids", "doc_ids", "sizes", "packed")
    ddl = "_rid long, doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return ids.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_place(pieces, parts, digests), ddl)
