"""Line deduplication by winnowing; exact on windows of ``RUN_WORDS`` words.

The rule: of equal windows of ``RUN_WORDS`` words the first one by doc_id (null last), row and position stays, and the words of
all others are deleted, whatever lines, documents or shorter repeats they lie in.

A *gram* is ``GRAM_WORDS`` words. Each window selects the gram with the smallest hash inside it (the rightmost of equal ones), so
equal windows select equal grams at the same place. The windows side by side that select one gram are its *block*; there is one
for about every eighteen words. Only equal grams are compared, and in two steps: blocks that are equal as a whole are decided
together, by the first of them; where a gram has different blocks, the windows of the first block of each kind are decided one
by one. Both steps take the smallest place of a key and join it back, so the rows grow with the text, not with the square of
any group, whatever a gram's frequency.

Equality is that of 64-bit hashes over 32-bit hashes of the words. Null and empty texts have no words and lose none. Repeated
rows are occurrences like others: the first one stays. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, materialize, numbered, rows_of

GRAM_WORDS = 16
RUN_WORDS = 50

_NONE = (1 << 63) - 1
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)
_CHUNK = 1 << 18  # words that are looked at side by side
_LINES_DDL = "rid long, id long, doc_id long, n_words long, hashes array<int>, blocks array<struct<gram:long,block:long,start:int,n:int>>"


def _mixed(g: np.ndarray) -> np.ndarray:
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, base, np.uint64)), dtype=np.uint64)


def _prefix(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which ``_between`` takes the hash of any run of words, from 32-bit hashes of the words."""
    with np.errstate(over="ignore"):
        h = _mixed((words.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD))
        return np.append(np.zeros(1, np.uint64), np.cumsum(h * _powers(_ODD, len(words))[:-1], dtype=np.uint64)), _powers(_BACK, len(words))


def _between(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed((sums[0][stop] - sums[0][start]) * sums[1][start])


def select_blocks(words: np.ndarray, ends: np.ndarray, gram_words: int, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, block, start, windows) of each block, by position. The texts lie side by side; ``ends`` has the end of each word's text."""
    begin = np.nonzero(np.arange(len(words)) + run_words <= ends)[0]
    if not len(begin):
        return (np.zeros(0, np.int64),) * 4
    sums, width = _prefix(words), run_words - gram_words + 1
    at = np.arange(len(words) - gram_words + 1)
    g = _between(sums, at, at + gram_words)
    best, w = at, 1
    while 2 * w <= width:
        x, y = best[:-w], best[w:]
        best, w = np.where(g[y] <= g[x], y, x), 2 * w
    x, y = best[begin], best[begin + width - w]
    chosen = np.where(g[y] <= g[x], y, x)  # by window, never falling inside a text
    edge = np.concatenate([[0], np.nonzero(np.diff(chosen))[0] + 1, [len(begin)]])
    start, n = begin[edge[:-1]], np.diff(edge)
    chosen = chosen[edge[:-1]]
    with np.errstate(over="ignore"):  # the words of the block, how many there are, and where its gram stands
        block = _mixed(_between(sums, start, start + n + run_words - 1) + (n * run_words + chosen - start).astype(np.uint64) * np.uint64(_ODD))
    return g[chosen].view(np.int64), block.view(np.int64), start, n


def _lists(sizes, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32()), values)


def _read_lines(gram_words: int, run_words: int):
    def chunk(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        words = np.concatenate([r[2] for r in rows])
        gram, block, start, n = select_blocks(words, np.repeat(edges[1:], sizes), gram_words, run_words)
        doc = np.searchsorted(edges, start, side="right") - 1
        blocks = pa.StructArray.from_arrays([pa.array(gram), pa.array(block), pa.array((start - edges[doc]).astype(np.int32)), pa.array(n.astype(np.int32))], ["gram", "block", "start", "n"])
        ids = pa.array([r[1] for r in rows], pa.int64())
        columns = [pa.array([r[0] for r in rows], pa.int64()), ids.fill_null(_NONE), ids, pa.array(sizes), _lists(sizes, pa.array(words.view(np.int32))), _lists(np.bincount(doc, minlength=len(rows)), blocks)]
        return pa.RecordBatch.from_arrays(columns, names=["rid", "id", "doc_id", "n_words", "hashes", "blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for rid, doc_id, text in zip(*(b.column(k) for k in range(3))):
                w = text.as_buffer().to_pybytes().split() if text.is_valid else []
                rows.append((rid.as_py(), doc_id.as_py(), np.fromiter(map(xxhash.xxh32_intdigest, w), np.uint32, len(w))))
                held += len(w) + 16
                if held > _CHUNK:
                    yield chunk(rows)
                    rows, held = [], 0
        if rows:
            yield chunk(rows)

    return run


def _windows(run_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rid, id, hashes, blocks): a row for each window of the blocks."""
        for b in batches:
            blocks = b.column(3).to_pylist()
            for k, (rid, id_) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                sums = _prefix(b.column(2)[k].values.to_numpy().view(np.uint32))
                start = np.concatenate([np.arange(x["start"], x["start"] + x["n"]) for x in blocks[k]])
                h = _between(sums, start, start + run_words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), id_)), pa.array(np.full(len(h), rid)), pa.array(start.astype(np.int32))], names=["window", "id", "rid", "start"])

    return run


def repeated_lines(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """_rid, doc_id, n_words, removed: the spans of removed words (from, to), counted over the whole text, sorted and apart."""
    place = F.struct("id", "rid", "start")
    lines = materialize(rows_of(docs).mapInArrow(_read_lines(gram_words, run_words), _LINES_DDL), "line-hashes")
    at = lines.select("id", "rid", F.inline("blocks"))
    grams = at.groupBy("gram").agg(F.count("*").alias("_n"), (F.min("block") != F.max("block")).alias("differ")).filter("_n > 1")
    grams = materialize(grams.select("gram", "differ"), "line-grams")
    met = materialize(at.join(grams, "gram"), "line-blocks")
    # The firsts are written tables, so that the engine can split the joins where one key has many rows.
    firsts = materialize(met.groupBy("gram", "block").agg(F.min(place).alias("f")), "line-firsts")
    met = materialize(met.join(firsts, ["gram", "block"]).select("id", "rid", "start", "n", "differ", (place == F.col("f")).alias("first")).filter("differ or not first"), "line-places")
    # The windows of the first blocks of each kind; the windows of the other blocks are those of a block before.
    open_ = met.filter("first").groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("blocks"))  # the blocks of one document
    open_ = open_.join(lines.select("rid", "id", "hashes"), "rid").select("rid", "id", "hashes", "blocks")
    windows = materialize(open_.mapInArrow(_windows(run_words), "window long, id long, rid long, start int"), "line-windows")
    firsts = materialize(windows.groupBy("window").agg(F.min(place).alias("f"), F.count("*").alias("_n")).filter("_n > 1").select("window", "f"), "line-window-firsts")
    later = windows.join(firsts, "window").filter(place != F.col("f")).select("rid", "start", F.lit(1).alias("n"))
    runs = met.filter("not first").select("rid", "start", "n").union(later)
    gone = runs.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("runs"))  # the runs of one document
    out = lines.select("rid", "doc_id", "n_words").join(gone, "rid", "left")
    return out.mapInArrow(_spans(run_words), "_rid long, doc_id long, n_words long, removed array<struct<from:int,to:int>>")


def _spans(run_words: int):
    spans = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of windows as spans of words, those that meet as one."""
        for b in batches:
            out = []
            for runs in b.column(3).to_pylist():
                got = []
                for r in runs or ():
                    x, y = r["start"], r["start"] + r["n"] - 1 + run_words
                    if got and x <= got[-1]["to"]:
                        got[-1]["to"] = max(got[-1]["to"], y)
                    else:
                        got.append({"from": x, "to": y})
                out.append(got)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, spans)], names=["_rid", "doc_id", "n_words", "removed"])

    return run


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed (spans), words_removed, removed (from:to of words, comma-joined)."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])
    joined = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["from"], r["to"])), ",")
    return found.select("doc_id", "n_words", F.size("removed").cast("long").alias("n_removed"), gone.alias("words_removed"), joined.alias("removed"))


def cut_words(text: str, spans: list[dict]) -> str:
    """A text without the spans of words and the white space after each; white space before a span at the end goes too."""
    starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    out, at = "", 0
    for r in spans:
        out, at = out + text[at : starts[r["from"]]], starts[r["to"]]
    return (out + text[at:]) if at < len(text) else out.rstrip(" \t\n\v\f\r")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with later repeated runs deleted from their texts; other columns and texts are unchanged."""

    @F.pandas_udf("string")
    def shorter(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([x if r is None else cut_words(x, list(r)) for x, r in zip(text, spans)], dtype=object)

    def cut(docs: DataFrame) -> DataFrame:
        t = numbered(docs)
        gone = repeated_lines(t).filter(F.size("removed") > 0).select("_rid", F.col("removed").alias("_removed"))
        return t.join(gone, "_rid", "left").withColumn("text", shorter("text", "_removed")).select(*docs.columns)

    return apart(docs, cut, "doc_id", "text")
