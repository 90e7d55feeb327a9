"""Page texts of PDF files (S22, S23): a parser is a parameter, the layout is done here.

No PDF library comes with the engine. ``characters`` takes a function from the bytes of one file to its characters; every other step
works on the table of characters (path, page, width, x0, x1, y0, char).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHARACTERS = "path STRING, page INT, width DOUBLE, x0 DOUBLE, x1 DOUBLE, y0 DOUBLE, char STRING"

#: Half of the gutter as a share of the width, the share of each column, of the gutter on page 1 and on later pages,
#: and the height within which characters are one line.
GUTTER, COLUMN, CENTRE_FIRST, CENTRE, LINE = 0.06, 0.3, 0.12, 0.16, 3.0


def characters(spark: SparkSession, path: str, parse: Callable[[bytes], list[tuple]]) -> DataFrame:
    """The characters of each file; ``parse`` returns (page, width, x0, x1, y0, char) and an empty list for an unreadable file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "page", "width", "x0", "x1", "y0", "char"]
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                yield pd.DataFrame([(p, *c) for c in parse(bytes(content))], columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(run, CHARACTERS)


def layout(chars: DataFrame) -> DataFrame:
    """(path, page, two_columns): both sides hold more than 0.3 of the visible characters, the gutter at most its share."""
    x, middle, half = (F.col("x0") + F.col("x1")) / 2, F.col("width") / 2, F.col("width") * GUTTER
    share = lambda cond: F.count_if(cond) / F.count("*")
    t = chars.filter(F.col("char").rlike(r"(?U)\S")).groupBy("path", "page")
    t = t.agg(share(x < middle - half).alias("_l"), share(x > middle + half).alias("_r"), share(F.abs(x - middle) <= half).alias("_c"))
    limit = F.when(F.col("page") > 1, CENTRE).otherwise(CENTRE_FIRST)
    return t.select("path", "page", ((F.col("_l") > COLUMN) & (F.col("_r") > COLUMN) & (F.col("_c") <= limit)).alias("two_columns"))


def _spaced(line: list[tuple[float, float, str]]) -> str:
    """A line's characters by place; a gap is one space, or two if it is wide."""
    out, before = [], None
    for x0, x1, char in sorted(line):
        if before is not None:
            usual = (max(before[1] - before[0], 6) + max(x1 - x0, 6)) / 2
            gap = x0 - before[1]
            out.append("  " if gap > 1.5 * usual else " " if gap > 0.3 * usual else "")
        out.append(char)
        before = (x0, x1)
    return "".join(out)


def _column(rows: pd.DataFrame) -> str:
    lines, height = [], None
    for y, x0, x1, char in sorted(zip(-rows["y0"], rows["x0"], rows["x1"], rows["char"])):
        if height is None or abs(round(-y, 1) - height) > LINE:
            lines.append([])
            height = round(-y, 1)
        lines[-1].append((x0, x1, char))
    return "\n".join(map(_spaced, lines))


def page_texts(chars: DataFrame) -> DataFrame:
    """(path, page, text): lines from the top; of a page in two columns the left one first. A group is one page, whose size is bounded.

    Characters without a place or a text count as none; a page without characters has no row.
    """

    def run(page: pd.DataFrame) -> pd.DataFrame:
        left = page["x0"] < page["width"] / 2
        parts = [page[left], page[~left]] if bool(page["two_columns"].iloc[0]) else [page]
        text = "\n\n".join(x for x in map(_column, parts) if x)
        return pd.DataFrame({"path": [page["path"].iloc[0]], "page": [page["page"].iloc[0]], "text": [text]})

    placed = chars.dropna(subset=["path", "page", "width", "x0", "x1", "y0", "char"])
    t = placed.join(layout(placed), ["path", "page"], "left").fillna(False, subset=["two_columns"])
    return t.groupBy("path", "page").applyInPandas(run, "path STRING, page INT, text STRING")
