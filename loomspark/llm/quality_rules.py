"""Quality rules with cross-document line frequency; DataFrame functions only.

Rules on the document itself: too few words, or too many words inside repeated three-word windows. Then the method: lines
are normalised (lower case, white space collapsed) and hashed to 128 bits together with their host (the ``source`` column;
null is a host of its own); the distinct documents that hold a line are counted; lines in more than
``max(MIN_DOCS, MAX_SHARE * documents of the host)`` of them are removed, and a document is rejected when less than
``MIN_LEFT`` of its words is left.

Copies of one document are one document here, for a line's count and for the host's: documents are told apart by a digest of
128 bits of their host and whole set of normalised lines. So a page with thousands of copies doesn't make its own lines
boilerplate, while a notice that different documents carry does.

Null and empty texts have no words and fail the base rules. Repeated rows are decided alike. An empty table gives an empty
result. Per host or line nothing is gathered but counts, combined before they are shuffled. The lines over their limit are a
written table, so that the engine can broadcast it when it is measured to be small; else their join with the documents is salted, so
that a line in a third of all documents is no single key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, apart, materialize, numbered, rows_of

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
MIN_DOCS = 20
MAX_SHARE = 0.01
MIN_LEFT = 0.3
SALTS = 16

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _chars_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def with_repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add the number of words that lie in a three-word window which the array column ``words`` holds at least twice.

    A window's 64-bit hash and its position share one long (the position takes the lowest bits that it needs), so that a
    sort of longs brings equal windows together in order; neighbours with equal high bits are equal windows if their full
    hashes are. Walking their positions in order counts the words that they cover. Each step is a column of its own, so that
    nothing is computed again for each element.
    """
    n = F.size(words)
    df = df.withColumn(
        "_w",
        F.when(n < 4, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.xxhash64(F.try_element_at(words, i), F.try_element_at(words, i + 1), F.try_element_at(words, i + 2)))
        ),
    )
    df = df.withColumn("_mask", F.coalesce(F.expr("shiftleft(-1L, int(ceil(log2(size(_w) + 2))))"), F.lit(0).cast("long")))
    df = df.withColumn("_s", F.sort_array(F.transform("_w", lambda h, i: h.bitwiseAND(F.col("_mask")).bitwiseOR(i.cast("long")))))
    at = lambda x: F.get("_w", x.bitwiseAND(F.bitwise_not(F.col("_mask"))).cast("int"))
    df = df.withColumn(
        "_e",
        F.zip_with("_s", F.expr("slice(_s, 2, greatest(size(_s) - 1, 0))"), lambda x, y: F.coalesce((x.bitwiseAND(F.col("_mask")) == y.bitwiseAND(F.col("_mask"))) & (at(x) == at(y)), F.lit(False))),
    )
    hits = F.zip_with("_s", F.zip_with("_e", F.concat(F.array(F.lit(False)), F.col("_e")), lambda a, b: F.coalesce(a, F.lit(False)) | b), lambda x, hit: F.when(F.coalesce(hit, F.lit(False)), x.bitwiseAND(F.bitwise_not(F.col("_mask"))).cast("int")))
    df = df.withColumn("_at", F.when(F.exists("_e", lambda e: e), F.sort_array(F.filter(hits, lambda p: p.isNotNull()))))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc.n + F.least(F.lit(3), p - acc.last)).alias("n"), p.alias("last")),
        lambda acc: acc.n,
    )
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("_w", "_mask", "_s", "_e", "_at")


def _line_hash(host: Column, line: Column) -> list[Column]:
    """128 bits of a line on a host: two hashes with different seeds."""
    norm = F.lower(F.regexp_replace(_trimmed(line), f"[{WS}]+", " "))
    return [F.xxhash64(host, norm).alias("h1"), F.xxhash64(F.lit("line"), norm, host).alias("h2")]


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row per document: its counts, its base verdict, its digest (d1, d2), and the hashes and words of its lines (a written table)."""
    t = rows_of(docs, host).withColumnRenamed(host, "host").withColumn("_trim", _trimmed(F.col("text")))
    t = t.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", f"[{WS}]+")))
    t = t.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: _trimmed(x) != ""))
    t = with_repeated_words(t, "_words", "n_repeat_words")
    t = t.select(
        "_rid",
        "doc_id",
        "host",
        F.xxhash64(F.col("host").isNull(), "host").alias("host_key"),
        F.size("_words").cast("long").alias("n_words"),
        _chars_without(F.col("text"), SPACES).cast("long").alias("word_chars"),
        (F.length("text") - _chars_without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform("_lines", lambda x: F.struct(*_line_hash(F.col("host"), x), F.size(F.split(_trimmed(x), f"[{WS}]+")).alias("w"))).alias("lines"),
    )
    t = t.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    t = t.withColumn("_set", F.sort_array(F.array_distinct(F.transform("lines", lambda x: F.struct(x.h1.alias("h1"), x.h2.alias("h2"))))))
    t = t.withColumn("d1", F.xxhash64("host", "_set")).withColumn("d2", F.xxhash64(F.lit("document"), "_set", "host")).drop("_set", "host")
    return materialize(t, "quality-measures")


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """_rid, doc_id, the counts, base_failed, kept, what the method does to the document, and ``removed``: the hashes of the lines to remove.

    ``n_lines_removed`` lines go and ``n_words_left`` words stay; ``removed`` is null where none go.
    """
    m = measures(docs, host)
    each = m.select("host_key", "d1", "d2", F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(x.h1.alias("h1"), x.h2.alias("h2"))))).alias("x")).select("host_key", "x.h1", "x.h2", "d1", "d2")
    often = each.distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.first("host_key").alias("host_key")).filter(F.col("docs") > MIN_DOCS)
    hosts = m.select("host_key", "d1", "d2").distinct().groupBy("host_key").agg((MAX_SHARE * F.count("*")).alias("limit"))
    # Few lines are over their host's limit; each meets the documents that hold it in SALTS parts.
    lines = materialize(often.join(hosts, "host_key").filter(F.col("docs") > F.col("limit")).select("h1", "h2"), "quality-lines")
    lines = lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = m.select("_rid", F.explode("lines").alias("x")).select("_rid", "x.h1", "x.h2", "x.w", F.pmod(F.xxhash64("_rid"), F.lit(SALTS)).cast("int").alias("salt"))
    over = held.join(lines, ["h1", "h2", "salt"])
    gone = over.groupBy("_rid").agg(F.sum("w").alias("gone"), F.count("*").alias("n_lines_removed"), F.collect_set(F.struct("h1", "h2")).alias("removed"))
    out = m.drop("lines", "host_key", "d1", "d2").join(gone, "_rid", "left").withColumn("n_lines_removed", F.coalesce("n_lines_removed", F.lit(0).cast("long")))
    out = out.withColumn("n_words_left", F.col("n_words") - F.coalesce("gone", F.lit(0).cast("long")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words_left") >= MIN_LEFT * F.col("n_words"))).drop("gone")


def without_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that stay, without the removed lines; texts that lose no line are unchanged."""
    return apart(docs, lambda t: _without_lines(t, host), "doc_id", "text", "n_chars", host)


def _without_lines(docs: DataFrame, host: str) -> DataFrame:
    t = numbered(docs)
    verdict = quality_rules(t, host).filter("kept").select("_rid", F.col("removed").alias("_removed"))
    t = t.join(verdict, "_rid")
    kept_lines = F.filter(F.split("text", "\n"), lambda x: (_trimmed(x) == "") | ~F.array_contains("_removed", F.struct(*_line_hash(F.col(host), x))))
    t = t.withColumn("text", F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n")))
    if "n_chars" in docs.columns:
        t = t.withColumn("n_chars", F.when(F.col("_removed").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return t.select(*docs.columns)
