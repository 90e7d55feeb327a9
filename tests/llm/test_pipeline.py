"""The corpus pipeline against plain Python, stage by stage and as a whole."""

import math
import random
import re
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomspark.llm import common, exact_dedup, line_dedup, minhash, mixing, quality_rules
from loomspark.llm.common import materialize
from loomspark.llm.queries import vocabulary
from tests.llm.test_operators import fill

COLUMNS = "doc_id long, text string, source string"


def rows_here():
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(k, " ".join(words(60 + k % 7)) + "\nshared notice here" * (k < 30), ("a", "b")[k >= 32]) for k in range(60)]
    rows += [(100, None, "a"), (101, "", None), (102, " ".join(words(9)), "a"), (103, "a b c " * 40, "a"), (None, "shared notice here\n" * 12, "a")]
    one, two, three = (" ".join(words(70)) for _ in range(3))
    rows += [(200, one, "b"), (200, one, "b"), (None, one, "c"), (199, one.replace(" ", "  ", 1), "c"), (None, two, None), (None, two, None)]
    near = lambda t, n: " ".join(t.split()[:-n] + [f"x{n}"] * n)
    rows += [(None, near(three, k), None) for k in (1, 2, 3)]  # a group of null ids
    four, five = (" ".join(words(80)) for _ in range(2))
    rows += [(300, near(four, 1), "b"), (300, near(four, 1).upper(), "b"), (301, near(four, 2), "b")]  # the smallest id twice
    rows += [(300, five, "c"), (None, near(five, 1), "c")]  # another group with the same id
    return rows


def quality(rows):
    lines_of = lambda t: [x for x in t.split("\n") if x.strip()]
    norm = lambda x: " ".join(x.lower().split())
    sets = {(s, frozenset(norm(x) for x in lines_of(t or ""))) for _, t, s in rows}
    held, hosts = Counter((s, x) for s, lines in sets for x in lines), Counter(s for s, _ in sets)
    out = []
    for i, t, s in rows:
        w, t = (t or "").split(), t or ""
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = Counter(grams)
        repeated = len({k + d for k, g in enumerate(grams) if count[g] > 1 for d in range(3)})
        gone = lambda x, s=s: held[(s, norm(x))] > max(20, 0.01 * hosts[s])
        left = len(w) - sum(len(x.split()) for x in lines_of(t) if gone(x))
        if len(w) >= 50 and 100 * repeated <= 50 * len(w) and left >= 0.3 * len(w):
            out.append((i, "\n".join(x for x in t.split("\n") if not x.strip() or not gone(x)), s))
    return out


def first_by(rows, groups, key):
    best = {}
    for k, g in enumerate(groups):
        if g not in best or key(k) < key(best[g]):
            best[g] = k
    return [rows[k] for k in best.values()]


def by_id(i):
    return (i is None, i or 0)


def exact(rows):
    return first_by(rows, [re.sub(r"\s", "", t) for _, t, _ in rows], lambda k: (-len(rows[k][1]), by_id(rows[k][0]), k))


def near(rows):
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.lower().split() for _, t, _ in rows)]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [b if x == a else x for x in up]
    return first_by(rows, up, lambda k: (by_id(rows[k][0]), minhash.set_digest(minhash.shingles(rows[k][1].encode(), minhash._WordHashes())), k))


def mix(spark, rows):
    size = [len(t.split()) for _, t, _ in rows]
    u = [r[0] for r in spark.createDataFrame([(k, i, n) for k, ((i, _, _), n) in enumerate(zip(rows, size))], "k long, doc_id long, size long").orderBy("k").select(F.xxhash64(F.lit(mixing.SEED), "doc_id", "size")).collect()]
    names = [*sorted({s for _, _, s in rows if s}), *([None] if any(s is None for _, _, s in rows) else [])]
    sizes = [sum(n for (_, _, s), n in zip(rows, size) if s == x) for x in names]
    out = []
    for s, total, target in zip(names, sizes, fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5, 2)):
        need, before = (target / total - math.floor(target / total)) * total, 0
        for k in sorted((k for k in range(len(rows)) if rows[k][2] == s), key=lambda k: (u[k] % mixing.BINS, u[k])):
            out += [rows[k]] * (math.floor(target / total) + (before + size[k] / 2 <= need))
            before += size[k]
    return out


def test_stages_and_run(spark, tmp_path):
    rows, brute = rows_here(), {"quality_rules": quality, "exact_dedup": exact, "minhash_near_dedup": near, "mix_sources": lambda r: mix(spark, r)}
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs, tidy = spark.read.parquet(f"{tmp_path}/documents.parquet"), lambda x: sorted(map(repr, x))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = brute[name](rows)
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == ["doc_id", "text", "source"]
        got = [tuple(r) for r in got.collect()]
        assert tidy((i, t.lower(), s) for i, t, s in got) == tidy((i, t.lower(), s) for i, t, s in want), name  # ties differ in case only
        rows = got
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    tokens = Tokenizer.from_file(vocabulary())
    tokens.no_truncation()
    tokens.no_padding()
    ids = lambda t: tokens.encode(t, add_special_tokens=False).ids
    shown = lambda t: tokens.decode(ids(t), skip_special_tokens=False)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert tidy((r.doc_id, r.n_tokens, list(r.ids), r.decoded) for r in got) == tidy((i, len(ids(t)), ids(t), shown(t)) for i, t, _ in rows)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert tidy((r.doc_id, r.decoded.lower()) for r in whole) == tidy((i, shown(t).lower()) for i, t, _ in rows)


def test_foreign_columns_nulls_and_empty_tables(spark, tmp_path):
    """Columns with the names that the stages use themselves come through; an empty table gives an empty one."""
    rows = [(k, i, t, s, "r", [k], k) for k, (i, t, s) in enumerate(rows_here())]
    ddl = "_times long, doc_id long, text string, source string, _rid string, _removed array<long>, _copy long"
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/none")
    for name, stage in [*corpus_pipeline.STAGES[:-1], ("repeats", lambda spark, docs, _: line_dedup.without_repeats(docs))]:
        docs = spark.read.parquet(f"{tmp_path}/docs")
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        got = got.collect()
        assert got and all(r._rid == "r" and r._removed == [r._times] and r._copy == r._times and r.doc_id == rows[r._times][1] for r in got), name
        assert stage(spark, spark.read.parquet(f"{tmp_path}/none"), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{tmp_path}/none"), "").count() == 0


def test_row_numbers(spark, tmp_path):
    """The driver's file hashes are those of the scan, so that the seed it picks keeps the files apart."""
    spark.range(2_000).repartition(7).write.parquet(f"{tmp_path}/a b+%/t")
    t = spark.read.parquet(f"{tmp_path}/a b+%/t").filter("id > 3").select("id", F.lit(1).alias("_rid"))
    n = common.numbered(t)
    assert common.has_rid(n) and not common.has_rid(t) and n.select("_rid").distinct().count() == 1_996
    files = common.files_of(t)
    assert len(files) == 7 and {r[0] for r in t.select("_metadata.file_path").distinct().collect()} == set(files)
    assert common.files_of(t.union(t)) == common.files_of(t.limit(3)) == common.files_of(t.select(F.explode(F.array("id", "id")))) == []
    assert common.numbered(t.union(t)).select("_rid").distinct().count() == 2 * 1_996
    start = xxhash.xxh64_intdigest(struct.pack("<q", 5), seed=42)
    assert spark.range(1).select(F.xxhash64(F.lit(5).cast("long"), F.lit("é/x"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("é/x".encode(), seed=start)


def test_rows_stay_themselves_when_splits_move(spark, tmp_path, monkeypatch):
    """The files are dealt to other partitions between the decision and the reading that follows it."""
    key = "spark.sql.files.maxPartitionBytes"
    spark.createDataFrame(rows_here(), COLUMNS).repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    decided = {"quality_rules": (quality_rules, "quality_rules"), "exact_dedup": (exact_dedup, "exact_dedup"), "minhash_near_dedup": (minhash, "near_dedup"), "mix_sources": (mixing, "plan"), "repeats": (line_dedup, "repeated_lines")}
    stages = [*corpus_pipeline.STAGES[:-1], ("repeats", lambda spark, docs, _: line_dedup.without_repeats(docs))]
    tidy = lambda df: sorted(repr((r.doc_id, len((r.text or "").split()), r.source)) for r in df.collect())
    before = spark.conf.get(key)
    for name, stage in stages:
        module, f = decided[name]
        want = tidy(stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)))

        def then_move(*args, f=getattr(module, f), **options):
            out = materialize(f(*args, **options), "test-decided")
            spark.conf.set(key, "1k")
            return out

        with monkeypatch.context() as m:
            m.setattr(module, f, then_move)
            try:
                assert tidy(stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))) == want, name
            finally:
                spark.conf.set(key, before)
