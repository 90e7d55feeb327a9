"""Claim filters, deduplication and caps. Claims carry ``claim_ord``, the order in which they were extracted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Document words, generic entities, verbs and prefixes of sentence fragments, blacklists.
ARTIFACTS = ("abstract", "introduction", "discussion", "conclusions", "conclusion", "results", "methods", "materials", "keywords", "figure", "fig", "table", "supplementary", "supporting information", "acknowledgements", "funding", "reference", "references", "graphical abstract", "page")
GENERIC = ("study", "this study", "our study", "present study", "current study", "analysis", "result", "results", "finding", "findings", "data", "authors", "researchers", "paper", "article", "review", "work", "case", "cases", "presented case", "reported case", "literature")
META = ("study", "this study", "our study", "analysis", "findings", "results", "data", "authors", "we", "review", "paper", "article", "patient cohort")
PRONOUNS = ("we", "they", "patients", "subjects", "participants")
VERBS = ("demonstrated", "showed", "show", "found", "investigated", "evaluated", "analyzed", "examined", "included", "presented", "received", "used", "reported", "compared", "suggested", "indicated")
PREFIXES = ("retrospective ", "prospective ", "randomized ", "multicenter ", "single center ", "patient with ", "patients with ", "patient in ", "patients in ", "case of ")
NAME_BLACKLIST = ("示例", "食谱示例", "附录", "参考文献", "目录", "章节", "表格", "注释", "说明", "附表", "附件", "索引", "图表", "备注", "abstract", "introduction", "discussion", "conclusion", "conclusions", "results", "methods", "materials", "keywords", "figure", "fig", "table", "supplementary", "supporting information", "acknowledgements", "funding", "references", "graphical abstract", "page")
ARTIFACT_START = r"(?i)^(abstract|introduction|discussion|conclusions?|results|methods?|keywords?|figure|fig|table|supplementary|page)\b"
META_EVIDENCE = r"(?i)\b(this study|our study|we (investigated|evaluated|analyzed|examined|show|showed|demonstrated|found|propose|present)|the authors|retrospective study|prospective study|randomized study|in this study)\b"
ODD_RELATIONS = ("related", "relation", "relevant", "link", "mentioned")
METHOD_RELATIONS = ("type", "subclass_of", "part_of", "measured_in")


def is_fragment(low: Column) -> Column:
    """More than five words with a reporting verb, or a noisy beginning."""
    words = F.split(low, r"(?U)\s+")
    starts = low.rlike("^(" + "|".join(PREFIXES) + ")")
    return (X.n_words(low) > 5) & (F.arrays_overlap(words, F.array(*map(F.lit, VERBS))) | starts)


def is_meta(name: Column) -> Column:
    """P03."""
    low = X.strip(F.lower(name))
    return low.isin(*META) | low.rlike(r"^(this|our)\s+(study|analysis|work|paper|review)\b")


def valid_entity(name: Column, claim_type: Column) -> Column:
    """P01."""
    n = X.strip(F.coalesce(name, F.lit("")))
    low = F.lower(n)
    bad = (
        (F.length(n) < 2) | (F.length(n) > 120) | low.isin(*ARTIFACTS) | low.isin(*GENERIC) | low.rlike(r"^(fig|figure|table|section|page)\b")
        | low.rlike(r"^(this|these|those|our)\s+(study|analysis|result|finding|paper|work|review)\b") | n.rlike("[：:]$") | (X.n_words(n) > 15)
        | (F.length(F.regexp_replace(n, r"(?U)[^\p{L}\p{N}]", "")) < 2) | is_fragment(low) | ((claim_type == "instance") & low.isin(*PRONOUNS))
    )
    return ~bad


def with_drop_reason(claims: DataFrame) -> DataFrame:
    """Claims with ``drop_reason``: the first rule by which a claim is dropped; null for those that stay.

    The trimmed texts and their word counts are columns of a projection of their own, so that no rule computes them again; the rules that
    compare come before those that search.
    """
    names = ("subject", "object", "relation", "evidence")
    t = claims.withColumns({f"_{c}": X.strip(F.coalesce(F.col(c), F.lit(""))) for c in names} | {"_title": F.lower(X.strip(F.coalesce("section_title", F.lit(""))))})
    t = t.withColumns({f"_n_{c}": X.n_words(F.col(f"_{c}")) for c in ("subject", "object", "relation")})
    s, o, r, e, title = (F.col(c) for c in ("_subject", "_object", "_relation", "_evidence", "_title"))
    symbols = lambda x: ~x.rlike(r"(?U)[^\d\W_]")
    why = (
        F.when(s == o, "self_loop")
        .when(F.length(e) < 10, "short_evidence")
        .when(s.rlike(ARTIFACT_START) | o.rlike(ARTIFACT_START), "artifact")
        .when(~r.isin(*X.ONTOLOGY_RELATIONS, *X.INSTANCE_RELATIONS), "relation_set")
        .when((F.col("_n_subject") > 15) | (F.col("_n_object") > 15), "sentence")
        .when((F.length(r) > 40) | (F.col("_n_relation") > 5) | F.lower(r).isin(*ODD_RELATIONS), "relation_shape")
        .when(symbols(s) | symbols(o), "symbols")
        .when(is_meta(s) | is_meta(o), "meta_entity")
        .when(e.rlike(META_EVIDENCE), "meta_evidence")
        .when(title.rlike("^(introduction|background)") & (F.col("claim_type") == "instance"), "section")
        .when(title.rlike("methods|experimental|materials") & ~r.isin(*METHOD_RELATIONS), "section")
    )
    return t.withColumn("drop_reason", why).select(*claims.columns, "drop_reason")


def blacklisted(name: Column) -> Column:
    """A name that begins or ends with a document word (case-sensitive)."""
    return F.exists(F.array(*map(F.lit, NAME_BLACKLIST)), lambda w: name.startswith(w) | name.endswith(w)) | (X.strip(name) == "")


def structural_verdict() -> Column:
    """The structural reason for a rejection, else null."""
    same_id = (F.col("subject_id") != "") & (F.col("subject_id") == F.col("object_id"))
    return F.when(same_id, "self_loop").when(F.lower("subject") == F.lower("object"), "same_entity").when(blacklisted(F.col("subject")), "invalid_subject").when(blacklisted(F.col("object")), "invalid_object")


def first_of(claims: DataFrame, *key: Column) -> DataFrame:
    """The first claim of each key. The whole claim is the aggregate's value, so copies are folded before the shuffle."""
    row = F.struct("claim_ord", *[c for c in claims.columns if c != "claim_ord"])
    named = [k.alias(f"_k{n}") for n, k in enumerate(key)]
    return claims.groupBy(*named).agg(F.min_by(row, "claim_ord").alias("_r")).select("_r.*").select(*claims.columns)


def cap(claims: DataFrame, n: int, *group: str) -> DataFrame:
    """At most n claims a group, by priority and then order."""
    score = X.claim_priority(*[F.col(c) for c in ("claim_type", "relation", "section_title", "subject", "object")])
    w = Window.partitionBy(*group).orderBy(F.desc("priority"), "claim_ord")
    return claims.withColumn("priority", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def bag_union(*chunks: DataFrame) -> DataFrame:
    """The claims of all chunks, repeated ones too; columns are met by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chunks)
