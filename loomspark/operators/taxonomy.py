"""Subdomain taxonomy: best known label, refinement decisions and their propagation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X

#: Terms of labels; a label holds a term if it contains it.
BIOMEDICAL_TERMS = ("cancer", "carcinoma", "tumor", "oncology", "lymph", "hepat", "breast", "germ cell", "rna sequencing", "genomic", "biomarker", "diagnostic", "therapy", "therapeutic", "immunology", "pathology", "disease", "syndrome", "infection", "clinical", "medicine")
SPECIALTY_TERMS = ("cancer", "carcinoma", "tumor", "oncology", "breast", "hepat", "germ cell", "lymph", "disease", "syndrome", "infection", "therapy", "therapeutic", "diagnostic", "pathology", "medicine")
PROMOTE_TERMS = ("carcinoma", "tumor", "tumors", "oncology", "lymph", "hepat", "breast cancer", "germ cell", "sarcoma", "lymphoma", "leukemia", "melanoma", "disease", "syndrome", "infection")
GENERIC_TERMS = ("research", "study", "analysis", "assessment", "management", "practice", "workflow", "platform", "approach")
MERGE_PHRASES = ("shared decision making", "decision making", "rna sequencing analysis", "drug delivery systems")
REUSE, MERGE = 0.72, 0.34


def holds(label: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [label.contains(t) for t in terms])


def merge_score(a: Column, b: Column) -> Column:
    """Jaccard of tokens, 1 if equal, at least 0.8 if one label contains the other; 0 without tokens."""
    ta, tb = X.tokens(a), X.tokens(b)
    jaccard = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    return F.when(a == b, 1.0).when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(F.when(a.contains(b) | b.contains(a), F.greatest(jaccard, F.lit(0.8))).otherwise(jaccard))


def best_label(labels: DataFrame, known: DataFrame, score=X.label_similarity, at_least: float = 0.0) -> DataFrame:
    """For each distinct ``label`` the known name (name, ord) with the highest score, the smaller ord on ties; no row where none scores.

    Both scores are 0 unless a label contains the other or shares a token, so an equi-join on such keys finds all candidates.
    """
    a = labels.select("label").distinct().withColumn("_a", X.normalize_label(F.col("label"))).filter("_a != ''")
    b = known.select("name", "ord").withColumn("_b", X.normalize_label(F.col("name"))).filter("_b != ''")
    a = a.withColumn("_k", F.explode(F.array_distinct(N.part_keys(F.col("_a")))))
    b = b.withColumn("_k", F.explode(F.array_distinct(N.part_keys(F.col("_b"), flipped=True))))
    met = a.join(b, "_k").select("label", "_a", "name", "ord", "_b").distinct().withColumn("score", score(F.col("_a"), F.col("_b")))
    best = met.filter((F.col("score") > 0) & (F.col("score") >= at_least)).groupBy("label").agg(F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), "ord")).alias("_r"))
    return best.select("label", "_r.*")


def classify(papers: DataFrame, known: DataFrame, root: str) -> DataFrame:
    """Papers (paper_id, label, parent, confidence) with the known label they come near to; confirmed only if there is one."""
    near = best_label(papers, known, at_least=REUSE).select("label", F.col("name").alias("_name"))
    out = papers.join(near, "label", "left")
    return out.select("paper_id", F.coalesce("_name", "label").alias("subdomain"), F.coalesce(F.nullif(X.strip(F.col("parent")), F.lit("")), F.lit(root)).alias("parent_domain"),
                      F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))).alias("confidence"), F.when(F.col("_name").isNull(), "candidate").otherwise("confirmed").alias("status"))


def fallback_decisions(candidates: DataFrame, confirmed: DataFrame, root: str) -> DataFrame:
    """T10 without a model: merge with the confirmed label of the same normal form, else promote. candidates: name, suggested_parent."""
    c = confirmed.groupBy(X.normalize_label(F.col("name")).alias("_n")).agg(F.max_by("name", "ord").alias("_to"))
    t = candidates.withColumn("_n", X.normalize_label(F.col("name"))).filter("_n != ''").join(c, "_n", "left")
    return t.select(F.col("name").alias("candidate"), F.when(F.col("_to").isNull(), "promote").otherwise("merge").alias("action"), F.coalesce("_to", "name").alias("target_subdomain"), F.coalesce(F.nullif("suggested_parent", F.lit("")), F.lit(root)).alias("parent_domain"))


def post_filter(decisions: DataFrame, confirmed: DataFrame, root: str) -> DataFrame:
    """The five rewrites of decisions, with the ``rule`` that applied; a decision that vanishes stays as an action ``dropped``.

    Decisions without a candidate, target or known action go.
    """
    d = decisions.select(*[X.strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("candidate", "action", "target_subdomain", "parent_domain")])
    d = d.withColumn("action", F.lower("action")).withColumn("parent_domain", F.coalesce(F.nullif("parent_domain", F.lit("")), F.lit(root)))
    d = d.filter("candidate != '' AND target_subdomain != '' AND action IN ('merge', 'promote')")
    others = confirmed.filter(X.normalize_label(F.col("name")) != X.normalize_label(F.lit(root)))
    near = best_label(d.select(F.col("candidate").alias("label")), others, merge_score, MERGE).select(F.col("label").alias("candidate"), F.col("name").alias("_near"))
    n = X.normalize_label(F.col("candidate"))
    generic, bio = (n == "") | holds(n, GENERIC_TERMS), (n != "") & holds(n, BIOMEDICAL_TERMS)
    up = (n != "") & holds(n, PROMOTE_TERMS)
    down = (n == "") | holds(n, MERGE_PHRASES) | (generic & ~holds(n, SPECIALTY_TERMS))
    promote = F.col("action") == "promote"
    rule = (
        F.when(promote & up, "keep_specialty").when(promote & down, "force_merge").when(promote & generic & ~bio, "generic")
        .when(promote & generic & bio, F.when(F.col("_near").isNull(), "dropped").otherwise("generic_biomedical")).when(~promote & up, "force_promote").otherwise("as_decided")
    )
    d = d.join(near, "candidate", "left").withColumn("rule", rule)
    merged = F.col("rule").isin("force_merge", "generic", "generic_biomedical")
    action = F.when(merged, "merge").when(F.col("rule") == "force_promote", "promote").when(F.col("rule") == "dropped", "dropped").otherwise(F.col("action"))
    target = F.when(merged, F.coalesce("_near", F.lit(root))).when(F.col("rule") == "force_promote", F.col("candidate")).otherwise(F.col("target_subdomain"))
    return d.select("candidate", action.alias("action"), target.alias("target_subdomain"), "parent_domain", "rule")


def propagate(papers: DataFrame, decisions: DataFrame, version: int) -> DataFrame:
    """Papers (subdomain, parent_domain, subdomain_status, taxonomy_version) after a round; a label is met in any case."""
    d = decisions.filter("action != 'dropped'").groupBy(F.lower("candidate").alias("_c")).agg(F.max_by(F.struct("target_subdomain", F.col("parent_domain").alias("_parent")), "target_subdomain").alias("_d"))
    t = papers.join(d, F.lower("subdomain") == F.col("_c"), "left")
    return t.select(*[
        {"subdomain": F.coalesce("_d.target_subdomain", "subdomain"), "parent_domain": F.coalesce("_d._parent", "parent_domain"),
         "subdomain_status": F.when(F.col("_c").isNotNull(), "confirmed").otherwise(F.col("subdomain_status")),
         "taxonomy_version": F.when(F.col("_c").isNotNull(), version).otherwise(F.col("taxonomy_version"))}.get(c, F.col(c)).alias(c)
        for c in papers.columns
    ])


def apply_round(candidates: DataFrame, subdomains: DataFrame, suggests: DataFrame, decisions: DataFrame, version: int) -> dict[str, DataFrame]:
    """The taxonomy after a round of decisions, as tables; a name is met in its normal form.

    candidates: name, status; subdomains: name, parent, status, taxonomy_version; suggests: paper_id, candidate; decisions as
    ``post_filter`` gives them. Only open candidates are touched; of several decisions on one the smallest target counts. Result:
    ``candidates`` with their status, ``subdomains`` with new and confirmed ones, ``links`` (candidate, rel_type, target) and
    ``papers`` (paper_id, subdomain, parent_domain, null where the target has none). A paper that suggests several gets the first by name.
    """
    key = lambda c: X.normalize_label(F.col(c), keep_underscore=True)
    d = decisions.filter("action IN ('merge', 'promote')").withColumn("_c", key("candidate"))
    d = d.groupBy("_c").agg(F.min(F.struct("target_subdomain", "action", "parent_domain", "candidate")).alias("d"))
    open_ = candidates.filter("status = 'candidate'").select(key("name").alias("_c")).distinct()
    d = d.join(open_, "_c", "left_semi").select("_c", "d.*")
    up = F.col("action") == "promote"
    d = d.select("_c", "action", F.when(up, F.col("candidate")).otherwise(F.col("target_subdomain")).alias("target"), F.when(up, F.col("parent_domain")).alias("parent"), up.alias("promoted"))
    left = candidates.withColumn("_c", key("name")).join(d.select("_c", "promoted"), "_c", "left")
    new_status = F.when((F.col("status") == "candidate") & F.col("promoted").isNotNull(), F.when(F.col("promoted"), "promoted").otherwise("merged")).otherwise(F.col("status"))
    left = left.withColumn("status", new_status).select(*candidates.columns)
    # What a round writes, by normal form: targets with their parent, and the parents of promoted ones.
    written = d.select(key("target").alias("_s"), F.col("target").alias("name"), "parent").union(d.filter("promoted").select(key("parent"), F.col("parent"), F.lit(None).cast("string")))
    written = written.groupBy("_s").agg(F.max("name").alias("_name"), F.max("parent").alias("_parent"))
    known = subdomains.groupBy(key("name").alias("_s")).agg(F.max(F.struct("name", "parent", "status", "taxonomy_version")).alias("k"))
    now = known.join(written, "_s", "full").select(
        "_s", F.coalesce("_name", "k.name").alias("name"), F.coalesce("_parent", "k.parent").alias("parent"),
        F.when(F.col("_name").isNotNull(), "confirmed").otherwise(F.col("k.status")).alias("status"),
        F.when(F.col("_name").isNotNull(), version).otherwise(F.col("k.taxonomy_version")).alias("taxonomy_version"),
    )
    links = d.select(F.col("_c").alias("candidate"), F.when(F.col("promoted"), "PROMOTED_TO").otherwise("MERGED_INTO").alias("rel_type"), "target")
    moved = suggests.withColumn("_c", key("candidate")).join(d.select("_c", "target"), "_c").withColumn("_s", key("target"))
    first = moved.groupBy("paper_id").agg(F.min(F.struct("_c", "_s")).alias("f")).select("paper_id", F.col("f._s").alias("_s"))
    papers = first.join(now, "_s").select("paper_id", F.col("name").alias("subdomain"), F.col("parent").alias("parent_domain"))
    return {"candidates": left, "subdomains": now.drop("_s"), "links": links, "papers": papers}


# ---- labels of a hierarchy and the fallback without a model


def known_labels(hierarchy: DataFrame, root: str) -> DataFrame:
    """The distinct normalised labels of a hierarchy (child, parent, ord) with ``ord``, their place: the root first, then children and parents as they come."""
    both = hierarchy.select("ord", F.posexplode(F.array("child", "parent")).alias("k", "label")).select((2 * F.col("ord") + F.col("k")).alias("ord"), X.normalize_label(F.col("label")).alias("name"))
    first = hierarchy.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("ord"), X.normalize_label(F.lit(root)).alias("name"))
    return both.unionByName(first).filter("name != ''").groupBy("name").agg(F.min("ord").alias("ord"))


def first_parents(hierarchy: DataFrame) -> DataFrame:
    """(child, parent): the first parent of each normalised child."""
    t = hierarchy.select("ord", *[X.normalize_label(F.col(c)).alias(c) for c in ("child", "parent")]).filter("child != '' and parent != ''")
    return t.groupBy("child").agg(F.min_by("parent", "ord").alias("parent"))


def keyword_scores(papers: DataFrame, rules: list[tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    """(paper_id, subdomain, parent_domain, score, confidence): the first best rule (parent, subdomain, keywords) by keywords in the normalised text.

    Without a hit: cancer, pregnancy and infection words give their default, else general clinical medicine; the confidence is 0.4
    with a hit and 0.25 without. The rules are a parameter of some dozens and are evaluated as literals.
    """
    text = X.normalize_label(F.coalesce("text", F.lit("")))
    scores = F.array(*[sum((F.contains(F.col("_t"), X.normalize_label(F.lit(w))).cast("int") for w in words), F.lit(0)) for _, _, words in rules])
    t = papers.select("paper_id", text.alias("_t")).withColumn("_s", scores).withColumn("score", F.coalesce(F.array_max("_s"), F.lit(0)))
    at = F.array_position("_s", F.col("score")).cast("int") - 1
    pick = lambda k: F.get(F.array(*[X.normalize_label(F.lit(r[k])) for r in rules]), at)
    holds = lambda *ws: reduce(lambda a, b: a | b, [F.contains(F.col("_t"), F.lit(w)) for w in ws])
    default = lambda cancer, birth, germ, other: F.when(holds("cancer", "tumor", "carcinoma"), cancer).when(holds("pregnan", "maternal", "fetal"), birth).when(holds("infection", "virus", "bacterial"), germ).otherwise(other)
    hit = F.col("score") > 0
    sub = F.when(hit, pick(1)).otherwise(default("cancer biology and therapy", "maternal-fetal medicine", "clinical infectious diseases", "general clinical medicine"))
    up = F.when(hit, pick(0)).otherwise(default("oncology", "obstetrics and gynecology", "infectious diseases", None))
    return t.select("paper_id", sub.alias("subdomain"), up.alias("parent_domain"), "score", F.when(hit, 0.4).otherwise(0.25).alias("confidence"))


def relations_of(subdomain: Column, parent: Column, known: Column, given: Column) -> Column:
    """The distinct normalised subclass relations of an answer, loops and blanks apart; a label that isn't known comes first, below its parent."""
    n = lambda c: X.normalize_label(F.coalesce(c, F.lit("")))
    one = lambda s, o: F.struct(s.alias("subject"), F.lit("subclass_of").alias("relation"), o.alias("object"))
    none = F.filter(F.array(one(F.lit(""), F.lit(""))), lambda r: r.subject != "")
    said = F.transform(F.filter(F.coalesce(given, F.array().cast("array<struct<subject:string,relation:string,object:string>>")), lambda r: (X.normalize_label(r.relation, keep_underscore=True) == "subclass_of") & (n(r.subject) != "") & (n(r.object) != "") & (n(r.subject) != n(r.object))), lambda r: one(n(r.subject), n(r.object)))
    own = F.when(~known & (subdomain != "") & (parent != "") & (subdomain != parent), F.array(one(subdomain, parent))).otherwise(none)
    distinct = F.array_distinct(said)
    return F.concat(F.filter(own, lambda r: ~F.coalesce(F.array_contains(distinct, r), F.lit(False))), distinct)
