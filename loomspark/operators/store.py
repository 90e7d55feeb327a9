"""The graph as stored tables: claims and taxonomy written by upsert.

A store is a dict of frames; every function returns the new frames and leaves writing to the caller, so that batch and stream share
them. An upsert is one aggregate over the stored and the new rows of a key, without a join: the newest row counts, ``created_at`` is
the oldest. Times are milliseconds and a parameter, so reruns agree.

nodes(id, name, labels, is_concept, created_at, updated_at), edges(edge_id, src, dst, rel_type, version, source_paper, evidence,
relation_original, is_ontology, created_at); papers, subdomains, hierarchy, candidates, suggests, candidate_parents, classified.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import graph as G

NODES = "id STRING, name STRING, labels ARRAY<STRING>, is_concept BOOLEAN, created_at BIGINT, updated_at BIGINT"
EDGES = "edge_id STRING, src STRING, dst STRING, rel_type STRING, version BIGINT, source_paper STRING, evidence STRING, relation_original STRING, is_ontology BOOLEAN, created_at BIGINT"
PAPERS = "id STRING, title STRING, abstract STRING, keywords ARRAY<STRING>, subdomain STRING, parent_domain STRING, subdomain_reason STRING, subdomain_confidence DOUBLE, subdomain_status STRING, batch_id STRING, taxonomy_version INT, created_at BIGINT, updated_at BIGINT"
SUBDOMAINS = "normalized_name STRING, name STRING, status STRING, taxonomy_version INT, is_root BOOLEAN, created_at BIGINT, updated_at BIGINT"
HIERARCHY = "child STRING, parent STRING, source STRING, created_at BIGINT, updated_at BIGINT"
CANDIDATES = "normalized_name STRING, source_batch_id STRING, source_taxonomy_version INT, name STRING, suggested_parent STRING, confidence DOUBLE, reason STRING, status STRING, created_at BIGINT, updated_at BIGINT"
SUGGESTS = "paper_id STRING, normalized_name STRING, source_batch_id STRING, source_taxonomy_version INT, source STRING, reason STRING, confidence DOUBLE, created_at BIGINT, updated_at BIGINT"
PARENTS = "normalized_name STRING, source_batch_id STRING, source_taxonomy_version INT, parent STRING, source STRING, created_at BIGINT, updated_at BIGINT"
CLASSIFIED = "paper_id STRING, subdomain STRING, source STRING, reason STRING, confidence DOUBLE, created_at BIGINT, updated_at BIGINT"
TABLES = {
    "nodes": NODES, "edges": EDGES, "papers": PAPERS, "subdomains": SUBDOMAINS, "hierarchy": HIERARCHY, "candidates": CANDIDATES, "suggests": SUGGESTS, "candidate_parents": PARENTS, "classified": CLASSIFIED,
}


def empty_store(spark: SparkSession) -> dict[str, DataFrame]:
    """A store without rows; also what clearing leaves."""
    return {name: spark.createDataFrame([], ddl) for name, ddl in TABLES.items()}


def ask(store: dict[str, DataFrame], sql: str) -> DataFrame:
    """SQL over the tables of a store, which are named in braces; nothing is registered in the session."""
    return store["nodes"].sparkSession.sql(sql, **{name: t for name, t in store.items() if "{" + name + "}" in sql})


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], now: int, keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """``stored`` with the rows of ``new``: of a key the new row counts (of several the last by ``order``).

    Columns that ``new`` lacks, and those of ``keep`` where the stored row has them, stay as they were. ``created_at`` and
    ``updated_at`` tell when a key came and when a row of it was written again.
    """
    rest = [c for c in stored.columns if c not in (*keys, "created_at", "updated_at")]
    given = [c for c in rest if c in new.columns]
    o = F.col(order) if order else F.lit(None)
    old = stored.select(*keys, *rest, "created_at", "updated_at", F.lit(0).alias("_new"), F.lit(None).cast("string").alias("_o"))
    typed = dict(stored.dtypes)
    one = lambda c: (F.col(c) if c in given else F.lit(None)).cast(typed[c]).alias(c)
    add = new.select(*[F.col(k).cast(typed[k]).alias(k) for k in keys], *map(one, rest), F.lit(now).cast("bigint").alias("created_at"), F.lit(None).cast("bigint").alias("updated_at"), F.lit(1).alias("_new"), F.lpad(o.cast("string"), 20, "0").alias("_o"))
    both = old.union(add)
    row = lambda c, first: (F.min_by if first else F.max_by)(F.struct(c), F.struct("_new", F.coalesce("_o", F.lit(""))))[c]
    stored_only = lambda c: F.max(F.when(F.col("_new") == 0, F.col(c)))
    value = lambda c: row(c, True) if c in keep else row(c, False) if c in given else stored_only(c)
    stale = F.max(F.when(F.col("_new") == 0, F.col("updated_at")))
    again = F.when((F.max("_new") == 1) & (F.count("*") > 1), F.lit(now).cast("bigint")).otherwise(stale)
    return both.groupBy(*keys).agg(*[value(c).alias(c) for c in rest], F.min("created_at").alias("created_at"), again.alias("updated_at")).select(*stored.columns)


# ---- claims


def gate(claims: DataFrame) -> DataFrame:
    """Validated claims that are no loop by id (both set and equal) or by name (in any case)."""
    same_id = (F.coalesce("subject_id", F.lit("")) != "") & F.coalesce(F.col("subject_id") == F.col("object_id"), F.lit(False))
    return claims.filter((F.col("status") == "validated") & ~same_id & (X.strip(F.lower("subject")) != X.strip(F.lower("object"))))


def routed(claims: DataFrame) -> DataFrame:
    """Gated claims with their route, edge type and the ids of their ends (the name where there is no id)."""
    end = lambda e: F.coalesce(F.nullif(F.col(f"{e}_id"), F.lit("")), F.col(e))
    c = gate(claims).withColumn("route", G.claim_route(F.col("claim_type"), F.col("relation"), F.col("subject"), F.col("object")))
    kind = F.when(F.col("route") == "ontology_subclass", "SUBCLASS_OF").when(F.col("route") == "ontology_type", "TYPE").otherwise(X.sanitize_relation_type(F.col("relation")))
    return c.withColumn("rel_type", kind).withColumn("src", end("subject")).withColumn("dst", end("object"))


def claim_nodes(claims: DataFrame) -> DataFrame:
    """(id, name, is_concept, ord) of both ends; the subject of a type statement is no concept by it."""
    concept = F.when(F.col("route") == "instance", F.lit(None).cast("boolean")).otherwise(F.lit(True))
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.col("subject").alias("name"), F.when(F.col("route") != "ontology_type", concept).alias("is_concept")),
        F.struct(F.col("dst").alias("id"), F.col("object").alias("name"), concept.alias("is_concept")),
    )
    return routed(claims).select(F.inline(ends), F.col("claim_ord").alias("ord"))


def merge_nodes(stored: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """One row an id; the first name stays, a node that ever was a concept is one, and its labels say so."""
    old = stored.select("id", "name", "is_concept", "created_at", "updated_at", F.lit(-1).cast("bigint").alias("ord"))
    both = old.union(new.select("id", "name", "is_concept", F.lit(now).cast("bigint"), F.lit(None).cast("bigint"), F.col("ord").cast("bigint")))
    t = both.groupBy("id").agg(
        F.min_by("name", F.struct("ord", "name")).alias("name"), F.max("is_concept").alias("is_concept"), F.min("created_at").alias("created_at"),
        F.when((F.max("ord") >= 0) & (F.count("*") > 1), F.lit(now).cast("bigint")).otherwise(F.max("updated_at")).alias("updated_at"),
    )
    labels = F.when(F.col("is_concept"), F.array(F.lit("Entity"), F.lit("Concept"))).otherwise(F.array(F.lit("Entity")))
    return t.select("id", "name", labels.alias("labels"), "is_concept", "created_at", "updated_at")


def claim_edges(claims: DataFrame, version: int) -> DataFrame:
    """An edge a claim, each with an id made of the whole claim, so that writing a claim again adds nothing."""
    ontology = F.when(F.col("route") != "instance", F.lit(True))
    key = F.sha2(F.concat_ws("\u0001", "src", "rel_type", "dst", F.col("claim_ord").cast("string"), "source_paper_id", "relation", "evidence"), 256)
    return routed(claims).select(key.alias("edge_id"), "src", "dst", "rel_type", F.lit(version).cast("bigint").alias("version"), F.col("source_paper_id").alias("source_paper"), "evidence",
                                 F.col("relation").alias("relation_original"), ontology.alias("is_ontology"), F.lit(version).cast("bigint").alias("created_at"))


def append_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """A multigraph: only the same edge_id is the same edge, and the stored one stays."""
    rest = [c for c in stored.columns if c != "edge_id"]
    both = stored.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    return both.groupBy("edge_id").agg(F.min_by(F.struct(*rest), "_n").alias("r")).select("edge_id", *[f"r.{c}" for c in rest])


def write_claims(store: dict[str, DataFrame], claims: DataFrame, now: int) -> dict[str, DataFrame]:
    """The store with the nodes and edges of the claims that may be written."""
    return store | {"nodes": merge_nodes(store["nodes"], claim_nodes(claims), now), "edges": append_edges(store["edges"], claim_edges(claims, now))}


def claim_ids(claims: DataFrame) -> DataFrame:
    """The ids that a write reports: paper_subject_object, not unique by relation."""
    return routed(claims).select("claim_ord", F.concat_ws("_", "source_paper_id", "src", "dst").alias("claim_id"))


# ---- reads and upkeep


def hierarchy(nodes: DataFrame, edges: DataFrame, root: str | None = None, limit: int = 100) -> DataFrame:
    """(child, parent) names along SUBCLASS_OF edges; of one parent, or the first ``limit`` in order."""
    e = edges.filter("rel_type = 'SUBCLASS_OF'").select("src", "dst").distinct()
    t = e.join(nodes.select(F.col("id").alias("src"), F.col("name").alias("child")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("name").alias("parent")), "dst").select("child", "parent")
    return t.filter(F.col("parent") == root) if root is not None else t.orderBy("child", "parent").limit(limit)


def instances_of(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("TYPE",)) -> DataFrame:
    """(concept, instance) by name of the edges of the given types; that an end is a concept is not asked."""
    e = edges.filter(F.col("rel_type").isin(*kinds)).select("src", "dst")
    return e.join(nodes.select(F.col("id").alias("dst"), F.col("name").alias("concept")), "dst").join(nodes.select(F.col("id").alias("src"), F.col("name").alias("instance")), "src").select("concept", "instance")


def ontology_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, rel_type, object) by name of edges that are flagged, of a hierarchy type, or between two concepts."""
    flag = F.coalesce("is_concept", F.lit(False))
    t = edges.join(nodes.select(F.col("id").alias("src"), F.col("name").alias("subject"), flag.alias("_a")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("name").alias("object"), flag.alias("_b")), "dst")
    return t.filter(F.coalesce("is_ontology", F.lit(False)) | F.col("rel_type").isin("SUBCLASS_OF", "TYPE") | (F.col("_a") & F.col("_b"))).select("subject", "rel_type", "object")


def concepts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that are flagged or labelled as concepts, or stand at an end of a SUBCLASS_OF edge."""
    ends = G.endpoints(edges.filter("rel_type = 'SUBCLASS_OF'")).withColumn("_end", F.lit(True))
    t = nodes.join(ends, "id", "left")
    return t.filter(F.coalesce("is_concept", F.lit(False)) | F.array_contains("labels", "Concept") | F.col("_end").isNotNull()).select("id", "name")


def collected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that garbage collection leaves: isolated ones go, but concepts stay (an unset flag is no concept)."""
    return nodes.join(G.isolated(nodes, edges, keep_concepts=True).select("id"), "id", "left_anti")


def merge_entities(nodes: DataFrame, edges: DataFrame, same: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after each ``secondary`` became its ``primary`` (both ids).

    A pair is refused if an end is no node or only one of the two is a concept. Edges between the two vanish; an edge of a secondary moves with
    all its attributes unless the primary has one of that type to that node already; of several that would move to the same place the one
    with the smallest edge_id does. The secondary nodes go. A primary is meant to be no secondary of another pair.
    """
    flag = F.coalesce("is_concept", F.lit(False))
    side = lambda name: nodes.select(F.col("id").alias(name), flag.alias(f"_{name}"))
    ok = same.select("primary", "secondary").distinct().join(side("primary"), "primary").join(side("secondary"), "secondary")
    ok = ok.filter("_primary = _secondary and primary != secondary").groupBy("secondary").agg(F.min("primary").alias("primary"))
    t = edges.withColumn("_moved", F.lit(False))
    for end in ("src", "dst"):
        t = t.join(ok.select(F.col("secondary").alias(end), F.col("primary").alias("_p")), end, "left")
        t = t.withColumn("_moved", F.col("_moved") | F.col("_p").isNotNull()).withColumn(end, F.coalesce("_p", end)).drop("_p")
    stay = t.filter("not _moved")
    rest = [c for c in edges.columns if c not in ("src", "dst", "rel_type")]
    moved = t.filter("_moved and src != dst").groupBy("src", "rel_type", "dst").agg(F.min_by(F.struct(*rest), "edge_id").alias("r")).select("src", "rel_type", "dst", *[f"r.{c}" for c in rest])
    moved = moved.join(stay.select("src", "rel_type", "dst").distinct(), ["src", "rel_type", "dst"], "left_anti")
    return nodes.join(ok.select(F.col("secondary").alias("id")), "id", "left_anti"), stay.select(*edges.columns).unionByName(moved.select(*edges.columns))


# ---- taxonomy


def name_key(x: Column) -> Column:
    """the key of a subdomain."""
    return X.normalize_label(F.coalesce(x, F.lit("")), keep_underscore=True)


def ensure_root(store: dict[str, DataFrame], root: str, now: int) -> dict[str, DataFrame]:
    """The root, confirmed, in version 1; a blank name changes nothing."""
    spark = store["subdomains"].sparkSession
    row = spark.createDataFrame([(root, True, "confirmed", 1)], "name STRING, is_root BOOLEAN, status STRING, taxonomy_version INT").withColumn("normalized_name", name_key(F.col("name"))).filter("normalized_name != ''")
    return store | {"subdomains": upsert(store["subdomains"], row, ["normalized_name"], now)}


def write_papers(store: dict[str, DataFrame], papers: DataFrame, now: int) -> dict[str, DataFrame]:
    """Papers by id, all columns overwritten; texts are trimmed."""
    texts = ("subdomain", "parent_domain", "subdomain_reason", "subdomain_status", "batch_id", "abstract")
    p = papers.withColumns({c: X.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in texts if c in papers.columns})
    return store | {"papers": upsert(store["papers"], p, ["id"], now, order="ord" if "ord" in papers.columns else None)}


def write_hierarchy(store: dict[str, DataFrame], relations: DataFrame, now: int, source: str = "llm") -> dict[str, DataFrame]:
    """Subclass relations (subject, relation, object) as confirmed subdomains and edges; loops, blanks and other relations go."""
    r = relations.select(name_key(F.col("subject")).alias("child"), name_key(F.col("relation")).alias("r"), name_key(F.col("object")).alias("parent"))
    r = r.filter("child != '' and parent != '' and r = 'subclass_of' and child != parent").select("child", "parent").distinct()
    ends = r.select(F.explode(F.array("child", "parent")).alias("normalized_name")).distinct().select("normalized_name", F.col("normalized_name").alias("name"), F.lit("confirmed").alias("status"))
    return store | {"subdomains": upsert(store["subdomains"], ends, ["normalized_name"], now), "hierarchy": upsert(store["hierarchy"], r.withColumn("source", F.lit(source)), ["child", "parent"], now)}


_CANDIDATE = ["normalized_name", "source_batch_id", "source_taxonomy_version"]


def write_candidates(store: dict[str, DataFrame], assignments: DataFrame, now: int, source: str = "llm", root: str = "biomedicine") -> dict[str, DataFrame]:
    """Proposals by (name, batch, version), who suggests them, and the parent where it is a subdomain already; the last proposal counts."""
    a = assignments.select(
        "paper_id", "title", name_key(F.col("subdomain")).alias("normalized_name"), F.coalesce("batch_id", F.lit("")).alias("source_batch_id"), F.col("taxonomy_version").alias("source_taxonomy_version"),
        name_key(F.coalesce(F.nullif("parent_domain", F.lit("")), F.lit(root))).alias("suggested_parent"), "confidence", "reason", "ord",
    )
    c = a.withColumn("name", F.col("normalized_name")).withColumn("status", F.lit("candidate"))
    p = a.withColumn("parent", F.col("suggested_parent")).join(store["subdomains"].select(F.col("normalized_name").alias("parent")), "parent", "left_semi")
    return store | {
        "papers": upsert(store["papers"], a.select(F.col("paper_id").alias("id"), "title", "ord"), ["id"], now, order="ord"),
        "candidates": upsert(store["candidates"], c, _CANDIDATE, now, order="ord"),
        "suggests": upsert(store["suggests"], a.withColumn("source", F.lit(source)), ["paper_id", *_CANDIDATE], now, order="ord"),
        "candidate_parents": upsert(store["candidate_parents"], p.withColumn("source", F.lit(source)), [*_CANDIDATE, "parent"], now),
    }


def write_assignments(store: dict[str, DataFrame], assignments: DataFrame, now: int, source: str = "llm") -> dict[str, DataFrame]:
    """Assignments (paper_id, title, subdomain, parent_domain, reason, confidence, status, is_new_subdomain, batch_id, taxonomy_version, new_relations, ord).

    Candidates and new subdomains are proposals (T04) and change nothing that is confirmed. The others confirm their subdomain, classify
    the paper under it and write their relations (T03). A batch is one step: proposals see the subdomains that it confirms.
    """
    new = (F.col("status") == "candidate") | F.coalesce("is_new_subdomain", F.lit(False))
    a = assignments.withColumn("_new", F.coalesce(new, F.lit(False)))
    p = a.select(
        F.col("paper_id").alias("id"), "title", *[F.when(F.col("_new"), F.col(c)).otherwise(name_key(F.col(c))).alias(c) for c in ("subdomain", "parent_domain")], F.col("reason").alias("subdomain_reason"),
        F.col("confidence").alias("subdomain_confidence"), F.col("status").alias("subdomain_status"), "batch_id", "taxonomy_version", "ord",
    )
    store = write_papers(store, p, now)
    sure = a.filter("not _new").withColumn("subdomain", name_key(F.col("subdomain")))
    s = sure.select(F.col("subdomain").alias("normalized_name"), F.col("subdomain").alias("name"), F.lit("confirmed").alias("status"), "taxonomy_version", "ord")
    store = store | {
        "subdomains": upsert(store["subdomains"], s, ["normalized_name"], now, order="ord"),
        "classified": upsert(store["classified"], sure.withColumn("source", F.lit(source)), ["paper_id", "subdomain"], now, order="ord"),
    }
    store = write_hierarchy(store, sure.select(F.inline("new_relations")), now, source)
    return write_candidates(store, a.filter("_new"), now, source)


def confirmed(store: dict[str, DataFrame]) -> DataFrame:
    """Every subdomain with its direct parents, null without one; the status is told, not asked."""
    s = store["subdomains"].select("name", "normalized_name", "status", "taxonomy_version")
    up = store["hierarchy"].select(F.col("child").alias("normalized_name"), F.col("parent").alias("parent_normalized_name"))
    names = store["subdomains"].select(F.col("normalized_name").alias("parent_normalized_name"), F.col("name").alias("parent_name"))
    return s.join(up.join(names, "parent_normalized_name"), "normalized_name", "left").select("name", "normalized_name", "status", "taxonomy_version", "parent_name", "parent_normalized_name")


def taxonomy_version(store: dict[str, DataFrame]) -> DataFrame:
    """One row: the largest version of a subdomain, 1 without any."""
    return store["subdomains"].agg(F.coalesce(F.max("taxonomy_version"), F.lit(1)).cast("long").alias("version"))


def candidate_rollup(store: dict[str, DataFrame], batch_id: str | None = None, papers: int = 10) -> DataFrame:
    """Open candidates by name, parent and version: batches, distinct papers, mean confidence over candidate and paper, first papers."""
    group = ["name", "normalized_name", "suggested_parent", "source_taxonomy_version"]
    c = store["candidates"].filter("status = 'candidate'")
    c = c.filter(F.col("source_batch_id") == batch_id) if batch_id else c
    t = c.select(*_CANDIDATE, "name", "suggested_parent", "confidence").join(store["suggests"].select(*_CANDIDATE, "paper_id"), _CANDIDATE, "left")
    out = t.groupBy(*group).agg(F.array_sort(F.collect_set("source_batch_id")).alias("batch_ids"), F.count_distinct("paper_id").alias("paper_count"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    # The first papers are cut in the tasks, so that a candidate of many papers gathers few.
    first = t.filter("paper_id is not null").select(*group, "paper_id").distinct().withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy("paper_id"))).filter(F.col("_k") <= papers)
    first = first.groupBy(*group).agg(F.array_sort(F.collect_list("paper_id")).alias("sample_papers"))
    same = reduce(lambda x, y: x & y, [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group])
    return out.alias("a").join(first.alias("b"), same, "left").select("a.*", "b.sample_papers")


def collected_names(nodes: DataFrame, edges: DataFrame, types: dict[str, tuple[str, str]]) -> DataFrame:
    """For each node the distinct names over edges, sorted and joined by ``; ``. types: column to (rel_type, 'out' or 'in')."""
    parts = []
    for column, (rel_type, way) in types.items():
        own, other = ("src", "dst") if way == "out" else ("dst", "src")
        e = edges.filter(F.col("rel_type") == rel_type).select(F.col(own).alias("id"), F.col(other).alias("_o"))
        e = e.join(nodes.select(F.col("id").alias("_o"), F.col("name").alias("_name")), "_o")
        parts.append(e.select("id", F.lit(column).alias("_c"), "_name"))
    t = reduce(DataFrame.union, parts).distinct().groupBy("id").pivot("_c", list(types)).agg(F.array_join(F.array_sort(F.collect_list("_name")), "; "))
    return nodes.select("id").join(t, "id", "left").fillna("", subset=list(types))
