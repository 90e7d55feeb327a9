"""Queries of the stored graph and taxonomy: claims and assignments derived from the star schema, written in two batches, and read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import store as S
from .queries import ROUTE_SQL, WITH_CLAIMS, WITH_EDGES, WITH_NODES
from .registry import query, table
from .testmap import claims, edges, nodes, view

# ---- claims

_STATUS = "CASE WHEN claim_ord % 7 = 0 THEN 'rejected' ELSE 'validated' END"
_FIRST, _SECOND = "claim_ord % 2 = 0", "(claim_ord % 2 = 1 OR claim_ord % 10 = 0)"
_WRITTEN = f"""{WITH_CLAIMS}, g AS (SELECT *, {ROUTE_SQL} AS route FROM claims WHERE {_STATUS} = 'validated' AND subject_id <> object_id AND lower(trim(subject)) <> lower(trim(object))),
 ends AS (SELECT subject_id AS id, subject AS name, route IN ('ontology_subclass', 'ontology_property') AS c, claim_ord FROM g UNION ALL SELECT object_id, object, route <> 'instance', claim_ord FROM g),
 b AS (SELECT *, 1 AS batch FROM ends WHERE {_FIRST} UNION ALL SELECT *, 2 FROM ends WHERE {_SECOND})"""


def _claims(spark, d):
    return claims(spark, d).withColumn("status", F.expr(_STATUS)).withColumn("source_paper_id", F.col("paper_id"))


def _written(spark, d):
    c = _claims(spark, d)
    return S.write_claims(S.write_claims(S.empty_store(spark), c.filter(_FIRST), 1000), c.filter(_SECOND), 2000)


@query(f"""WITH {_WRITTEN}, n AS (SELECT id, arg_min(name, (batch, claim_ord, name)) AS name, bool_or(c) AS concept, min(batch) AS first, count_if(batch = 1) AS n1, count_if(batch = 2) AS n2 FROM b GROUP BY id)
SELECT id, name, CASE WHEN concept THEN 'Entity;Concept' ELSE 'Entity' END AS labels, CASE WHEN concept THEN true END AS is_concept, CAST(first * 1000 AS BIGINT) AS created_at,
 CAST(CASE WHEN n2 > 0 AND (n1 > 0 OR n2 > 1) THEN 2000 WHEN n1 > 1 THEN 1000 END AS BIGINT) AS updated_at FROM n""")
def store_nodes(spark, d):
    return _written(spark, d)["nodes"].withColumn("labels", F.array_join("labels", ";"))


@query(f"""WITH {_WRITTEN} SELECT subject_id AS src, object_id AS dst, CASE route WHEN 'ontology_subclass' THEN 'SUBCLASS_OF' WHEN 'ontology_type' THEN 'TYPE' ELSE regexp_replace(replace(relation, ' ', '_'), '[^一-龥a-zA-Z0-9_]', '', 'g') END AS rel_type,
 relation AS relation_original, paper_id AS source_paper, evidence, CASE WHEN route <> 'instance' THEN true END AS is_ontology, CAST(CASE WHEN {_FIRST} THEN 1000 ELSE 2000 END AS BIGINT) AS version FROM g""")
def store_edges(spark, d):
    return _written(spark, d)["edges"].select("src", "dst", "rel_type", "relation_original", "source_paper", "evidence", "is_ontology", "version")


@query(f"WITH {_WRITTEN} SELECT claim_ord, paper_id || '_' || subject_id || '_' || object_id AS claim_id FROM g")
def written_claim_ids(spark, d):
    return S.claim_ids(_claims(spark, d))


@query(f"WITH {_WRITTEN} SELECT CASE route WHEN 'ontology_subclass' THEN 'SUBCLASS_OF' WHEN 'ontology_type' THEN 'TYPE' ELSE 'other' END AS rel_type, count(*) AS n FROM g GROUP BY 1 HAVING count(*) > 3")
def store_sql(spark, d):
    return S.ask(_written(spark, d), "SELECT CASE WHEN rel_type IN ('SUBCLASS_OF', 'TYPE') THEN rel_type ELSE 'other' END AS rel_type, count(*) AS n FROM {edges} GROUP BY 1 HAVING count(*) > 3")


@query("SELECT unnest(['candidate_parents', 'candidates', 'classified', 'edges', 'hierarchy', 'nodes', 'papers', 'subdomains', 'suggests']) AS name, CAST(0 AS BIGINT) AS n")
def store_cleared(spark, d):
    out = None
    for name, t in S.empty_store(spark).items():
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {_WRITTEN}, names AS (SELECT id, arg_min(name, (batch, claim_ord, name)) AS name FROM b GROUP BY id), h AS (SELECT DISTINCT subject_id, object_id FROM g WHERE route = 'ontology_subclass')
SELECT a.name AS child, p.name AS parent FROM h JOIN names a ON a.id = subject_id JOIN names p ON p.id = object_id WHERE p.name = 'Table of (contents ) , index'""")
def hierarchy_of_root(spark, d):
    s = _written(spark, d)
    return S.hierarchy(s["nodes"], s["edges"], "Table of (contents ) , index")


@query(f"""WITH {_WRITTEN}, names AS (SELECT id, arg_min(name, (batch, claim_ord, name)) AS name FROM b GROUP BY id), h AS (SELECT DISTINCT subject_id, object_id FROM g WHERE route = 'ontology_subclass')
SELECT a.name AS child, p.name AS parent FROM h JOIN names a ON a.id = subject_id JOIN names p ON p.id = object_id ORDER BY 1, 2 LIMIT 100""")
def hierarchy_first(spark, d):
    s = _written(spark, d)
    return S.hierarchy(s["nodes"], s["edges"])


@query(f"""WITH {WITH_EDGES}, {WITH_NODES} SELECT a.name AS subject, rel_type, b.name AS object FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id
WHERE coalesce(is_ontology, false) OR rel_type IN ('SUBCLASS_OF', 'TYPE') OR (coalesce(a.is_concept, false) AND coalesce(b.is_concept, false))""")
def ontology_relations(spark, d):
    return S.ontology_relations(nodes(spark, d), edges(spark, d))


@query(f"WITH {_WRITTEN} SELECT id, arg_min(name, (batch, claim_ord, name)) AS name FROM b GROUP BY id HAVING bool_or(c)")
def all_concepts(spark, d):
    s = _written(spark, d)
    return S.concepts(s["nodes"], s["edges"])


@query(f"WITH {_WRITTEN}, names AS (SELECT id, arg_min(name, (batch, claim_ord, name)) AS name FROM b GROUP BY id) SELECT o.name AS concept, s.name AS instance FROM g JOIN names s ON s.id = subject_id JOIN names o ON o.id = object_id WHERE route = 'ontology_type'")
def instances_by_name(spark, d):
    s = _written(spark, d)
    return S.instances_of(s["nodes"], s["edges"])


@query(f"""WITH {WITH_EDGES}, {WITH_NODES}, e AS (SELECT src AS x FROM edges WHERE rel_type IN ('placed', 'supplied_by') UNION SELECT dst FROM edges WHERE rel_type IN ('placed', 'supplied_by'))
SELECT id, name FROM nodes WHERE coalesce(is_concept, false) OR id IN (SELECT x FROM e)""")
def garbage_collected(spark, d):
    return S.collected(nodes(spark, d), edges(spark, d).filter("rel_type IN ('placed', 'supplied_by')")).select("id", "name")


@query(f"""WITH {WITH_EDGES}, {WITH_NODES} SELECT n.id AS id, CASE WHEN x IS NULL THEN 'isolated' ELSE 'connected' END AS state FROM nodes n LEFT JOIN (SELECT src AS x FROM edges UNION SELECT dst FROM edges) ON id = x""")
def isolation_of_nodes(spark, d):
    n = nodes(spark, d)
    alone = G.isolated(n, edges(spark, d)).select("id", F.lit("isolated").alias("state"))
    return n.select("id").join(alone, "id", "left").select("id", F.coalesce("state", F.lit("connected")).alias("state"))


_SAME = """SELECT 'P' || min(p_partkey) AS "primary", 'P' || max(p_partkey) AS secondary FROM part GROUP BY p_brand, p_type HAVING count(*) > 1 UNION ALL SELECT 'N' || n_nationkey, 'S' || (n_nationkey + 1) FROM nation UNION ALL SELECT 'N' || n_nationkey, 'gone' FROM nation UNION ALL SELECT 'R0', 'R1' FROM region WHERE r_regionkey = 1"""
_MERGED = f"""{WITH_EDGES}, {WITH_NODES}, same AS ({_SAME}), ok AS (SELECT secondary, min("primary") AS first FROM same JOIN nodes a ON a.id = "primary" JOIN nodes b ON b.id = secondary WHERE coalesce(a.is_concept, false) = coalesce(b.is_concept, false) GROUP BY 1),
 k AS (SELECT sha256(src || rel_type || dst) AS edge_id, * FROM edges), t AS (SELECT edge_id, coalesce(x.first, src) AS src, rel_type, coalesce(y.first, dst) AS dst, is_ontology, x.first IS NOT NULL OR y.first IS NOT NULL AS moved FROM k LEFT JOIN ok x ON src = x.secondary LEFT JOIN ok y ON dst = y.secondary)"""


def _merged(spark, d):
    e = edges(spark, d).withColumn("edge_id", F.sha2(F.concat("src", "rel_type", "dst"), 256))
    return S.merge_entities(nodes(spark, d), e, view(spark, d, _SAME.replace('"primary"', "`primary`")))


@query(f"""WITH {_MERGED}, stay AS (SELECT * FROM t WHERE NOT moved)
SELECT src, rel_type, dst, edge_id, is_ontology FROM stay UNION ALL
SELECT src, rel_type, dst, min(edge_id), arg_min(is_ontology, edge_id) FROM t WHERE moved AND src <> dst AND NOT EXISTS (SELECT 1 FROM stay s WHERE s.src = t.src AND s.rel_type = t.rel_type AND s.dst = t.dst) GROUP BY 1, 2, 3""")
def merge_entities_checked(spark, d):
    return _merged(spark, d)[1].select("src", "rel_type", "dst", "edge_id", "is_ontology")


@query(f"WITH {_MERGED} SELECT id, name FROM nodes WHERE id NOT IN (SELECT secondary FROM ok)")
def merge_entities_nodes(spark, d):
    return _merged(spark, d)[0].select("id", "name")


@query(f"""WITH {WITH_EDGES}, {WITH_NODES}, u AS (SELECT src, dst, rel_type, is_ontology, 'out' AS direction FROM edges UNION ALL SELECT dst, src, rel_type, is_ontology, 'in' FROM edges),
 r AS (SELECT name AS wanted, rel_type, direction, dst AS neighbour, is_ontology, row_number() OVER (PARTITION BY name ORDER BY id, rel_type, direction, dst) AS rank FROM nodes JOIN u ON id = src WHERE is_concept)
SELECT wanted, CAST(rank AS INTEGER) AS rank, CASE WHEN coalesce(is_ontology, false) THEN '[ontology] ' ELSE '[instance] ' END || CASE direction WHEN 'out' THEN '''' || wanted || ''' --' || rel_type || '--> ''' || neighbour || '''' ELSE '''' || neighbour || ''' --' || rel_type || '--> ''' || wanted || '''' END
 || CASE WHEN rel_type = 'located_in' THEN ' (Evidence: ' || left(repeat('seen ' || neighbour || ' ', 30), 100) || '...)' ELSE '' END AS line FROM r WHERE rank <= 10""")
def entity_context_lines(spark, d):
    n = nodes(spark, d)
    c = G.entity_context(n, edges(spark, d), n.filter("is_concept").select(F.col("name").alias("wanted")), 10, ("is_ontology",))
    return G.context_text(c.withColumn("evidence", F.when(F.col("rel_type") == "located_in", F.expr("repeat('seen ' || neighbour || ' ', 30)"))))


_HOPS = "SELECT 'S' || s_suppkey AS a, 'N' || n_nationkey AS b, 'R' || n_regionkey AS c, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@query(f"SELECT n_name AS section, CAST(row_number() OVER (PARTITION BY n_name ORDER BY a) AS INTEGER) AS path_rank, 'Path: ' || a || ' --[in]--> ' || b || ' --[of]--> ' || c AS description, s_name || ' | ' || n_name AS context FROM ({_HOPS})")
def path_contexts(spark, d):
    hop = lambda *xs: F.struct(*[x.alias(n) for x, n in zip(xs, ("from", "relation", "to", "context"))])
    t = view(spark, d, _HOPS).withColumn("hops", F.array(hop(F.col("a"), F.lit("in"), F.col("b"), F.col("s_name")), hop(F.col("b"), F.lit("of"), F.col("c"), F.col("n_name"))))
    return G.path_text(t.withColumn("path_rank", F.expr("row_number() OVER (PARTITION BY n_name ORDER BY a)")).withColumnRenamed("n_name", "section"))


@query(f"""WITH {WITH_EDGES}, {WITH_NODES}, c AS (SELECT DISTINCT src AS id, n.name AS name FROM edges JOIN nodes n ON dst = n.id WHERE rel_type = 'located_in'), p AS (SELECT DISTINCT src AS id, n.name AS name FROM edges JOIN nodes n ON dst = n.id WHERE rel_type = 'subclass_of'),
 k AS (SELECT DISTINCT dst AS id, n.name AS name FROM edges JOIN nodes n ON src = n.id WHERE rel_type = 'subclass_of')
SELECT id, coalesce((SELECT string_agg(name, '; ' ORDER BY name) FROM c WHERE c.id = nodes.id), '') AS concepts, coalesce((SELECT string_agg(name, '; ' ORDER BY name) FROM p WHERE p.id = nodes.id), '') AS parents, coalesce((SELECT string_agg(name, '; ' ORDER BY name) FROM k WHERE k.id = nodes.id), '') AS children FROM nodes""")
def names_around_nodes(spark, d):
    return S.collected_names(nodes(spark, d), edges(spark, d), {"concepts": ("located_in", "out"), "parents": ("subclass_of", "out"), "children": ("subclass_of", "in")})


# ---- taxonomy

_KEY = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'), ' .;:,')"
_ASSIGNED = """SELECT 'T' || (p_partkey - p_partkey % 2) AS paper_id, p_name AS title, p_type || CASE WHEN p_size % 4 = 0 THEN ' .' ELSE '' END AS subdomain, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS parent_domain,
 'r' || p_size AS reason, CAST(p_size AS DOUBLE) / 50 AS confidence, CASE WHEN p_size % 3 = 0 THEN 'candidate' ELSE 'confirmed' END AS status, p_size % 7 = 0 AS is_new_subdomain, 'b' || (p_partkey % 3) AS batch_id,
 CAST(p_partkey % 2 + 1 AS INTEGER) AS taxonomy_version, p_type AS s1, CASE p_size % 4 WHEN 0 THEN 'part_of' WHEN 1 THEN ' Subclass_of' ELSE 'subclass_of' END AS r1, CASE WHEN p_size % 11 = 0 THEN p_type ELSE p_brand END AS o1, p_partkey AS ord FROM part"""
_TAX = f"""a AS ({_ASSIGNED}), n AS (SELECT *, {_KEY.format('subdomain')} AS norm, status = 'candidate' OR is_new_subdomain AS fresh FROM a),
 h AS (SELECT DISTINCT {_KEY.format('s1')} AS child, {_KEY.format('o1')} AS parent FROM n WHERE NOT fresh AND {_KEY.format('r1')} = 'subclass_of' AND {_KEY.format('s1')} <> {_KEY.format('o1')}),
 known AS (SELECT 'biomedicine' AS x UNION SELECT norm FROM n WHERE NOT fresh UNION SELECT child FROM h UNION SELECT parent FROM h),
 f AS (SELECT *, CASE WHEN parent_domain = '' THEN 'biomedicine' ELSE {_KEY.format('parent_domain')} END AS up FROM n WHERE fresh)"""


def _taxonomy(spark, d):
    a = view(spark, d, _ASSIGNED).withColumn("new_relations", F.array(F.struct(F.col("s1").alias("subject"), F.col("r1").alias("relation"), F.col("o1").alias("object")))).drop("s1", "r1", "o1")
    return S.write_assignments(S.ensure_root(S.empty_store(spark), "Biomedicine", 1), a, 2)


@query("SELECT 'biomedicine' AS normalized_name, 'Biomedicine .' AS name, 'confirmed' AS status, 1 AS taxonomy_version, true AS is_root, CAST(1 AS BIGINT) AS created_at, CAST(5 AS BIGINT) AS updated_at")
def taxonomy_root(spark, d):
    return S.ensure_root(S.ensure_root(S.ensure_root(S.empty_store(spark), "Biomedicine", 1), " . ", 3), "Biomedicine .", 5)["subdomains"]


@query(f"""WITH {_TAX} SELECT paper_id, norm AS subdomain, 'llm' AS source, arg_max(reason, ord) AS reason, arg_max(confidence, ord) AS confidence, CAST(2 AS BIGINT) AS created_at FROM n WHERE NOT fresh GROUP BY 1, 2""")
def graph_assignments(spark, d):
    return _taxonomy(spark, d)["classified"].drop("updated_at")


@query(f"""WITH {_TAX} SELECT norm AS normalized_name, batch_id AS source_batch_id, taxonomy_version AS source_taxonomy_version, arg_max(up, ord) AS suggested_parent, arg_max(confidence, ord) AS confidence, arg_max(reason, ord) AS reason, 'candidate' AS status FROM f GROUP BY 1, 2, 3""")
def taxonomy_candidates(spark, d):
    return _taxonomy(spark, d)["candidates"].drop("name", "created_at", "updated_at")


@query(f"WITH {_TAX} SELECT DISTINCT norm AS normalized_name, batch_id AS source_batch_id, taxonomy_version AS source_taxonomy_version, up AS parent, 'llm' AS source FROM f WHERE up IN (SELECT x FROM known)")
def candidate_parents(spark, d):
    return _taxonomy(spark, d)["candidate_parents"].drop("created_at", "updated_at")


@query(f"WITH {_TAX} SELECT paper_id, norm AS normalized_name, batch_id AS source_batch_id, taxonomy_version AS source_taxonomy_version, arg_max(reason, ord) AS reason, arg_max(confidence, ord) AS confidence FROM f GROUP BY 1, 2, 3, 4")
def candidate_suggestions(spark, d):
    return _taxonomy(spark, d)["suggests"].select("paper_id", "normalized_name", "source_batch_id", "source_taxonomy_version", "reason", "confidence")


@query(f"WITH {_TAX} SELECT child, parent, 'llm' AS source FROM h")
def taxonomy_hierarchy(spark, d):
    return _taxonomy(spark, d)["hierarchy"].select("child", "parent", "source")


@query(f"""WITH {_TAX}, last AS (SELECT norm, arg_max(taxonomy_version, ord) AS v FROM n WHERE NOT fresh GROUP BY 1)
SELECT x AS normalized_name, CASE x WHEN 'biomedicine' THEN 'Biomedicine' ELSE x END AS name, 'confirmed' AS status, CAST(CASE x WHEN 'biomedicine' THEN 1 ELSE v END AS INTEGER) AS taxonomy_version, CASE x WHEN 'biomedicine' THEN true END AS is_root FROM known LEFT JOIN last ON norm = x""")
def taxonomy_subdomains(spark, d):
    return _taxonomy(spark, d)["subdomains"].drop("created_at", "updated_at")


@query(f"""WITH {_TAX}, w AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ord DESC) AS k, count(*) OVER (PARTITION BY paper_id) AS m FROM n),
 t AS (SELECT paper_id, arg_max(title, ord) AS title FROM f GROUP BY 1)
SELECT paper_id AS id, coalesce(t.title, w.title) AS title, CASE WHEN fresh THEN trim(subdomain) ELSE norm END AS subdomain, CASE WHEN fresh THEN parent_domain ELSE {_KEY.format('parent_domain')} END AS parent_domain,
 reason AS subdomain_reason, confidence AS subdomain_confidence, status AS subdomain_status, batch_id, taxonomy_version FROM w LEFT JOIN t USING (paper_id) WHERE k = 1""")
def taxonomy_papers(spark, d):
    return _taxonomy(spark, d)["papers"].drop("abstract", "keywords", "created_at", "updated_at")


@query(f"WITH {_TAX} SELECT x AS normalized_name, parent AS parent_normalized_name, CASE parent WHEN 'biomedicine' THEN 'Biomedicine' ELSE parent END AS parent_name FROM known LEFT JOIN h ON child = x")
def confirmed_with_parent(spark, d):
    return S.confirmed(_taxonomy(spark, d)).select("normalized_name", "parent_normalized_name", "parent_name")


@query(f"WITH {_TAX}, last AS (SELECT arg_max(taxonomy_version, ord) AS v FROM n WHERE NOT fresh GROUP BY norm) SELECT CAST(coalesce(max(v), 1) AS BIGINT) AS version FROM last")
def taxonomy_version(spark, d):
    return S.taxonomy_version(_taxonomy(spark, d))


@query(f"""WITH {_TAX}, c AS (SELECT norm, batch_id, taxonomy_version, arg_max(up, ord) AS up, arg_max(confidence, ord) AS conf FROM f GROUP BY 1, 2, 3), s AS (SELECT DISTINCT paper_id, norm, batch_id, taxonomy_version FROM f),
 j AS (SELECT * FROM c LEFT JOIN s USING (norm, batch_id, taxonomy_version))
SELECT norm AS name, up AS suggested_parent, taxonomy_version AS source_taxonomy_version, string_agg(DISTINCT batch_id, ';' ORDER BY batch_id) AS batch_ids, count(DISTINCT paper_id) AS paper_count, round(avg(conf), 4) AS avg_confidence,
 array_to_string(list_sort(list_distinct(list(paper_id)))[1:10], ';') AS sample_papers FROM j GROUP BY 1, 2, 3""")
def candidate_rollup(spark, d):
    t = S.candidate_rollup(_taxonomy(spark, d)).drop("normalized_name")
    return t.withColumn("batch_ids", F.array_join("batch_ids", ";")).withColumn("sample_papers", F.array_join("sample_papers", ";"))
