"""The registered queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chunking as K
from ..functions import cleaning as L
from ..functions import predicates as R
from ..functions import text as X
from ..operators import claims as C
from ..operators import graph as G
from ..operators import grounding as N
from ..operators import matching as M
from ..operators import reports as P
from ..operators import taxonomy as T
from ..operators import vectors as V
from ..sources import turtle as U
from ..sources import writers as W
from ..sources.papers import keywords
from ..streaming import ingest as S
from .registry import ORACLES, QUERIES, query, quoted as _quoted, table as _t  # noqa: F401  the two tables are the contract of this module
from .testmap import CLAIMS, EDGES, NODES, claims, edges, nodes, view

WITH_EDGES, WITH_NODES, WITH_CLAIMS = f"edges AS ({EDGES})", f"nodes AS ({NODES})", f"claims AS ({CLAIMS})"


# ---- graph

PATHS_SQL = f"""WITH {WITH_EDGES}, p AS (
 SELECT c_mktsegment AS section, a.src AS n0, a.dst AS n1, b.dst AS n2, c.dst AS n3 FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src JOIN customer ON a.src = 'C' || c_custkey
 WHERE a.rel_type = 'placed' AND b.rel_type = 'contains' AND c.rel_type = 'supplied_by'
), r AS (SELECT DISTINCT section, n0, n1, n2, n3 FROM p)
SELECT section, path_rank, 'Path: ' || n0 || ' --[placed]--> ' || n1 || ' --[contains]--> ' || n2 || ' --[supplied_by]--> ' || n3 AS description
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY section ORDER BY n0, n1, n2, n3) AS INTEGER) AS path_rank FROM r) WHERE path_rank <= 10"""


@query(PATHS_SQL)
def three_hop_paths(spark, d):
    seg = _t(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("n0"), F.col("c_mktsegment").alias("section"))
    o = _t(spark, d, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("n0"), F.concat(F.lit("O"), "o_orderkey").alias("n1"))
    li = _t(spark, d, "lineitem")
    second = li.select(F.concat(F.lit("O"), "l_orderkey").alias("n1"), F.concat(F.lit("P"), "l_partkey").alias("n2"))
    third = li.select(F.concat(F.lit("P"), "l_partkey").alias("n2"), F.concat(F.lit("S"), "l_suppkey").alias("n3")).distinct()
    p = G.three_hop_paths(o.join(seg, "n0"), second, third, 10)
    text = F.concat(F.lit("Path: "), "n0", F.lit(" --[placed]--> "), "n1", F.lit(" --[contains]--> "), "n2", F.lit(" --[supplied_by]--> "), "n3")
    return p.select("section", "path_rank", text.alias("description"))


@query(f"""WITH {WITH_EDGES}, {WITH_NODES} SELECT * FROM
 (SELECT count(*) AS nodes, count_if(is_concept) AS concept_nodes, count_if(NOT coalesce(is_concept, false)) AS entity_nodes FROM nodes),
 (SELECT count(*) AS relationships, count_if(is_ontology) AS ontology_relations, count_if(NOT coalesce(is_ontology, false)) AS instance_relations FROM edges)""")
def graph_stats(spark, d):
    return G.graph_stats(nodes(spark, d), edges(spark, d))


@query(f"WITH {WITH_NODES} SELECT lower(name) AS key, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM nodes GROUP BY 1 HAVING count(*) > 1")
def duplicate_entities(spark, d):
    return G.duplicates(nodes(spark, d))


@query(f"""WITH {WITH_EDGES}, {WITH_NODES}, w AS (SELECT name AS wanted FROM nodes WHERE is_concept UNION SELECT 'S' || s_suppkey FROM supplier),
 found AS (SELECT DISTINCT wanted, id FROM w JOIN nodes ON wanted = name OR wanted = id),
 u AS (SELECT src, dst, rel_type, 'out' AS direction FROM edges UNION ALL SELECT dst, src, rel_type, 'in' FROM edges)
SELECT * FROM (SELECT wanted, id, rel_type, direction, dst AS neighbour, CAST(row_number() OVER (PARTITION BY wanted ORDER BY id, rel_type NULLS FIRST, direction NULLS FIRST, dst NULLS FIRST) AS INTEGER) AS rank
 FROM found LEFT JOIN u ON id = src) WHERE rank <= 10""")
def entity_context_topn(spark, d):
    n = nodes(spark, d)
    wanted = n.filter("is_concept").select(F.col("name").alias("wanted")).union(_t(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey"))).distinct()
    return G.entity_context(n, edges(spark, d).drop("is_ontology"), wanted, 10)


@query(f"""WITH RECURSIVE {WITH_EDGES}, h AS (SELECT src, dst FROM edges WHERE rel_type IN ('subclass_of', 'located_in')),
 c AS (SELECT src AS child, dst AS ancestor, 1 AS distance FROM h UNION SELECT child, dst, distance + 1 FROM c JOIN h ON ancestor = src WHERE distance < 3)
SELECT child, ancestor, min(distance) AS distance FROM c GROUP BY 1, 2""")
def hierarchy_closure(spark, d):
    return G.closure(edges(spark, d).filter("rel_type IN ('subclass_of', 'located_in')"), 3)


@query(f"WITH {WITH_EDGES}, {WITH_NODES}, e AS (SELECT * FROM edges WHERE rel_type IN ('placed', 'subclass_of')) SELECT id, name FROM nodes WHERE NOT coalesce(is_concept, false) AND NOT EXISTS (SELECT 1 FROM e WHERE src = id OR dst = id)")
def isolated_nodes(spark, d):
    return G.isolated(nodes(spark, d), edges(spark, d).filter("rel_type IN ('placed', 'subclass_of')"), keep_concepts=True).select("id", "name")


@query(f"""WITH {WITH_EDGES}, m AS (SELECT 'P' || p_partkey AS s, 'P' || min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS p FROM part)
SELECT DISTINCT coalesce(a.p, src) AS src, rel_type, coalesce(b.p, dst) AS dst FROM edges LEFT JOIN m a ON src = a.s LEFT JOIN m b ON dst = b.s WHERE coalesce(a.p, src) <> coalesce(b.p, dst)""")
def merge_entities_rewire(spark, d):
    part = _t(spark, d, "part")
    first = part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("first"))
    same = part.join(first, ["p_brand", "p_type"]).filter("p_partkey != first").select(F.concat(F.lit("P"), "p_partkey").alias("secondary"), F.concat(F.lit("P"), "first").alias("primary"))
    return G.merge_entities(edges(spark, d), same)


@query(f"WITH {WITH_EDGES}, {WITH_NODES}, e AS (SELECT src AS x FROM edges WHERE rel_type = 'supplied_by' UNION SELECT dst FROM edges WHERE rel_type = 'supplied_by') SELECT id, name, x IS NOT NULL OR coalesce(is_concept, false) AS is_concept FROM nodes LEFT JOIN e ON id = x")
def label_repair(spark, d):
    return G.repair_labels(nodes(spark, d), edges(spark, d), ("supplied_by",)).select("id", "name", "is_concept")


@query(f"WITH {WITH_EDGES} SELECT rel_type, count(*) AS n, count_if(is_ontology IS NULL) AS n_unset FROM edges GROUP BY 1")
def relation_histogram(spark, d):
    return edges(spark, d).groupBy("rel_type").agg(F.count("*").alias("n"), F.count_if(F.col("is_ontology").isNull()).alias("n_unset"))


# ---- claims

ROUTE_SQL = f"CASE WHEN lower(trim(relation)) IN {_quoted(G.SUBCLASS)} THEN 'ontology_subclass' WHEN lower(trim(relation)) IN {_quoted(G.TYPE)} THEN 'ontology_type' WHEN claim_type = 'ontology' OR lower(trim(relation)) IN {_quoted(G.PROPERTY)} THEN 'ontology_property' ELSE 'instance' END"


@query(f"WITH {WITH_CLAIMS} SELECT {ROUTE_SQL} AS route, claim_type, count(*) AS n FROM claims GROUP BY 1, 2")
def claim_routing(spark, d):
    c = claims(spark, d)
    return c.groupBy(G.claim_route(F.col("claim_type"), F.col("relation"), F.col("subject"), F.col("object")).alias("route"), "claim_type").agg(F.count("*").alias("n"))


KEY_SQL = r"lower(trim(regexp_replace(regexp_replace(trim({0}), '\s+', ' ', 'g'), '{1}', '\1', 'g'), ' .;:,'))"
SIGNS, TIGHT = r"\s*([,;:()\\\[]/-\])\s*", r"\s*([,;:()\[\]/\-])\s*"


def _first_by_key(signs: str) -> str:
    keys = [KEY_SQL.format(c, signs) for c in ("subject", "object")]
    return f"WITH {WITH_CLAIMS}, k AS (SELECT *, row_number() OVER (PARTITION BY paper_id, {keys[0]}, relation, {keys[1]} ORDER BY claim_ord) AS rn FROM claims) SELECT claim_ord, paper_id, subject, relation, object FROM k WHERE rn = 1"


def _keyed(spark, d, tighten):
    c = claims(spark, d)
    key = [X.normalize_entity(F.col(e), tighten) for e in ("subject", "object")]
    return C.first_of(c, F.col("paper_id"), key[0], F.col("relation"), key[1]).select("claim_ord", "paper_id", "subject", "relation", "object")


@query(_first_by_key(SIGNS))
def entity_key_dedup(spark, d):
    return _keyed(spark, d, False)


@query(_first_by_key(TIGHT))
def entity_key_dedup_tight(spark, d):
    return _keyed(spark, d, True)


_SPACED = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' , ( x ) ' WHEN 1 THEN 'a  ,/-] ' || p_name WHEN 2 THEN p_name || ' [ y ] - z.' ELSE p_type || ':;' END AS name FROM part"


@query(f"SELECT p_partkey, {KEY_SQL.format('name', SIGNS)} AS key, {KEY_SQL.format('name', TIGHT)} AS tight FROM ({_SPACED})")
def entity_keys(spark, d):
    return view(spark, d, _SPACED).select("p_partkey", X.normalize_entity(F.col("name")).alias("key"), X.normalize_entity(F.col("name"), True).alias("tight"))


@query(f"WITH {WITH_CLAIMS} SELECT md5(concat_ws('|', subject, relation, object)) AS fingerprint, min(claim_ord) AS claim_ord, count(*) AS n FROM claims GROUP BY 1")
def fingerprint_dedup(spark, d):
    c = claims(spark, d)
    return c.groupBy(X.fingerprint(F.col("subject"), F.col("relation"), F.col("object")).alias("fingerprint")).agg(F.min("claim_ord").alias("claim_ord"), F.count("*").alias("n"))


@query(f"""WITH {WITH_CLAIMS}, c AS (SELECT *, trim(subject) AS s, trim(object) AS o, lower(section_title) AS t FROM claims), r AS (
SELECT CASE WHEN s = o THEN 'self_loop' WHEN length(evidence) < 10 THEN 'short_evidence' WHEN s LIKE 'Figure%' OR o LIKE 'Table %' THEN 'artifact' WHEN relation NOT IN {_quoted([*X.ONTOLOGY_RELATIONS, *X.INSTANCE_RELATIONS])} THEN 'relation_set'
 WHEN s = '---' THEN 'symbols' WHEN s = 'This Study' THEN 'meta_entity' WHEN evidence LIKE 'In this study%' THEN 'meta_evidence' WHEN t = 'introduction' AND claim_type = 'instance' THEN 'section'
 WHEN t LIKE '%methods%' AND relation NOT IN {_quoted(C.METHOD_RELATIONS)} THEN 'section' END AS reason FROM c) SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def claim_filter_reasons(spark, d):
    return C.with_drop_reason(claims(spark, d)).groupBy(F.col("drop_reason").alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {WITH_CLAIMS} SELECT CASE WHEN subject_id = object_id THEN 'self_loop' WHEN lower(subject) = lower(object) THEN 'same_entity' WHEN trim(subject) = '' OR regexp_matches(subject, '^({'|'.join(C.NAME_BLACKLIST)})|({'|'.join(C.NAME_BLACKLIST)})$') THEN 'invalid_subject'
 WHEN trim(object) = '' OR regexp_matches(object, '^({'|'.join(C.NAME_BLACKLIST)})|({'|'.join(C.NAME_BLACKLIST)})$') THEN 'invalid_object' END AS validation_type, count(*) AS n FROM claims GROUP BY 1""")
def structural_validation(spark, d):
    return claims(spark, d).groupBy(C.structural_verdict().alias("validation_type")).agg(F.count("*").alias("n"))


@query(f"""WITH {WITH_CLAIMS}, s AS (SELECT *, (CASE claim_type WHEN 'ontology' THEN 6 ELSE 3 END + CASE WHEN relation IN {_quoted(X.HIGH_RELATIONS)} THEN 4 WHEN relation IN {_quoted(X.MEDIUM_RELATIONS)} THEN 2 ELSE 0 END
 + CASE WHEN lower(section_title) IN ('results', 'discussion') THEN 2 WHEN lower(section_title) = 'introduction' THEN -2 WHEN lower(section_title) LIKE '%methods%' THEN -3 ELSE 0 END
 + CASE WHEN len(string_split_regex(trim(subject), '\\s+')) <= 4 THEN 1 ELSE 0 END + CASE WHEN len(string_split_regex(trim(object), '\\s+')) <= 5 THEN 1 ELSE 0 END) AS priority FROM claims),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY priority DESC, claim_ord) AS INTEGER) AS rank FROM s) SELECT paper_id, rank, claim_ord, priority FROM r WHERE rank <= 2""")
def claim_priority_cap(spark, d):
    return C.cap(claims(spark, d), 2, "paper_id").select("paper_id", "rank", "claim_ord", "priority")


@query(f"WITH {WITH_CLAIMS}, b AS (SELECT paper_id, (row_number() OVER (PARTITION BY paper_id ORDER BY claim_ord) - 1) // 3 AS batch, claim_ord FROM claims) SELECT paper_id, CAST(batch AS BIGINT) AS batch, count(*) AS n, min(claim_ord) AS first_ord FROM b GROUP BY 1, 2")
def validation_batches(spark, d):
    w = Window.partitionBy("paper_id").orderBy("claim_ord")
    b = claims(spark, d).select("paper_id", "claim_ord", F.floor((F.row_number().over(w) - 1) / 3).alias("batch"))
    return b.groupBy("paper_id", "batch").agg(F.count("*").alias("n"), F.min("claim_ord").alias("first_ord"))


# ---- vectors

_DIST = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2])))"
_RANKED = f"SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank, d FROM (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, {_DIST} AS d FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0)"


# ---- taxonomy





# ---- reports

@query(f"WITH {WITH_CLAIMS}, r AS (SELECT subject, relation, object, evidence, claim_ord, row_number() OVER (PARTITION BY subject, relation, object ORDER BY length(evidence) DESC, claim_ord) AS rn FROM claims) SELECT subject, relation, object, evidence FROM r WHERE rn = 1")
def best_context(spark, d):
    c = claims(spark, d)
    return c.groupBy("subject", "relation", "object").agg(F.min_by("evidence", F.struct(-F.length("evidence"), "claim_ord")).alias("evidence"))


@query("SELECT source, n_gold, n_pred, n_hit, round(CASE WHEN n_pred = 0 THEN 0 ELSE n_hit / n_pred END, 6) AS precision, round(CASE WHEN n_gold = 0 THEN 0 ELSE n_hit / n_gold END, 6) AS recall FROM (SELECT source, count_if(quality = 1) AS n_gold, count_if(n_chars > 800) AS n_pred, count_if(quality = 1 AND n_chars > 800) AS n_hit FROM documents JOIN labels USING (doc_id) GROUP BY 1)")
def precision_recall(spark, d):
    t = _t(spark, d, "documents").select("doc_id", "source", "n_chars").join(_t(spark, d, "labels"), "doc_id")
    gold, pred = F.col("quality") == 1, F.col("n_chars") > 800
    t = t.groupBy("source").agg(F.count_if(gold).alias("n_gold"), F.count_if(pred).alias("n_pred"), F.count_if(gold & pred).alias("n_hit"))
    return t.withColumn("precision", F.round(X.ratio(F.col("n_hit"), F.col("n_pred")), 6)).withColumn("recall", F.round(X.ratio(F.col("n_hit"), F.col("n_gold")), 6))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n_lines, count_if(line = '') AS n_blank, count_if(suffix(line, '.')) AS n_ended FROM l GROUP BY 1")
def line_counts(spark, d):
    lines = F.split("text", "\n")
    return _t(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda x: x == "")).cast("long").alias("n_blank"), F.size(F.filter(lines, lambda x: x.endswith("."))).cast("long").alias("n_ended"))


# ---- labels, predicates, names and exports

LABEL_SQL = r"trim(regexp_replace(replace(lower({0}), '_', ' '), '\s+', ' ', 'g'), ' .;:,')"
TOKENS_SQL = "list_distinct(regexp_extract_all({0}, '[a-z0-9]+'))"
_LABELS = "SELECT DISTINCT p_type || ' ' || p_name AS label FROM part"
_KNOWN = "SELECT p_name AS name, CAST(min(p_partkey) AS BIGINT) AS ord FROM part GROUP BY 1 UNION ALL SELECT p_type || '_' || split_part(p_name, ' ', 2), 1000000 + min(p_partkey) FROM part GROUP BY 1"
_MET = f"""met AS (SELECT label, name, ord, {LABEL_SQL.format('label')} AS a, {LABEL_SQL.format('name')} AS b FROM labels, known),
 tok AS (SELECT *, {TOKENS_SQL.format('a')} AS ta, {TOKENS_SQL.format('b')} AS tb FROM met), cnt AS (SELECT *, len(list_intersect(ta, tb)) AS n_both, len(list_distinct(list_concat(ta, tb))) AS n_all FROM tok)"""


@query(f"""WITH labels AS ({_LABELS}), known AS ({_KNOWN}), {_MET},
 s AS (SELECT label, name, ord, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b))
  WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0 ELSE greatest(n_both / n_all, n_both / least(len(ta), len(tb))) END AS score FROM cnt)
SELECT label, name, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, ord) AS rn FROM s WHERE score > 0) WHERE rn = 1""")
def label_similarity_best(spark, d):
    return T.best_label(view(spark, d, _LABELS), view(spark, d, _KNOWN)).withColumn("score", F.round("score", 6))


_ENDINGS = ("lymphoma care", "research", "decision making", "clinical study", "genomic medicine analysis", "therapy", "disease", "workflow")
_CANDIDATES = "SELECT DISTINCT p_name || ' ' || CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_ENDINGS)) + " END AS candidate, CASE WHEN p_size % 2 = 0 THEN 'promote' ELSE 'merge' END AS action FROM part"
_CONFIRMED = "SELECT DISTINCT p_name || ' disease' AS name, 0 AS ord FROM part WHERE p_partkey % 3 = 0"


def _any(terms) -> str:
    return "(" + " OR ".join(f"contains(n, '{t}')" for t in terms) + ")"


@query(f"""WITH d AS ({_CANDIDATES}), labels AS (SELECT DISTINCT candidate AS label FROM d), known AS ({_CONFIRMED}), {_MET},
 s AS (SELECT label, name, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN greatest(n_both / n_all, 0.8) ELSE n_both / n_all END AS score FROM cnt),
 best AS (SELECT label, min(name) AS near FROM (SELECT *, max(score) OVER (PARTITION BY label) AS top FROM s) WHERE score = top AND score >= 0.34 GROUP BY 1),
 f AS (SELECT candidate, action, {LABEL_SQL.format('candidate')} AS n FROM d),
 r AS (SELECT candidate, near, action, CASE WHEN action = 'promote' AND {_any(T.PROMOTE_TERMS)} THEN 'keep_specialty'
   WHEN action = 'promote' AND ({_any(T.MERGE_PHRASES)} OR ({_any(T.GENERIC_TERMS)} AND NOT {_any(T.SPECIALTY_TERMS)})) THEN 'force_merge'
   WHEN action = 'promote' AND {_any(T.GENERIC_TERMS)} AND NOT {_any(T.BIOMEDICAL_TERMS)} THEN 'generic' WHEN action = 'promote' AND {_any(T.GENERIC_TERMS)} AND near IS NULL THEN 'dropped'
   WHEN action = 'promote' AND {_any(T.GENERIC_TERMS)} THEN 'generic_biomedical' WHEN action = 'merge' AND {_any(T.PROMOTE_TERMS)} THEN 'force_promote' ELSE 'as_decided' END AS rule FROM f LEFT JOIN best ON label = candidate)
SELECT candidate, rule, CASE WHEN rule IN ('force_merge', 'generic', 'generic_biomedical') THEN 'merge' WHEN rule = 'force_promote' THEN 'promote' WHEN rule = 'dropped' THEN 'dropped' ELSE action END AS action,
 CASE WHEN rule IN ('force_merge', 'generic', 'generic_biomedical') THEN coalesce(near, 'Biomedicine') ELSE candidate END AS target_subdomain, 'Biomedicine' AS parent_domain FROM r""")
def refinement_decisions(spark, d):
    known = view(spark, d, _CONFIRMED)
    # Ties in the score go to the smaller name: ord ranks the names.
    known = known.withColumn("ord", F.col("name"))
    decisions = view(spark, d, _CANDIDATES).withColumn("target_subdomain", F.col("candidate")).withColumn("parent_domain", F.lit(""))
    return T.post_filter(decisions, known, "Biomedicine").select("candidate", "rule", "action", "target_subdomain", "parent_domain")


_WORDS = ("increased", "elevates", "toxicity", "治疗", "binds", "unknown_word", "lowered", "risk", "level", "linked_to", "mediated_by", "caused", "protects")
_PREDICATES = "SELECT CASE l_partkey % 13 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_WORDS)) + " END AS predicate FROM lineitem"
_GROUPS_SQL = "g(predicate, grp) AS (VALUES " + ", ".join(f"('{x}', '{g}')" for g, xs in R.GROUPS.items() for x in xs) + ")"
_CATEGORIES_SQL = "k(grp, category) AS (VALUES " + ", ".join(f"('{x}', '{g}')" for g, xs in R.CATEGORIES.items() for x in xs) + ")"


@query(f"WITH p AS ({_PREDICATES}), {_GROUPS_SQL} SELECT coalesce(grp, 'other') AS grp, count(*) AS n, count(DISTINCT p.predicate) AS spellings FROM p LEFT JOIN g USING (predicate) GROUP BY 1")
def predicate_grouping(spark, d):
    p = view(spark, d, _PREDICATES).groupBy("predicate").agg(F.count("*").alias("n"))
    return p.groupBy(R.predicate_group(F.col("predicate")).alias("grp")).agg(F.sum("n").alias("n"), F.count("predicate").alias("spellings"))


@query(f"WITH p AS ({_PREDICATES}), {_GROUPS_SQL}, {_CATEGORIES_SQL}, c AS (SELECT coalesce(category, 'Other') AS category, count(*) AS n FROM p LEFT JOIN g USING (predicate) LEFT JOIN k USING (grp) GROUP BY 1) SELECT category, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM c")
def category_share(spark, d):
    p = view(spark, d, _PREDICATES).groupBy("predicate").agg(F.count("*").alias("n"))
    c = p.groupBy(R.predicate_category(R.predicate_group(F.col("predicate"))).alias("category")).agg(F.sum("n").alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("t")))).select("category", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("percent"))


@query(r"""WITH w AS (SELECT p_partkey, list_filter(list_transform(string_split_regex(trim(p_name || '_ ' || p_brand || ' -'), '[\s_]+'), lambda w: regexp_replace(w, '[^\w]', '', 'g')), lambda w: w <> '') AS ws FROM part)
SELECT p_partkey, ':' || array_to_string(list_transform(ws, lambda w: upper(w[1]) || w[2:]), '_') AS uri FROM w""")
def uri_mapping(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.to_uri(F.concat("p_name", F.lit("_ "), "p_brand", F.lit(" -"))).alias("uri"))


_TRIPLES = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' | has brand |' || p_brand WHEN 1 THEN p_name || '|' || p_brand ELSE p_name || '|a|b|' || p_type END AS name FROM part"


@query(f"""WITH t AS ({_TRIPLES}), s AS (SELECT p_partkey, name, list_transform(string_split(name, '|'), lambda x: trim(x)) AS p FROM t)
SELECT p_partkey, CASE WHEN len(p) >= 3 THEN p[1] ELSE trim(name) END AS subject, CASE WHEN len(p) >= 3 THEN p[2] ELSE '' END AS predicate, CASE WHEN len(p) >= 3 THEN array_to_string(p[3:], '|') ELSE '' END AS object FROM s""")
def triple_string_parse(spark, d):
    return view(spark, d, _TRIPLES).select("p_partkey", X.split_triple(F.col("name")).alias("t")).select("p_partkey", "t.*")


@query("WITH k AS (SELECT p_partkey, list_filter(list_transform(string_split_regex(p_name || '; ' || p_brand || ' ,|' || p_type, '[;,|]'), lambda x: trim(x)), lambda x: x <> '') AS ks FROM part) SELECT p_partkey, len(ks) AS n, array_to_string(ks, '/') AS keywords FROM k")
def keyword_split(spark, d):
    t = _t(spark, d, "part").select("p_partkey", keywords(F.concat("p_name", F.lit("; "), "p_brand", F.lit(" ,|"), "p_type")).alias("ks"))
    return t.select("p_partkey", F.size("ks").cast("long").alias("n"), F.array_join("ks", "/").alias("keywords"))


@query(f"WITH {WITH_NODES} SELECT id, name, CASE WHEN is_concept THEN 'Entity;Concept' ELSE 'Entity' END AS labels, is_concept FROM nodes")
def export_nodes(spark, d):
    labels = F.when(F.col("is_concept"), F.array(F.lit("Entity"), F.lit("Concept"))).otherwise(F.array(F.lit("Entity")))
    return W.node_rows(nodes(spark, d).withColumn("labels", labels)).select("id", "name", "labels", "is_concept")


@query(f"WITH {WITH_EDGES}, {WITH_NODES} SELECT src AS source_id, a.name AS source_name, dst AS target_id, b.name AS target_name, rel_type AS relation_type, is_ontology FROM edges LEFT JOIN nodes a ON src = a.id LEFT JOIN nodes b ON dst = b.id")
def export_edges(spark, d):
    e = edges(spark, d).withColumn("evidence", F.lit(None).cast("string"))
    return W.edge_rows(e, nodes(spark, d)).select("source_id", "source_name", "target_id", "target_name", "relation_type", "is_ontology")


_GOLD = "SELECT DISTINCT p_brand AS paper_id, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' model' ELSE '' END AS name FROM part WHERE p_size < 25"
_PRED = "SELECT DISTINCT p_brand AS paper_id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE split_part(p_name, ' ', 2) || ' ' || p_type END AS name FROM part WHERE p_size >= 25"


@query(None)
def fuzzy_prf(spark, d):
    """J06, D07, A25 on part names by brand; the tests hold the pairs against the predicate over all pairs."""
    gold, pred = view(spark, d, _GOLD), view(spark, d, _PRED)
    n = lambda t: t.agg(F.count("*"))
    return M.scores(n(gold), n(pred), n(M.greedy_pairs(M.name_pairs(gold, pred))))


@query("""WITH e AS (SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS tries FROM events)
SELECT user_id, event_type, tries, CASE WHEN value >= 7 AND event_type <> 'error' THEN 'completed' WHEN tries < 3 THEN 'retry' WHEN event_type <> 'error' THEN 'completed' ELSE 'failed' END AS status FROM e WHERE rn = 1""")
def event_stage_status(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("paper_id"), F.struct("ts", "event_id").alias("attempt"), F.col("value").alias("score"), F.when(F.col("event_type") == "error", F.lit("error")).alias("error"), "event_type")
    last = e.groupBy("paper_id").agg(F.max_by("event_type", "attempt").alias("event_type"))
    return S.workflow_state(e).join(last, "paper_id").select(F.col("paper_id").alias("user_id"), "event_type", "tries", "status")


# ---- chunks and evidence

_WS = "' ' || chr(9) || chr(10) || chr(13)"


@query(f"""WITH t AS (SELECT doc_id, trim(text, {_WS}) AS c, trim(substr(text, 40, 25), {_WS}) AS e FROM documents),
 p AS (SELECT *, list_filter(list_transform(string_split_regex(c, '\\n\\s*\\n'), lambda x: trim(x, {_WS})), lambda x: x <> '') AS ps FROM t),
 a AS (SELECT *, list_position(list_transform(ps, lambda x: contains(x, e) OR contains(e, x)), true) AS k, instr(c, e) AS pos FROM p)
SELECT doc_id, CASE WHEN k > 0 THEN array_to_string(ps[greatest(k - 1, 1):k + 1], chr(10) || chr(10)) WHEN pos > 0 THEN trim(substr(c, greatest(pos - 260, 1), pos - greatest(pos - 260, 1) + length(e) + 260), {_WS})
 ELSE trim(c[1:520], {_WS}) END AS context FROM a""")
def evidence_window(spark, d):
    return _t(spark, d, "documents").select("doc_id", K.surroundings(F.substring("text", 40, 25), F.col("text")).alias("context"))


# ---- lines of extracted pages

_LINES = "SELECT l_orderkey, l_linenumber, CASE l_partkey % 12 WHEN 0 THEN 'Received ' || l_quantity WHEN 1 THEN '3. Results' WHEN 2 THEN 'References:' WHEN 3 THEN 'Figure 2 shows' WHEN 4 THEN 'Copyright 2020' WHEN 5 THEN '  ' WHEN 6 THEN 'page 12' WHEN 7 THEN '4 of 9' WHEN 8 THEN 'iv) Discussion.' WHEN 9 THEN 'published online' WHEN 10 THEN 'tables are long' ELSE 'plain body' END AS line FROM lineitem"


def _alternatives(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


# ---- standard predicates, run reports, Turtle counts, taxonomy rounds

_VARIANTS_SQL = "v(ord, variant, form) AS (VALUES " + ", ".join(f"({k}, '{v}', '{g}')" for k, (v, g) in enumerate(list({v: g for g, vs in R.GROUPS.items() for v in vs}.items()) + [("", "unknown")])) + ")"
_FORMS_SQL = f"""p AS (SELECT CASE WHEN predicate = 'risk' THEN ' Risk ' WHEN predicate = '治疗' THEN 'the 治疗 of' ELSE predicate END AS predicate FROM ({_PREDICATES})), {_VARIANTS_SQL},
 f AS (SELECT DISTINCT predicate, coalesce((SELECT form FROM v WHERE variant = trim(lower(x.predicate))), (SELECT arg_min(form, ord) FROM v WHERE contains(variant, trim(lower(x.predicate))) OR contains(trim(lower(x.predicate)), variant))) AS form FROM p x)"""


def _spelled(spark, d):
    p = view(spark, d, _PREDICATES)
    return p.select(F.when(F.col("predicate") == "risk", " Risk ").when(F.col("predicate") == "治疗", "the 治疗 of").otherwise(F.col("predicate")).alias("predicate"))


@query(f"WITH {_FORMS_SQL} SELECT predicate AS original_predicate, form AS predicate, count(*) AS n FROM p JOIN f USING (predicate) GROUP BY 1, 2")
def standard_predicates(spark, d):
    return P.standardised(_spelled(spark, d), R.GROUPS).groupBy("original_predicate", "predicate").agg(F.count("*").alias("n"))


@query(f"WITH {_FORMS_SQL} SELECT count(*) AS total, count_if(form = 'unknown') AS \"unknown\", count_if(form <> 'unknown' AND lower(form) = lower(predicate)) AS unchanged, count_if(form <> 'unknown' AND lower(form) <> lower(predicate)) AS normalized FROM p JOIN f USING (predicate)")
def predicate_changes(spark, d):
    return P.predicate_changes(_spelled(spark, d), R.GROUPS)


@query("""WITH t AS (SELECT count(*) AS total_papers, count_if(o_orderstatus = 'F') AS total_completed, count_if(o_orderstatus = 'P') AS total_failed, count(DISTINCT o_custkey % 50) AS total_batches, (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 1e6 AS duration_seconds FROM orders)
SELECT total_papers, total_completed, total_failed, total_batches, round(100.0 * total_completed / total_papers, 6) AS success_rate, duration_seconds, round(duration_seconds / total_papers, 6) AS seconds_per_paper FROM t""")
def run_totals(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("in_progress")
    day = F.col("o_orderdate").cast("timestamp")
    t = P.run_totals(_t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("batch_id"), status.alias("status"), day.alias("started"), day.alias("ended")))
    return t.withColumn("success_rate", F.round("success_rate", 6)).withColumn("seconds_per_paper", F.round("seconds_per_paper", 6))


@query("""WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT count_if(n > 0) AS papers_with_qa, CAST(sum(n) AS BIGINT) AS total_questions, round(sum(n) / greatest(count_if(n > 0), 1), 6) AS average_questions, max(n) AS most, min(n) AS fewest FROM c""")
def question_totals(spark, d):
    n = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("questions"))
    return P.question_totals(_t(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left")).withColumn("average_questions", F.round("average_questions", 6))


@query("WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) SELECT count(*) AS clusters, round(avg(n), 6) AS average_size, max(n) AS largest, min(n) AS smallest FROM c")
def cluster_sizes(spark, d):
    return P.cluster_sizes(_t(spark, d, "part").select(F.struct("p_brand", "p_type").alias("cluster"))).withColumn("average_size", F.round("average_size", 6))


_TURTLE = r"""SELECT p_partkey AS path, '# ===== SECTION: S' || p_size || ' (CHUNK 1) =====' || chr(10) || '```turtle' || chr(10) || '# a comment.' || chr(10) || ':P' || p_partkey || ' rdf:type :Model ;' || chr(10)
 || '  :sourceSection "' || p_type || '" ; :sourceChunk "1" ;' || chr(10) || '# ===== SECTION: T =====' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN ':Q a :Dataset .' || chr(10) ELSE '' END || '  :made_by :B' || chr(10) || '```' || chr(10) || ':outside :of :block .' AS text FROM part"""


@query("SELECT p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 2 END AS n_triples, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS n_entities, 2 AS n_sections FROM part")
def turtle_counts(spark, d):
    t = U.turtle_counts(view(spark, d, _TURTLE.replace("chr(10)", "'\\n'")))
    return t.select("path", *[F.col(c).cast("int").alias(c) for c in ("n_triples", "n_entities", "n_sections")])


_ROUND = "SELECT DISTINCT p_name AS candidate, CASE WHEN length(p_name) % 3 = 0 THEN 'promote' WHEN length(p_name) % 3 = 1 THEN 'merge' ELSE 'dropped' END AS action, CASE WHEN length(p_name) % 3 = 1 THEN 'Old One' ELSE p_name END AS target_subdomain, 'New Root' AS parent_domain FROM part"


_MOVED = f"""d AS ({_ROUND}), o AS (SELECT DISTINCT p_name FROM part WHERE p_size <= 40), a AS (SELECT * FROM d WHERE action <> 'dropped' AND candidate IN (SELECT p_name FROM o))"""


def _round_tables(spark, d):
    part = _t(spark, d, "part")
    candidates = part.filter("p_size <= 40").select(F.col("p_name").alias("name")).distinct().withColumn("status", F.lit("candidate"))
    known = spark.sql("SELECT 'Old one.' AS name, 'Root' AS parent, 'confirmed' AS status, 1 AS taxonomy_version")
    suggests = part.select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("candidate"))
    return T.apply_round(candidates, known, suggests, view(spark, d, _ROUND), 2)


@query(f"""WITH {_MOVED}, m AS (SELECT p_partkey AS paper_id, action, target_subdomain AS subdomain FROM part JOIN a ON p_name = candidate)
SELECT paper_id, subdomain, CASE WHEN action = 'promote' THEN 'New Root' ELSE 'Root' END AS parent_domain FROM m""")
def taxonomy_round(spark, d):
    return _round_tables(spark, d)["papers"]


@query(f"WITH {_MOVED} SELECT p_name AS name, CASE action WHEN 'promote' THEN 'promoted' WHEN 'merge' THEN 'merged' ELSE 'candidate' END AS status FROM o LEFT JOIN a ON p_name = candidate")
def taxonomy_round_candidates(spark, d):
    return _round_tables(spark, d)["candidates"].select("name", "status")


@query(f"WITH {_MOVED} SELECT lower(candidate) AS candidate, CASE action WHEN 'promote' THEN 'PROMOTED_TO' ELSE 'MERGED_INTO' END AS rel_type, target_subdomain AS target FROM a")
def taxonomy_round_links(spark, d):
    return _round_tables(spark, d)["links"]


@query(f"""WITH {_MOVED} SELECT candidate AS name, 'New Root' AS parent, 'confirmed' AS status, 2 AS taxonomy_version FROM a WHERE action = 'promote' UNION ALL SELECT 'New Root', NULL, 'confirmed', 2 WHERE EXISTS (SELECT 1 FROM a WHERE action = 'promote')
UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM a WHERE action = 'merge') THEN 'Old One' ELSE 'Old one.' END, 'Root', 'confirmed', CASE WHEN EXISTS (SELECT 1 FROM a WHERE action = 'merge') THEN 2 ELSE 1 END""")
def taxonomy_round_subdomains(spark, d):
    return _round_tables(spark, d)["subdomains"].select("name", "parent", "status", "taxonomy_version")


# ---- grounding and exports

_NAMED = "CASE WHEN vec_id % 200 = 0 THEN 'l' || label WHEN vec_id % 300 = 0 THEN 'L' ELSE 'q' || vec_id END"


@query(f"""WITH r AS (SELECT query_id, vec_id, rank, d FROM ({_RANKED}) WHERE rank <= 5), n AS (SELECT vec_id AS query_id, {_NAMED} AS name FROM embeddings WHERE vec_id % 100 = 0),
 c AS (SELECT query_id, rank, d, n.name, 'L' || label AS other, 'v' || r.vec_id AS entity_id FROM r JOIN n USING (query_id) JOIN embeddings e ON e.vec_id = r.vec_id),
 g AS (SELECT *, lower(name) = lower(other) AS same, d < 1.0 AND NOT ((contains(name, other) OR contains(other, name)) AND abs(length(name) - length(other)) > 3) AS good FROM c),
 b AS (SELECT query_id, arg_min(entity_id, rank) FILTER (same) AS exact_id, count(*) FILTER (good) AS n_good, arg_min(entity_id, rank) FILTER (good) AS good_id, min(d) FILTER (good) AS good_d FROM g GROUP BY 1)
SELECT query_id, coalesce(exact_id, CASE WHEN n_good = 1 AND good_d < 0.7 THEN good_id END, 'ent_' || left(md5(lower(name)), 16)) AS entity_id,
 CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN n_good = 1 AND good_d < 0.7 THEN 'strong' ELSE 'new' END AS how FROM n LEFT JOIN b USING (query_id)""")
def resolve_names(spark, d):
    e = _t(spark, d, "embeddings")
    names = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.expr(_NAMED).alias("name"), F.col("embedding").alias("q"))
    index = e.select("vec_id", F.concat(F.lit("L"), "label").alias("name"), F.concat(F.lit("v"), "vec_id").alias("entity_id"), F.col("embedding").alias("v"))
    return N.resolve_names(names, index)


@query(f"""WITH {WITH_CLAIMS}, {WITH_NODES}, e AS (SELECT lower(name) AS n, min(id) AS id FROM nodes GROUP BY 1)
SELECT claim_ord, s.id AS subject_id, o.id AS object_id, CASE WHEN s.id IS NULL OR o.id IS NULL THEN 'extracted' ELSE 'grounded' END AS status
FROM claims LEFT JOIN e s ON lower(replace(subject, '  ', ' ')) = s.n LEFT JOIN e o ON lower(replace(object, '  ', ' ')) = o.n""")
def ground_claims(spark, d):
    one = lambda c: F.replace(c, F.lit("  "), F.lit(" ")).alias(c)
    c = claims(spark, d).select("claim_ord", one("subject"), one("object"))
    return N.ground_claims(c, nodes(spark, d).withColumnRenamed("id", "entity_id")).select("claim_ord", "subject_id", "object_id", "status")


@query("""WITH r AS (SELECT p_name AS subject, p_brand AS predicate, p_type AS object, repeat('x', p_size) AS context, p_partkey AS ord FROM part),
 b AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY length(context) DESC, ord) AS k, count(*) OVER (PARTITION BY subject, predicate, object) AS frequency FROM r)
SELECT 'S' || ord AS source_section, CAST(ord % 7 AS VARCHAR) AS source_chunk, context AS context_text, frequency, ':' || array_to_string(list_transform(list_filter(list_transform(string_split_regex(trim(subject), '[\\s_]+'), lambda w: regexp_replace(w, '[^\\w]', '', 'g')), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '_') AS subject, ':' || array_to_string(list_transform(list_filter(list_transform(string_split_regex(trim(predicate), '[\\s_]+'), lambda w: regexp_replace(w, '[^\\w]', '', 'g')), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '_') AS predicate, ':' || array_to_string(list_transform(list_filter(list_transform(string_split_regex(trim(object), '[\\s_]+'), lambda w: regexp_replace(w, '[^\\w]', '', 'g')), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '_') AS object FROM b WHERE k = 1""")
def representative_relations(spark, d):
    p = _t(spark, d, "part")
    r = p.select(F.col("p_name").alias("subject"), F.col("p_brand").alias("predicate"), F.col("p_type").alias("object"), F.expr("repeat('x', p_size)").alias("context"), F.col("p_partkey").alias("ord"),
                 F.concat(F.lit("S"), "p_partkey").alias("section"), (F.col("p_partkey") % 7).cast("string").alias("chunk"), F.col("p_name").alias("paper"))
    return W.representative_rows(r, r).select("subject", "predicate", "object", "source_section", "source_chunk", "context_text", "frequency")


@query("SELECT conv_id AS paper_id, role AS section, min(turn) AS first, CAST(count(*) AS INTEGER) AS n_chunks, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS content_length, string_agg(turn, ',' ORDER BY turn) AS turns FROM conversations GROUP BY 1, 2")
def nested_sections(spark, d):
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("role").alias("section"), F.col("turn").alias("ord"), F.col("turn").alias("chunk_id"), "text")
    turns = F.array_join(F.transform("chunks", lambda x: x.ord.cast("string")), ",")
    return W.nested_sections(c).select("paper_id", "section", "first", F.size("chunks").alias("n_chunks"), "content_length", turns.alias("turns"))


# The other modules register theirs when they are imported.
from . import file_queries, graph_queries, model_queries, text_queries  # noqa: E402, F401
