"""Queries that write files from the tables and read them again: readers (S01–S24) and sinks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import predicates as R
from ..functions import text as X
from ..operators import reports as P
from ..operators import store as S
from ..sources import exports as E
from ..sources import papers as A
from ..sources import pdf as D
from ..sources import scratch, settings
from ..sources import turtle as U
from ..sources import writers as W
from ..streaming import ingest as I
from .queries import WITH_CLAIMS, WITH_EDGES, WITH_NODES
from .registry import query, table
from .testmap import claims, edges, nodes, view


def _back(spark, t, write, read, tag="query"):
    """What ``read`` finds in the folder into which ``write`` put the rows."""
    path = scratch.folder(spark, tag)
    write(t, path)
    return read(path)


def _csv(spark, t):
    return _back(spark, t, W.write_csv, lambda p: spark.read.csv(p, header=True, escape='"', multiLine=True))


def _texts(spark, d, sql):
    """(path, text) of files that hold the rows (name, value) of a query."""
    path = scratch.folder(spark, "files")
    W.write_named(view(spark, d, sql), path)
    return U.files(spark, path)


# ---- papers

_NL4 = "'\\n\\n\\n\\n'"
_STAFF = "SELECT s_nationkey, array_join(array_sort(collect_list(s_name)), ' and ') AS staff FROM supplier GROUP BY 1"
_PAPERS = f"""SELECT 'paper_' || n_nationkey || '.json' AS name, CASE n_nationkey % 4
 WHEN 0 THEN '[{{"id":"title","text":" ' || n_name || ' Title "}},{{"id":"abstract","text":"About ' || n_name || '."}},5,"loose",{{"id":"s1","metadata":{{"section_title":"Results"}},"text":"' || coalesce(staff, 'Nobody') || '"}}]'
 WHEN 1 THEN '{{"title":"' || n_name || ' paper","keywords":"a' || n_nationkey || '; b|c, d","year":2000,"sections":[{{"section_title":"Abstract","text":"Abs of ' || n_name || '"}},{{"section_title":"Methods","text":" ' || coalesce(staff, 'Nobody') || '. "}}]}}'
 WHEN 2 THEN '{{"title":" ","metadata":{{"paper_title":"Named ' || n_name || '","doi":"10.1/' || n_nationkey || '","keywords":["k1"," k2 ",""]}},"summary":"Sum ' || n_name || '","sections":[]}}'
 ELSE '{{broken' END AS value FROM nation LEFT JOIN ({_STAFF}) ON s_nationkey = n_nationkey"""
_STAFF_DUCK = "SELECT s_nationkey, string_agg(s_name, ' and ' ORDER BY s_name) AS staff FROM supplier GROUP BY 1"
PAPER_SQL = f"""SELECT 'paper_' || n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN n_name || ' Title' WHEN 1 THEN n_name || ' paper' ELSE 'Named ' || n_name END AS title,
 CASE n_nationkey % 4 WHEN 0 THEN 'About ' || n_name || '.' WHEN 1 THEN 'Abs of ' || n_name ELSE 'Sum ' || n_name END AS abstract,
 replace(CASE n_nationkey % 4 WHEN 0 THEN n_name || ' Title~~~~About ' || n_name || '.~~~~## Results~~' || coalesce(staff, 'Nobody') WHEN 1 THEN '## Abstract~~Abs of ' || n_name || '~~~~## Methods~~' || coalesce(staff, 'Nobody') || '.' ELSE 'Sum ' || n_name END, '~', chr(10)) AS content,
 CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' || n_nationkey || ',b,c,d' ELSE 'k1,k2' END AS keywords, CAST(CASE n_nationkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS section_count,
 CASE n_nationkey % 4 WHEN 1 THEN '2000' END AS year, CASE n_nationkey % 4 WHEN 2 THEN '10.1/' || n_nationkey END AS doi FROM nation LEFT JOIN ({_STAFF_DUCK}) ON s_nationkey = n_nationkey WHERE n_nationkey % 4 < 3"""


def _papers(t):
    return t.select("id", "title", "abstract", "content", F.array_join("keywords", ",").alias("keywords"), "section_count", "year", "doi")


@query(PAPER_SQL)
def paper_scan(spark, d):
    path = scratch.folder(spark, "papers")
    W.write_named(view(spark, d, _PAPERS), path)
    return _papers(A.read_papers(spark, path))


@query(f"SELECT * FROM ({PAPER_SQL}) WHERE id IN ('paper_1', 'paper_6', 'paper_8')")
def papers_by_name(spark, d):
    path = scratch.folder(spark, "papers")
    W.write_named(view(spark, d, _PAPERS), path)
    return _papers(A.read_papers(spark, path, ["paper_1.json", "paper_6.json", "paper_8.json", "paper_3.json", "none.json"]))


@query("SELECT 'paper_' || n_nationkey || '.json' AS file FROM nation WHERE n_nationkey % 4 = 3")
def unreadable_papers(spark, d):
    return A.unreadable(_texts(spark, d, _PAPERS)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"))


_SECTIONS = """SELECT 'paper_' || p_size || CASE WHEN p_size % 2 = 0 THEN '' ELSE '_x' END || '.json' AS name, '[' || array_join(transform(array_sort(collect_list(struct(p_partkey, p_name, p_type))), x ->
 '{"id":"s' || x.p_partkey || '","metadata":{"section_title":"' || CASE WHEN x.p_partkey % 3 = 0 THEN '' ELSE x.p_type END || '"},' || CASE WHEN x.p_partkey % 2 = 0 THEN '"text":" ' || x.p_name || ' "' ELSE '"content":"' || x.p_name || '"' END || '}'), ',') || ']' AS value FROM part GROUP BY p_size"""


@query("""WITH s AS (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS title, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS body FROM part),
 t AS (SELECT p_size, first(title ORDER BY k) FILTER (title <> '') AS title, string_agg(CASE WHEN title <> '' THEN '## ' || title || '~' || CASE WHEN body <> '' THEN '~' ELSE '' END ELSE '' END || CASE WHEN body <> '' THEN body || '~~~' ELSE '' END, '~' ORDER BY k) FILTER (title <> '' OR body <> '') AS content FROM s GROUP BY 1)
SELECT 'paper_' || p_size || CASE WHEN p_size % 2 = 0 THEN '' ELSE '_x' END AS id, coalesce(title, 'paper_' || p_size || CASE WHEN p_size % 2 = 0 THEN '' ELSE '_x' END) AS title, replace(coalesce(content, ''), '~', chr(10)) AS content FROM t""")
def prototype_papers(spark, d):
    return A.prototype_papers(_texts(spark, d, _SECTIONS))


@query("""SELECT p_size, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS INTEGER) AS chunk_index, 's' || p_partkey AS section_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS title, p_name AS text FROM part""")
def chunk_scan(spark, d):
    c = A.chunks(_texts(spark, d, _SECTIONS))
    return c.select(F.regexp_extract("path", r"paper_(\d+)", 1).cast("int").alias("p_size"), "chunk_index", "section_id", "title", "text")


@query("SELECT p_size, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS INTEGER) AS chunk_id, 's' || p_partkey AS name, p_name AS content FROM part")
def chunk_markers(spark, d):
    c = A.from_markers(A.marked(A.chunks(_texts(spark, d, _SECTIONS))))
    return c.select(F.regexp_extract("path", r"paper_(\d+)", 1).cast("int").alias("p_size"), "chunk_id", "name", "content")


@query("""WITH n AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'paper_' || p_partkey || '.json' ELSE 'q' || p_partkey END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS k FROM part)
SELECT name, row_number() OVER (ORDER BY k NULLS LAST, name) - 1 AS ord, CAST((row_number() OVER (ORDER BY k NULLS LAST, name) - 1) // 50 AS INTEGER) AS batch_id FROM n""")
def natural_order(spark, d):
    n = table(spark, d, "part").select(F.when(F.expr("p_partkey % 2 = 0"), F.concat(F.lit("paper_"), "p_partkey", F.lit(".json"))).otherwise(F.concat(F.lit("q"), "p_partkey")).alias("name")).distinct()
    return I.with_batches(A.natural_order(n), 50)


_REPORTS = """SELECT CASE WHEN r_regionkey < 3 THEN 'large_scale_report_2024' || r_regionkey || '.json' ELSE 'zz_report_' || r_regionkey || '.json' END AS name, '{"area":"' || r_name || '","sections":[{"k":' || r_regionkey || '},7]}' AS value FROM region"""


@query("SELECT 'large_scale_report_20242.json' AS file, r_name AS region FROM region WHERE r_regionkey = 2")
def newest_report(spark, d):
    t = A.newest_report(_texts(spark, d, _REPORTS))
    return t.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.get_json_object(F.btrim("text", F.lit("\n")), "$.area").alias("region"))


@query("SELECT CAST(r_regionkey AS INTEGER) AS k, 0 AS pos FROM region")
def stage_records(spark, d):
    return A.stage_records(_texts(spark, d, _REPORTS), "STRUCT<k INT>").select("k", "pos")


# ---- turtle, tables, logs

_TTL = """SELECT 'paper_' || n_nationkey || '.ttl' AS name, '# head\\n:Early :is :Lost ;\\n' || array_join(transform(array_sort(collect_list(struct(s_suppkey))), x -> '# ===== SECTION: Part_' || x.s_suppkey || ' (CHUNK 3) =====\\n```turtle\\n:S-' || x.s_suppkey || ' :works_in :N_' || n_nationkey || ' ;\\n'
 || CASE WHEN x.s_suppkey % 2 = 0 THEN '  :sourceChunk "' || (x.s_suppkey % 7) || '" ;\\n  :sourceSection "Given" ;\\n' ELSE '' END || CASE WHEN x.s_suppkey % 5 = 0 THEN '' ELSE '  :contextText "works ' || x.s_suppkey || '" .\\n' END || ':S-' || x.s_suppkey || ' rdf:type :Supplier ;\\n  :contextText "is one" .\\n:Q :says "literal" ;\\n```\\n'), '') AS value
 FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey"""


@query("""WITH s AS (SELECT s_nationkey AS n, s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'Given' ELSE 'Part' END AS section, CASE WHEN s_suppkey % 2 = 0 THEN '' || (s_suppkey % 7) ELSE '' END AS chunk FROM supplier)
SELECT n, section, chunk, 'S-' || k AS subject, 'works_in' AS predicate, 'N_' || n AS object, 'works ' || k AS context FROM s WHERE k % 5 <> 0
UNION ALL SELECT n, 'Part', '', 'S-' || k, 'type', 'Supplier', 'is one' FROM s""")
def turtle_extraction(spark, d):
    t = U.extraction_triples(_texts(spark, d, _TTL))
    return t.select(F.regexp_extract("path", r"paper_(\d+)", 1).cast("long").alias("n"), "section", "chunk", "subject", "predicate", "object", "context")


_GOLD_TTL = """SELECT 'paper_' || n_nationkey || '.ttl' AS name, '# note\\n' || array_join(transform(array_sort(collect_list(struct(s_suppkey))), x -> ':BigSupplier' || x.s_suppkey || ' :worksIn :HomeNation' || n_nationkey || ' ;\\n    :trainedOn "Data ' || x.s_suppkey || '" ;\\n    :contextText "x" .\\n'), '') AS value
 FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey"""


@query("""SELECT s_nationkey AS n, 'Big Supplier' || s_suppkey AS subject, 'works In' AS predicate, 'Home Nation' || s_nationkey AS object FROM supplier UNION ALL SELECT s_nationkey, 'Big Supplier' || s_suppkey, 'trained On', 'Data ' || s_suppkey FROM supplier""")
def gold_triples(spark, d):
    t = U.gold_triples(_texts(spark, d, _GOLD_TTL))
    return t.select(F.regexp_extract("path", r"paper_(\d+)", 1).cast("long").alias("n"), "subject", "predicate", "object")


@query("""WITH s AS (SELECT s_nationkey AS n, count(*) AS k, count(DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 7 END) AS chunks, count_if(s_suppkey % 2 = 0) AS even, count_if(s_suppkey % 5 <> 0) AS ctx FROM supplier GROUP BY 1)
SELECT n, 1 + 3 * k + 2 * even + ctx + k - 1 - k AS total_triples, CAST(k AS BIGINT) AS n_supplier, CAST(CASE WHEN even > 0 THEN 1 ELSE 0 END AS BIGINT) AS sections_covered, CAST(chunks AS BIGINT) AS chunks_covered FROM s""")
def turtle_statistics(spark, d):
    t = U.extraction_counts(_texts(spark, d, _TTL), ("Supplier",))
    return t.select(F.regexp_extract("path", r"paper_(\d+)", 1).cast("long").alias("n"), "total_triples", "n_supplier", "sections_covered", "chunks_covered")


@query(f"""WITH {WITH_EDGES}, {WITH_NODES}, l AS (SELECT id, CASE WHEN id LIKE 'R%' THEN upper(name) ELSE name END AS name, CASE WHEN id LIKE 'N%' THEN 'Entity;Ontology' ELSE 'Entity' END AS labels FROM nodes)
SELECT 'entity' AS kind, min(name) AS a, '' AS b, '' AS c FROM l WHERE labels NOT LIKE '%Ontology%' GROUP BY lower(name)
UNION ALL SELECT 'triple', min(a.name), rel_type, min(b.name) FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE rel_type NOT IN ('placed', 'contains', 'supplied_by', 'subclass_of') GROUP BY lower(a.name), rel_type, lower(b.name)""")
def graph_csv_scan(spark, d):
    n = nodes(spark, d)
    l = n.withColumn("labels", F.when(F.expr("id LIKE 'N%'"), F.array(F.lit("Entity"), F.lit("Ontology"))).otherwise(F.array(F.lit("Entity")))).withColumn("name", F.expr("CASE WHEN id LIKE 'R%' THEN upper(name) ELSE name END"))
    e = edges(spark, d).filter("rel_type NOT IN ('placed', 'contains', 'supplied_by')").withColumn("rel_type", F.expr("CASE WHEN rel_type = 'subclass_of' THEN 'IS_A' ELSE rel_type END")).withColumn("evidence", F.lit(""))
    entities, triples = A.graph_csv(_csv(spark, W.node_rows(l)), _csv(spark, W.edge_rows(e, n)))
    return entities.select(F.lit("entity").alias("kind"), F.col("name").alias("a"), F.lit("").alias("b"), F.lit("").alias("c")).union(triples.select(F.lit("triple"), "subject", "predicate", "object"))


@query("SELECT DISTINCT CASE WHEN p_size < 40 THEN 'paper_' || p_size ELSE 'other' END AS source_paper FROM part WHERE p_size < 40")
def predicted_papers(spark, d):
    return A.predicted_papers(_csv(spark, view(spark, d, "SELECT p_name, CASE WHEN p_size < 40 THEN ' paper_' || p_size ELSE 'other' END AS source_paper FROM part")))


_QA = """SELECT CASE WHEN r_regionkey = 4 THEN 'other.json' ELSE 'paper_' || r_regionkey || '_QA_pair.json' END AS name, '[' || array_join(transform(array_sort(collect_list(struct(n_nationkey, n_name))), x -> '{"section":"' || r_name || '","question":"Where is ' || x.n_name || '?","options":{"A":"' || x.n_name || '","B":"no","C":"maybe","D":"' || x.n_nationkey || '"},"correct_answer":"A","explanation":"e' || x.n_nationkey || '"}'), ',') || ']' AS value
 FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name"""


@query("SELECT CAST(r_regionkey AS VARCHAR) AS paper_id, r_name AS section, 'Where is ' || n_name || '?' AS question, n_name AS a, '' || n_nationkey AS d, 'A' AS correct_answer, 'e' || n_nationkey AS explanation FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey <> 4")
def question_files(spark, d):
    return A.questions(_texts(spark, d, _QA)).select("paper_id", "section", "question", F.col("options")["A"].alias("a"), F.col("options")["D"].alias("d"), "correct_answer", "explanation")


_MENTOR = """SELECT p_brand AS paper_id, p_partkey AS ord, p_name AS subject, CASE WHEN p_partkey % 5 = 0 THEN 'is | odd' ELSE 'is' END AS predicate, p_type AS object, 'S' || p_size AS section, p_partkey % 9 AS chunk, 'seen "' || p_name || '", twice' AS context FROM part"""
_CAPPED = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS k FROM ({_MENTOR})) WHERE k <= 40"


@query(f"SELECT '关系' AS 类型, subject || ' | ' || predicate || ' | ' || object AS 名称, paper_id AS 出处, '位置: ' || section || ' / chunk ' || chunk || ' | 证据: ' || context AS 片段 FROM ({_CAPPED})")
def mentor_csv(spark, d):
    return _csv(spark, W.mentor_rows(view(spark, d, _MENTOR)))


@query(f"SELECT subject, predicate, object, section AS source_section, CAST(chunk AS VARCHAR) AS source_chunk, context AS context_text FROM ({_CAPPED}) WHERE predicate = 'is'")
def relation_csv(spark, d):
    return A.relation_rows(_csv(spark, W.mentor_rows(view(spark, d, _MENTOR))))


@query(f"SELECT paper_id, CAST(ord AS VARCHAR) AS ord, subject, predicate, object, section, CAST(chunk AS VARCHAR) AS chunk, context FROM ({_MENTOR})")
def triples_csv(spark, d):
    return _back(spark, view(spark, d, _MENTOR), W.write_csv, lambda p: A.triples_csv(spark, p))


_LOG = """SELECT 'run_' || c_nationkey || '.log' AS name, array_join(transform(array_sort(collect_list(struct(c_custkey, c_name))), x -> '✓ Written: ' || x.c_name || ' -[buys from]-> a very long object name that is cut after forty characters ' || x.c_custkey || '\\n>>> [' || x.c_custkey || '] Paper Summary:\\n  - Claims extracted: ' || (x.c_custkey + 3) || '\\n  - Claims grounded: ' || (x.c_custkey + 2) || '\\n  - Claims validated: ' || (x.c_custkey + 1) || '\\n  - Claims written: ' || x.c_custkey || '\\n'), '')
 || 'Final Graph Statistics\\n=====\\nStats: ' || count(*) || ' nodes, 7 relationships\\nPapers processed: ' || count(*) || '\\nTotal claims extracted: 1\\nTotal claims grounded: 2\\nTotal claims validated: 3\\nTotal claims written to graph: 4\\n' AS value FROM customer GROUP BY c_nationkey"""


@query("""SELECT 'papers' AS part, c_nationkey AS n, CAST(c_custkey AS VARCHAR) AS a, (c_custkey + 3) || '/' || (c_custkey + 2) || '/' || (c_custkey + 1) || '/' || c_custkey AS b FROM customer
UNION ALL SELECT 'written', c_nationkey, c_name, 'buys from/a very long object name that is cut afte' FROM customer UNION ALL SELECT 'graph', c_nationkey, '' || count(*), '7' FROM customer GROUP BY 2 UNION ALL SELECT 'totals', c_nationkey, '' || count(*), '1/2/3/4' FROM customer GROUP BY 2""")
def run_log(spark, d):
    log = A.run_log(_texts(spark, d, _LOG))
    n = F.regexp_extract("path", r"run_(\d+)", 1).cast("long").alias("n")
    row = lambda t, a, *b: log[t].select(F.lit(t).alias("part"), n, F.col(a).cast("string").alias("a"), F.concat_ws("/", *b).alias("b"))
    steps = ("extracted", "grounded", "validated", "written")
    return row("papers", "paper", *steps).union(row("written", "subject", "relation", "object")).union(row("graph", "nodes", "relationships")).union(row("totals", "papers", *steps))


# ---- page layout

_CHARS = """SELECT 'f' || l_suppkey AS path, CAST(l_orderkey % 3 + 1 AS INTEGER) AS page, CAST(600 AS DOUBLE) AS width, CAST(CASE WHEN l_suppkey % 2 = 0 THEN 50 + 250 * (l_linenumber % 2) + l_partkey % 200 ELSE l_partkey % 590 END AS DOUBLE) AS x0, CAST(l_orderkey % 40 * 10 AS DOUBLE) AS y0, CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE 'x' END AS char FROM lineitem"""


@query(f"""WITH c AS (SELECT path, page, x0 + 2 AS x, width FROM ({_CHARS}) WHERE char <> ' '),
 s AS (SELECT path, page, count_if(x < 264) / count(*) AS l, count_if(x > 336) / count(*) AS r, count_if(abs(x - 300) <= 36) / count(*) AS m FROM c GROUP BY 1, 2)
SELECT path, page, l > 0.3 AND r > 0.3 AND m <= CASE WHEN page > 1 THEN 0.16 ELSE 0.12 END AS two_columns FROM s""")
def page_layout(spark, d):
    return D.layout(view(spark, d, _CHARS).withColumn("x1", F.col("x0") + 4))


_GRID = "SELECT 'f' || s_nationkey AS path, 1 AS page, CAST(600 AS DOUBLE) AS width, CAST(100 + 10 * i AS DOUBLE) AS x0, CAST(106 + 10 * i AS DOUBLE) AS x1, CAST(2000 - 10 * s_suppkey AS DOUBLE) AS y0, substr('wages', i, 1) AS char, s_suppkey, i FROM supplier, (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 5) WHERE s_suppkey % 9 > 0 OR i < 3"


@query(f"SELECT path, page, string_agg(line, chr(10) ORDER BY s_suppkey) AS text FROM (SELECT path, page, s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'w a' ELSE 'w a g  s' END AS line FROM ({_GRID}) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def page_texts(spark, d):
    return D.page_texts(view(spark, d, _GRID))


# ---- tables as files

_ASSIGN = "SELECT 'T' || p_partkey AS paper_id, p_name AS paper_title, p_type AS subdomain, p_brand AS parent_domain, 'confirmed' AS status, p_size % 2 = 0 AS is_new_subdomain, CASE WHEN p_size > 40 THEN NULL ELSE 'b1' END AS batch_id, CAST(2 AS INTEGER) AS taxonomy_version, 'a \"quoted\", reason' AS reason, CAST(p_size AS DOUBLE) / 4 AS confidence FROM part"


@query(f"""SELECT paper_id, paper_title, subdomain, parent_domain, status, CAST(is_new_subdomain AS VARCHAR) AS is_new_subdomain, batch_id, '2' AS taxonomy_version, reason, CAST(confidence AS VARCHAR) AS confidence,
 '[{{"subject":"' || subdomain || '","relation":"subclass_of","object":"' || parent_domain || '"}}]' AS new_relations FROM ({_ASSIGN.replace(chr(34), chr(34))})""")
def assignment_csv(spark, d):
    a = view(spark, d, _ASSIGN).withColumn("new_relations", F.array(F.struct(F.col("subdomain").alias("subject"), F.lit("subclass_of").alias("relation"), F.col("parent_domain").alias("object"))))
    return _csv(spark, W.assignment_rows(a))


@query(f"""WITH {WITH_CLAIMS} SELECT c.paper_id, 'T' || o_custkey AS paper_title, o_orderpriority AS subdomain, o_orderstatus AS parent_domain, claim_type, subject, relation, object, CAST(NULL AS VARCHAR) AS confidence, nullif(section_title, '') AS section_title, evidence
FROM claims c LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 > 0) ON c.paper_id = CAST(o_orderkey AS VARCHAR)""")
def claims_csv(spark, d):
    p = table(spark, d, "orders").filter("o_orderkey % 4 > 0").select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("T"), "o_custkey").alias("title"), F.col("o_orderpriority").alias("subdomain"), F.col("o_orderstatus").alias("parent_domain"))
    c = claims(spark, d).withColumnRenamed("paper_id", "source_paper_id")
    t = _back(spark, W.claim_rows(c, p), W.write_csv, lambda x: spark.read.csv(x, header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    return t.withColumn("subject", F.when(F.expr("subject = 'This Study'"), " This Study").otherwise(F.col("subject")))


@query("SELECT p_name AS candidate, 'merge' AS action, p_type AS target_subdomain, p_brand AS parent_domain, 'r, ' || p_size AS reason, CAST(p_size AS VARCHAR) AS applied_taxonomy_version FROM part")
def refinement_csv(spark, d):
    p = table(spark, d, "part")
    return _csv(spark, W.refinement_rows(p.select(F.col("p_name").alias("candidate"), F.lit("merge").alias("action"), F.col("p_type").alias("target_subdomain"), F.col("p_brand").alias("parent_domain"), F.concat(F.lit("r, "), "p_size").alias("reason"), F.col("p_size").alias("applied_taxonomy_version"))))


_SMALL = "rel_type IN ('located_in', 'subclass_of')"


def _graph(spark, d):
    """Nodes with labels, and the hierarchy edges under the names of the exports."""
    n = nodes(spark, d).withColumn("labels", F.when(F.col("is_concept"), F.array(F.lit("Entity"), F.lit("Concept"))).otherwise(F.array(F.lit("Entity"))))
    e = edges(spark, d).filter(_SMALL).withColumn("evidence", F.concat(F.expr("repeat('seen ', 50)"), "dst")).withColumn("source_paper", F.lit(None).cast("string"))
    return n, e.withColumn("rel_type", F.when(F.col("rel_type") == "subclass_of", "SUBCLASS_OF").otherwise("TYPE"))


_AROUND = f"""{WITH_EDGES}, {WITH_NODES}, e AS (SELECT src, dst, CASE rel_type WHEN 'subclass_of' THEN 'SUBCLASS_OF' ELSE 'TYPE' END AS rel_type, is_ontology FROM edges WHERE {_SMALL}),
 up AS (SELECT src AS id, rel_type, string_agg(DISTINCT n.name, '; ' ORDER BY n.name) AS names FROM e JOIN nodes n ON dst = n.id GROUP BY 1, 2), down AS (SELECT dst AS id, string_agg(DISTINCT n.name, '; ' ORDER BY n.name) AS names FROM e JOIN nodes n ON src = n.id WHERE rel_type = 'SUBCLASS_OF' GROUP BY 1),
 around AS (SELECT nodes.id, nodes.name, is_concept, coalesce(a.names, '') AS instance_of_concepts, coalesce(b.names, '') AS concept_parent_classes, coalesce(c.names, '') AS concept_child_classes FROM nodes LEFT JOIN up a ON a.id = nodes.id AND a.rel_type = 'TYPE' LEFT JOIN up b ON b.id = nodes.id AND b.rel_type = 'SUBCLASS_OF' LEFT JOIN down c ON c.id = nodes.id)"""


@query(f"""WITH {_AROUND} SELECT 'metadata' AS part, '' || (SELECT count(*) FROM nodes) AS a, '' || (SELECT count_if(is_concept) FROM nodes) AS b, '' || (SELECT count(*) FROM e) AS c, '' || (SELECT count_if(is_ontology) FROM e) AS d
UNION ALL SELECT 'node', id, name, instance_of_concepts, concept_parent_classes || '/' || concept_child_classes FROM around UNION ALL SELECT 'relationship', src, rel_type, dst, '' FROM e""")
def graph_json(spark, d):
    path = scratch.folder(spark, "export")
    (out,) = E.export("json", *_graph(spark, d), path)
    t = spark.read.text(out)
    g = lambda *ks: F.concat_ws("/", *[F.get_json_object("value", f"$.{k}") for k in ks])
    by = lambda *xs: F.when(F.col("part") == "metadata", xs[0]).when(F.col("part") == "node", xs[1]).otherwise(xs[2])
    return t.select("part", by(g("nodes_count"), g("id"), g("src")).alias("a"), by(g("concept_nodes_count"), g("name"), g("rel_type")).alias("b"), by(g("relationships_count"), g("instance_of_concepts"), g("dst")).alias("c"),
                    by(g("ontology_relations_count"), g("concept_parent_classes", "concept_child_classes"), F.lit("")).alias("d"))


@query(f"""WITH {_AROUND} SELECT id AS source_id, '' AS target_id, name AS relation, coalesce(is_concept, false) AS flag, '' AS evidence FROM nodes UNION ALL SELECT src, dst, rel_type, coalesce(is_ontology, false), left(repeat('seen ', 50) || dst, 200) FROM e""")
def graph_simple_json(spark, d):
    path = scratch.folder(spark, "export")
    n, e = (spark.read.json(p) for p in E.export("simple", *_graph(spark, d), path))
    return n.select(F.col("id").alias("source_id"), F.lit("").alias("target_id"), F.col("name").alias("relation"), F.col("is_concept").alias("flag"), F.lit("").alias("evidence")).union(e.select("source_id", "target_id", "relation", "is_ontology", "evidence"))


@query(f"""WITH {_AROUND} SELECT 'CREATE (:' || CASE WHEN is_concept THEN 'Entity:Concept' ELSE 'Entity' END || ' {{id: ''' || id || ''', name: ''' || name || '''}});' AS line FROM nodes
UNION ALL SELECT 'MATCH (a {{id: ''' || src || '''}}), (b {{id: ''' || dst || '''}}) CREATE (a)-[:' || rel_type || ' {{evidence: ''' || left(repeat('seen ', 50), 100) || '''}}]->(b);' FROM e""")
def cypher_text(spark, d):
    (out,) = E.export("cypher", *_graph(spark, d), scratch.folder(spark, "export"))
    return spark.read.text(out).select(F.col("value").alias("line"))


@query(f"""WITH {_AROUND} SELECT src AS source_id, a.name AS source_name, dst AS target_id, b.name AS target_name, rel_type AS relation_type, CAST(is_ontology AS VARCHAR) AS is_ontology, repeat('seen ', 50) || dst AS evidence FROM e LEFT JOIN nodes a ON src = a.id LEFT JOIN nodes b ON dst = b.id""")
def relations_csv(spark, d):
    out = E.export("csv", *_graph(spark, d), scratch.folder(spark, "export"))
    return spark.read.csv(out[1], header=True, escape='"').drop("source_paper_id", "source_paper")


@query(f"""WITH {_AROUND} SELECT id, name, CASE WHEN is_concept THEN 'Entity;Concept' ELSE 'Entity' END AS labels, CAST(coalesce(is_concept, false) AS VARCHAR) AS is_concept, CASE WHEN is_concept THEN 'concept' ELSE 'instance' END AS node_role, nullif(instance_of_concepts, '') AS instance_of_concepts, nullif(concept_parent_classes, '') AS concept_parent_classes, nullif(concept_child_classes, '') AS concept_child_classes FROM around""")
def workbook_nodes(spark, d):
    out = E.export("excel", *_graph(spark, d), scratch.folder(spark, "export"))
    return spark.read.csv(next(p for p in out if p.endswith("/nodes")), header=True, escape='"')


@query(f"WITH {_AROUND} SELECT '1' AS level, src AS subject_id, a.name AS subject_name, rel_type AS relation, dst AS object_id, b.name AS object_name FROM e JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id")
def ontology_csv(spark, d):
    (out,) = E.export("ontology", *_graph(spark, d), scratch.folder(spark, "export"))
    return spark.read.csv(out, header=True, escape='"')


@query(f"WITH {_AROUND} SELECT 'touching' AS kind, src AS subject_id, rel_type AS relation, dst AS object_id FROM e WHERE rel_type = 'TYPE' UNION ALL SELECT 'nodes', id, NULL, NULL FROM nodes WHERE is_concept")
def ontology_fallbacks(spark, d):
    n, e = _graph(spark, d)
    plain = e.filter("rel_type = 'TYPE'").withColumn("rel_type", F.lit("LOCATED_IN"))
    touching = E.ontology_rows(n, plain).filter("level = 2").select(F.lit("touching").alias("kind"), "subject_id", F.lit("TYPE").alias("relation"), "object_id")
    return touching.union(E.ontology_rows(n, plain.limit(0)).filter("level = 3").select(F.lit("nodes"), "subject_id", "relation", "object_id"))


@query("SELECT n_name || '_extraction.ttl' AS file, CAST(n_nationkey % 2 = 0 AS VARCHAR) AS passed, CASE WHEN n_nationkey % 3 = 0 THEN 'fix ' || n_name ELSE '' END AS advice, ':N' || n_nationkey || ' :in :R' || n_regionkey || ' ;' AS turtle, '' || n_regionkey AS region FROM nation")
def turtle_sink(spark, d):
    n = table(spark, d, "nation")
    p = n.select(F.concat("n_name", F.lit(".json")).alias("paper_name"), F.expr("n_nationkey % 2 = 0").alias("passed"), F.when(F.expr("n_nationkey % 3 = 0"), F.concat(F.lit("fix "), "n_name")).otherwise("").alias("suggestions"), F.lit("20240101").alias("timestamp"),
                 F.concat(F.lit(":N"), "n_nationkey", F.lit(" :in :R"), "n_regionkey", F.lit(" ;")).alias("turtle"), F.struct(F.col("n_regionkey").alias("region")).alias("metadata"))
    path = scratch.folder(spark, "turtle")
    W.write_named(W.turtle_files(p), path)
    t = U.files(spark, path).withColumn("file", F.regexp_extract("path", "([^/]+)$", 1))
    got = lambda pattern: F.regexp_extract("text", pattern, 1)
    ttl = t.filter("endswith(file, '.ttl')").select("file", F.lower(got("Passed: (\\w+)")).alias("passed"), got("Suggestions: (.*)").alias("advice"), got("GRAPH =====\\n\\n(.*)").alias("turtle"))
    meta = t.filter("endswith(file, '.json')").select(F.replace("file", F.lit("_metadata.json"), F.lit("_extraction.ttl")).alias("file"), F.get_json_object("text", "$.metadata.region").alias("region"))
    return ttl.join(meta, "file")


@query("SELECT 'p' || n_nationkey AS path, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE CAST(n_nationkey AS DOUBLE) / 2 END AS final_score, coalesce(CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE n_nationkey * 0.5 >= 7 END, false) AS passed, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE 'add ' || n_name END AS key_advice, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE 'a;b;c' END AS fixes FROM nation")
def evaluation_json(spark, d):
    text = """'```json\\n{"final_score": ' || n_nationkey * 0.5 || ', "summary_advice": "add ' || n_name || '", "top_fixes": ["a", "b", "c", "d"]}\\n```'"""
    n = table(spark, d, "nation").select(F.expr("'p' || n_nationkey").alias("path"), F.expr(f"CASE WHEN n_nationkey % 5 = 4 THEN 'no json' ELSE {text} END").alias("response"))
    t = _back(spark, W.evaluation_rows(n, 7.0), lambda x, p: x.write.json(p), lambda p: spark.read.schema("path STRING, final_score DOUBLE, passed BOOLEAN, key_advice STRING, priority_fixes ARRAY<STRING>").json(p))
    return t.select("path", "final_score", "passed", "key_advice", F.array_join("priority_fixes", ";").alias("fixes"))


@query("""WITH q AS (SELECT o_orderpriority AS section, CASE WHEN o_custkey % 4 = 0 THEN 'A' WHEN o_custkey % 4 = 1 THEN 'B' ELSE 'C' END AS answer FROM orders)
SELECT 'Total QA Pairs Generated: ' || count(*) AS line FROM q UNION ALL SELECT '  ' || section || ': ' || count(*) FROM q GROUP BY section
UNION ALL SELECT '  ' || answer || ': ' || count(*) || ' (' || format('{:.1f}', 100.0 * count(*) / (SELECT count(*) FROM q)) || '%)' FROM q GROUP BY answer""")
def question_sinks(spark, d):
    answer = F.expr("CASE WHEN o_custkey % 4 = 0 THEN 'A' WHEN o_custkey % 4 = 1 THEN 'B' ELSE 'C' END")
    q = table(spark, d, "orders").select(F.col("o_orderpriority").alias("section"), F.concat(F.lit("q"), "o_orderkey").alias("question"), F.create_map(F.lit("A"), "o_orderstatus").alias("options"), answer.alias("correct_answer"), F.lit("e").alias("explanation"), F.lit("p").alias("path"))
    path = scratch.folder(spark, "questions")
    W.write_questions(q, path)
    return spark.read.text(f"{path}/stats").select(F.col("value").alias("line"))


@query("SELECT o_orderpriority AS section, 'q' || o_orderkey AS question, o_orderstatus AS a, 'A' AS correct_answer, 'e' AS explanation FROM orders")
def question_rows_json(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderpriority").alias("section"), F.concat(F.lit("q"), "o_orderkey").alias("question"), F.create_map(F.lit("A"), "o_orderstatus").alias("options"), F.lit("A").alias("correct_answer"), F.lit("e").alias("explanation"), F.lit("p").alias("path"))
    path = scratch.folder(spark, "questions")
    W.write_questions(q, path)
    t = spark.read.schema("section STRING, question STRING, options MAP<STRING, STRING>, correct_answer STRING, explanation STRING").json(f"{path}/simplified")
    return t.select("section", "question", F.col("options")["A"].alias("a"), "correct_answer", "explanation")


@query("SELECT DISTINCT predicate FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'increased' WHEN 1 THEN 'zzz' || p_size WHEN 2 THEN 'treated' ELSE 'qq' || (p_size % 10) END AS predicate FROM part) WHERE predicate LIKE 'zzz%' OR predicate LIKE 'qq%'")
def unknown_predicates(spark, d):
    t = view(spark, d, "SELECT CASE p_size % 4 WHEN 0 THEN 'increased' WHEN 1 THEN 'zzz' || p_size WHEN 2 THEN 'treated' ELSE 'qq' || (p_size % 10) END AS predicate FROM part")
    return _csv(spark, P.unknown_predicates(t, R.GROUPS))


@query("""WITH r AS (SELECT p_brand AS s, p_type AS o, p_partkey AS ord, repeat('x', p_size) AS context FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY s, o ORDER BY length(context) DESC, ord) AS k, count(*) OVER (PARTITION BY s, o) AS f FROM r),
 u AS (SELECT ':' || array_to_string(list_transform(string_split(regexp_replace(s, '[^A-Za-z0-9 ]', '', 'g'), ' '), lambda w: upper(w[1]) || w[2:]), '_') AS s, ':' || array_to_string(list_transform(string_split(o, ' '), lambda w: upper(w[1]) || w[2:]), '_') AS o, context, f FROM b WHERE k = 1)
SELECT '- **' || s || '** :Is_In **' || o || '** (frequency ' || f || '): ' || context AS line FROM u""")
def representative_report(spark, d):
    p = table(spark, d, "part")
    r = p.select(F.col("p_brand").alias("subject"), F.lit("is in").alias("predicate"), F.col("p_type").alias("object"), F.expr("repeat('x', p_size)").alias("context"), F.col("p_partkey").alias("ord"), F.lit("s").alias("section"), F.lit("1").alias("chunk"), F.col("p_name").alias("paper"))
    return _back(spark, W.representative_report(W.representative_rows(r, r)), W.write_text, lambda x: spark.read.text(x).select(F.col("value").alias("line")))


@query("SELECT o_orderkey AS paper_id, 'q' AS question, 'm' AS model, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS response FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'q', 'm', 'new' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = 0")
def merged_results(spark, d):
    row = lambda cond, r: table(spark, d, "orders").filter(cond).select(F.col("o_orderkey").alias("paper_id"), F.lit("q").alias("question"), F.lit("m").alias("model"), F.lit(r).alias("response"))
    return W.merge_results(row("o_orderkey % 2 = 0", "old"), row("o_orderkey % 3 = 0", "new"))


@query("SELECT 'orders' AS stage, o_custkey AS paper_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders WHERE o_custkey < 40 GROUP BY 2 UNION ALL SELECT 'nation', n_regionkey, count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation GROUP BY 2")
def stage_files(spark, d):
    path = scratch.folder(spark, "stages")
    W.write_stages({"orders": table(spark, d, "orders").filter("o_custkey < 40").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").cast("long").alias("k")), "nation": table(spark, d, "nation").select(F.col("n_regionkey").alias("paper_id"), F.col("n_nationkey").cast("long").alias("k"))}, path)
    return spark.read.option("basePath", path).schema("k BIGINT, stage STRING, paper_id BIGINT").json(f"{path}/stage=*").groupBy("stage", "paper_id").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("SELECT count(*) AS total_papers, count_if(o_orderstatus = 'F') AS total_completed, round(100.0 * count_if(o_orderstatus = 'F') / count(*), 6) AS success_rate FROM orders")
def report_json(spark, d):
    t = P.run_totals(table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("batch_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started"), F.col("o_orderdate").cast("timestamp").alias("ended")))
    return _back(spark, t, W.write_report, lambda p: spark.read.json(p)).select("total_papers", "total_completed", F.round("success_rate", 6).alias("success_rate"))


@query(f"WITH {WITH_CLAIMS} SELECT claim_ord, subject, relation, object, nullif(section_title, '') AS section_title FROM claims")
def serialised_claims(spark, d):
    c = claims(spark, d).select("claim_ord", "subject", "relation", "object", F.nullif("section_title", F.lit("")).alias("section_title"))
    t = _back(spark, W.serialised(c), W.write_text, lambda p: spark.read.text(p))
    return t.select(F.from_json("value", c.schema).alias("r")).select("r.*")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey BETWEEN 10 AND 40")
def sorted_lookup(spark, d):
    path = scratch.folder(spark, "sorted")
    W.write_sorted(table(spark, d, "part"), path, "p_partkey")
    return spark.read.parquet(path).filter("p_partkey BETWEEN 10 AND 40").select("p_partkey", "p_name")


@query("SELECT 'paper_' || p_partkey AS paper_id FROM part WHERE p_size % 3 > 0")
def resume_pending(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("paper_"), "p_partkey").alias("paper_id"), "p_size")
    done = _back(spark, p.filter("p_size % 3 = 0").select("paper_id", F.lit("x").alias("question")), lambda t, x: t.write.json(x), lambda x: spark.read.json(x))
    return I.pending(p, done).select("paper_id")


# ---- settings and files


def _settings(spark, d, dialect, name):
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # settings are a driver's; the nations stand for a file of 25 keys
    text = json.dumps({f"k{r.n_nationkey}": name.format(r.n_nationkey) for r in rows})
    env = {f"N{r.n_nationkey}": r.n_name for r in rows if r.n_nationkey % 2 == 0}
    return spark.createDataFrame(list(settings.load(text, env, dialect).items()), "key STRING, value STRING")


@query("SELECT 'k' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'd' || n_nationkey END || '/' || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS value FROM nation")
def settings_defaults(spark, d):
    return _settings(spark, d, settings.expand, "${{N{0}:-d{0}}}/${{N{0}}}")


@query("SELECT 'k' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '/' || n_name ELSE '$N' || n_nationkey || '/${N' || n_nationkey || '}' END AS value FROM nation")
def settings_shell(spark, d):
    return _settings(spark, d, settings.expand_shell, "$N{0}/${{N{0}}}")


@query("SELECT CASE WHEN n_regionkey % 2 = 0 THEN r_name END AS category, n_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 3 UNION ALL SELECT NULL, 'default' FROM region WHERE r_regionkey = 3")
def prompt_examples(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_regionkey", "r_name", "n_name").collect()  # a prompt's examples are few
    out = []
    for k in sorted({r.n_regionkey for r in rows}):
        mine = [{"text": r.n_name} for r in rows if r.n_regionkey == k]
        given = {r.r_name: mine for r in rows if r.n_regionkey == k} if k % 2 == 0 else [{"text": "五脏"}] if k == 3 else mine
        out += settings.examples(json.dumps(given), [{"text": "default"}])
    return spark.createDataFrame([(x.get("category"), x["text"]) for x in out], "category STRING, text STRING")


@query("SELECT 'n' || n_nationkey || '.txt' AS file, CAST(length(n_name) + 1 AS BIGINT) AS size_bytes, round((length(n_name) + 1) / 1048576, 2) AS size_mb FROM nation")
def file_stats(spark, d):
    path = scratch.folder(spark, "files")
    W.write_named(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".txt")).alias("name"), F.col("n_name").alias("value")), path)
    return U.file_stats(spark, path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "size_bytes", "size_mb")
