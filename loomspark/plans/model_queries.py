"""Queries of reports, vectors, model answers, taxonomy fallbacks, and of state between runs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import claims as C
from ..operators import judge as J
from ..operators import matching as M
from ..operators import reports as P
from ..operators import taxonomy as T
from ..operators import vectors as V
from ..sources import scratch
from ..sources import writers as W
from ..streaming import ingest as I
from ..streaming import state as B
from .queries import ROUTE_SQL, WITH_CLAIMS, WITH_EDGES
from .registry import query, table
from .testmap import claims, edges, view

# ---- reports

_RUN = "SELECT l_orderkey AS paper_id, count(*) AS extracted, count_if(l_returnflag <> 'R' OR l_linenumber > 2) AS grounded, count_if(l_returnflag <> 'R') AS validated, count_if(l_returnflag = 'N') AS written FROM lineitem GROUP BY 1"


@query(f"""WITH t AS (SELECT paper_id % 100 AS grp, sum(extracted) AS e, sum(grounded) AS g, sum(validated) AS v, sum(written) AS w FROM ({_RUN}) GROUP BY 1)
SELECT grp, CAST(1 AS DOUBLE) AS extraction_rate, round(g / e, 6) AS grounding_rate, CASE WHEN g = 0 THEN 0 ELSE round(v / g, 6) END AS validation_rate, CASE WHEN v = 0 THEN 0 ELSE round(w / v, 6) END AS writing_rate, round(w / e, 6) AS overall_success_rate FROM t""")
def pipeline_efficiency(spark, d):
    t = P.efficiency(view(spark, d, _RUN).withColumn("grp", F.col("paper_id") % 100), "grp")
    return t.select("grp", *[F.round(c, 6).alias(c) for c in t.columns[1:]])


@query(f"WITH {WITH_EDGES} SELECT count(*) AS total_relations, count(DISTINCT rel_type) AS unique_relation_types, count(DISTINCT rel_type) / count(*) AS relation_diversity FROM edges")
def relation_distribution(spark, d):
    return P.relation_distribution(edges(spark, d), "rel_type")


@query("SELECT l_shipdate AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, min(l_orderkey * 10 + l_linenumber), value LIMIT 10")
def most_common(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_shipdate").alias("value"), F.expr("l_orderkey * 10 + l_linenumber").alias("ord"))
    return P.most_common(t, "value", 10, "ord")


@query(f"""WITH {WITH_EDGES}, f AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)
SELECT count(*) AS total_unique_entities, CAST(sum(n) // 2 AS BIGINT) AS total_relationships, count_if(n = 1) AS single, count_if(n > 1) AS multiple, round(2 * (sum(n) // 2) / count(*), 6) AS avg_relationships_per_entity FROM f""")
def entity_coverage(spark, d):
    return P.entity_coverage(edges(spark, d), ("src", "dst")).withColumn("avg_relationships_per_entity", F.round("avg_relationships_per_entity", 6))


@query(f"SELECT paper_id, written AS claims_per_paper, round(validated / extracted, 6) AS validation_rate, round(100.0 * written / sum(written) OVER (), 9) AS contribution_percentage FROM ({_RUN})")
def paper_contribution(spark, d):
    return P.paper_contribution(view(spark, d, _RUN)).withColumn("validation_rate", F.round("validation_rate", 6)).withColumn("contribution_percentage", F.round("contribution_percentage", 9))


@query("""WITH c AS (SELECT l_orderkey AS paper_id, CASE l_linenumber % 4 WHEN 0 THEN 'extracted' WHEN 1 THEN 'grounded' WHEN 2 THEN 'validated' ELSE 'rejected' END AS status, l_returnflag = 'N' AS written FROM lineitem), t AS (SELECT l_orderkey AS paper_id, sum(l_quantity) AS total_time FROM lineitem WHERE l_linenumber < 3 GROUP BY 1)
SELECT paper_id, count(*) AS extracted, count_if(status <> 'extracted') AS grounded, count_if(status = 'validated') AS validated, count_if(written) AS written, any_value(total_time) AS total_time FROM c LEFT JOIN t USING (paper_id) GROUP BY 1""")
def stage_counters(spark, d):
    li = table(spark, d, "lineitem")
    status = F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'extracted' WHEN 1 THEN 'grounded' WHEN 2 THEN 'validated' ELSE 'rejected' END")
    c = li.select(F.col("l_orderkey").alias("source_paper_id"), status.alias("status"), F.expr("l_returnflag = 'N'").alias("written"))
    return P.stage_counters(c, li.filter("l_linenumber < 3").select(F.col("l_orderkey").alias("paper_id"), F.col("l_quantity").alias("seconds")))


@query("""SELECT CASE grouping(event_type, user_id) WHEN 0 THEN 'paper' WHEN 1 THEN 'agent' ELSE 'total' END AS level, event_type AS agent, user_id AS paper, round(sum(value), 4) AS total, count(*) AS calls FROM events GROUP BY ROLLUP (event_type, user_id)""")
def stage_timing_rollup(spark, d):
    t = P.timing_rollup(table(spark, d, "events").select(F.col("event_type").alias("agent"), F.col("user_id").alias("paper"), F.col("value").alias("seconds")))
    return t.withColumn("total", F.round("total", 4)).drop("avg")


_SAID = "SELECT o_orderkey % 5 AS model, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE left('ABCD', 1 + CAST(o_orderkey % 2 AS INTEGER)) END AS said, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'AB' END AS correct FROM orders"


@query(f"SELECT model, count(*) AS total, count(said) AS answered, count_if(said = correct) AS correct, round(count_if(said = correct) / count(*), 6) AS accuracy FROM ({_SAID}) GROUP BY 1")
def answer_accuracy(spark, d):
    a = view(spark, d, _SAID).select("model", F.col("said").alias("extracted_answer"), F.col("correct").alias("correct_answer"))
    return P.model_accuracy(a).withColumn("accuracy", F.round("accuracy", 6))


@query("""SELECT o_custkey % 50 AS batch_id, count(*) AS total_papers, count_if(o_orderstatus = 'F') AS completed, count_if(o_orderstatus = 'P') AS failed, count_if(o_orderstatus = 'O') AS in_progress, round(count_if(o_orderstatus = 'F') / count(*), 6) AS success_rate, round(avg(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END), 4) AS average_score, count_if(o_orderstatus = 'O') = 0 AS is_complete FROM orders GROUP BY 1""")
def batch_summary(spark, d):
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'in_progress' END")
    t = P.batch_summary(table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("batch_id"), status.alias("status"), F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END").alias("score")))
    return t.withColumn("success_rate", F.round("success_rate", 6)).withColumn("average_score", F.round("average_score", 4))


@query(f"WITH {WITH_CLAIMS} SELECT subject, relation AS predicate, object, count(*) AS n FROM claims GROUP BY 1, 2, 3 ORDER BY n DESC, min(claim_ord) LIMIT 150")
def relation_frequency_top(spark, d):
    return P.relation_frequency(claims(spark, d).select("subject", F.col("relation").alias("predicate"), "object", F.col("claim_ord").alias("ord")), 150)


@query(f"WITH {WITH_CLAIMS} SELECT subject, relation AS predicate, object, count(*) AS n FROM claims GROUP BY 1, 2, 3")
def relation_frequency(spark, d):
    return P.relation_frequency(claims(spark, d).select("subject", F.col("relation").alias("predicate"), "object", F.col("claim_ord").alias("ord")))


_ROWS = """SELECT CASE p_partkey % 4 WHEN 0 THEN '概念' ELSE '关系' END AS kind, CASE p_partkey % 5 WHEN 0 THEN p_name || '|is' WHEN 1 THEN p_name || ' | is | ' WHEN 2 THEN NULL ELSE p_name || '|is|' || p_brand || '|x' END AS name, CASE WHEN p_size > 45 THEN NULL ELSE 'note' END AS note FROM part"""


@query(f"""WITH r AS ({_ROWS}), t AS (SELECT *, kind = '关系' AND name IS NOT NULL AND note IS NOT NULL AS rel, list_transform(string_split(name, '|'), lambda x: trim(x)) AS p FROM r)
SELECT count(*) AS total_rows, count_if(rel) AS relation_rows, count_if(name IS NULL OR note IS NULL) AS skipped_rows, count_if(rel AND (len(p) < 3 OR p[2] = '' OR array_to_string(p[3:], '|') = '')) AS parse_errors, count_if(rel) - count_if(rel AND (len(p) < 3 OR p[2] = '' OR array_to_string(p[3:], '|') = '')) AS output_rows FROM t""")
def transform_stats(spark, d):
    return P.transform_stats(view(spark, d, _ROWS).toDF("类型", "名称", "片段"))


@query("SELECT event_type, count(*) AS total, count_if(value > 50) AS hits, count_if(NOT value > 50) AS misses, round(count_if(value > 50) / count(*), 6) AS hit_rate FROM events GROUP BY 1")
def cache_counters(spark, d):
    return P.cache_counters(table(spark, d, "events").select("event_type", (F.col("value") > 50).alias("hit")), "event_type").withColumn("hit_rate", F.round("hit_rate", 6))


@query("SELECT o_orderkey, unnest(['m1', 'm2', 'm3']) AS model FROM orders")
def qa_model_cross(spark, d):
    return P.question_tasks(table(spark, d, "orders").select("o_orderkey"), ["m1", "m2", "m3"])


# ---- vectors

_D2 = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2])))"


def _ranked(cond: str) -> str:
    return f"SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank, d FROM (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, {_D2} AS d FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND {cond})"


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v"))


@query(f"SELECT query_id, vec_id, rank, round(d, 5) AS d FROM ({_ranked('true')}) WHERE rank <= 5")
def vector_topk(spark, d):
    return V.top_k(*_vectors(spark, d), 5).select("query_id", "vec_id", "rank", F.round("d", 5).alias("d"))


@query(f"SELECT query_id, CASE WHEN d < 1.3 THEN 'v' || vec_id ELSE 'new' || query_id END AS entity_id, NOT d < 1.3 AS is_new FROM ({_ranked('q.vec_id <> v.vec_id')}) WHERE rank = 1")
def vector_top1_resolve(spark, d):
    return V.resolve(*_vectors(spark, d), 1.3, but_itself=True)


@query("SELECT CASE WHEN vec_id % 3 = 0 THEN vec_id ELSE (SELECT max(vec_id) FROM embeddings WHERE vec_id % 3 = 0) + row_number() OVER (PARTITION BY vec_id % 3 = 0 ORDER BY 'n' || vec_id) END AS vec_id, 'n' || vec_id AS name, embedding[1] AS first FROM embeddings")
def vectors_added(spark, d):
    e = table(spark, d, "embeddings").withColumn("name", F.concat(F.lit("n"), "vec_id")).withColumn("v", F.col("embedding").cast("array<float>"))
    return V.added(e.filter("vec_id % 3 = 0"), e.filter("vec_id % 3 != 0")).select("vec_id", "name", F.get("v", F.lit(0)).alias("first"))


@query("SELECT 'full' AS kind, count(*) AS n FROM embeddings UNION ALL SELECT 'empty', 0")
def vector_sizes(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.lit("x").alias("name"), F.col("embedding").alias("v"))
    return V.size(V.added(V.empty(spark), e)).select(F.lit("full").alias("kind"), "n").union(V.size(V.empty(spark)).select(F.lit("empty"), "n"))


@query("SELECT DISTINCT 'L' || label AS name, first FROM (SELECT label, min(embedding[1]) OVER (PARTITION BY label) AS first FROM embeddings) UNION ALL SELECT 'unknown', NULL")
def embedded_names(spark, d):
    e = table(spark, d, "embeddings").select(F.concat(F.lit("L"), "label").alias("name"), F.col("embedding").alias("v"))
    names = e.select("name").union(spark.range(2).select(F.lit("unknown").alias("name")))
    return V.embedded(names, e).select("name", F.get("v", F.lit(0)).alias("first"))


# ---- model answers

_BODIES = """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '[{"id":"m","content":[{"type":"x"},{"text":"' || p_name || '"}]}]' WHEN 1 THEN '{"choices":[{"message":{"content":"' || p_name || '"}}]}' WHEN 2 THEN '{"output":[{"content":[{"text":"' || p_name || '"}]}]}' WHEN 3 THEN '{"output":"' || p_name || '"}' WHEN 4 THEN '{"content":"' || p_name || '"}'
 WHEN 5 THEN '{"text":"' || p_name || '"}' WHEN 6 THEN '{"odd":1}' ELSE 'plain ' || p_name END AS body FROM part"""


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 6 THEN '{\"odd\":1}' WHEN 7 THEN 'plain ' || p_name ELSE p_name END AS text FROM part")
def response_texts(spark, d):
    return view(spark, d, _BODIES).select("p_partkey", J.response_text(F.col("body")).alias("text"))


@query("SELECT p_partkey, 'm1' AS model, 'sys' AS system, p_name AS content, '8192' AS max_tokens, 'json_object' AS format FROM part")
def chat_requests(spark, d):
    b = table(spark, d, "part").select("p_partkey", J.chat_body("m1", F.col("p_name"), "sys", json_mode=True).alias("b"))
    g = lambda p: F.get_json_object("b", p)
    return b.select("p_partkey", g("$.model").alias("model"), g("$.messages[0].content").alias("system"), g("$.messages[1].content").alias("content"), g("$.max_tokens").alias("max_tokens"), g("$.response_format.type").alias("format"))


@query("SELECT p_partkey, upper(p_name || ' ' || p_size) AS response FROM part")
def remote_answers(spark, d):
    p = J.with_hash(table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_size").alias("payload")))
    a = J.remote(p, lambda xs: [x.upper() for x in xs])
    return p.join(a, "prompt_hash").select("p_partkey", "response")


_VERDICTS = """SELECT '' || p_partkey AS prompt_hash, CASE p_partkey % 4 WHEN 0 THEN '{"valid": true, "confidence": 0.' || (p_size % 10) || ', "reasoning": "' || p_name || '"}' WHEN 1 THEN '```json{"valid": false}```' WHEN 2 THEN 'API Error: timeout' ELSE '{"confidence": 0.5, "reasoning": "r"}' END AS response FROM part"""


@query("""SELECT '' || p_partkey AS prompt_hash, p_partkey % 4 = 0 AS valid, CASE p_partkey % 4 WHEN 0 THEN (p_size % 10) / 10 WHEN 3 THEN 0.5 ELSE 0.0 END AS confidence, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 3 THEN 'r' ELSE 'Error: no judgement' END AS reasoning FROM part""")
def judge_verdicts(spark, d):
    return J.verdicts(view(spark, d, _VERDICTS))


@query("SELECT '' || p_partkey AS prompt_hash, true AS valid, CAST(0.9 AS DOUBLE) AS confidence, 'mock_reasoning' AS reasoning FROM part")
def mock_verdicts(spark, d):
    return J.verdicts(J.mock(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("prompt_hash"))))


_GROUNDED = """SELECT '' || p_partkey AS prompt_hash, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN '{"' || p_name || '": "ent_' || p_size || '"}' WHEN 1 THEN '{"other": "x"}' ELSE 'none' END AS response FROM part"""


@query("SELECT '' || p_partkey AS prompt_hash, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'ent_' || p_size END AS entity_id FROM part")
def judge_groundings(spark, d):
    t = view(spark, d, _GROUNDED)
    return J.grounded_names(t.select("prompt_hash", "response"), t.select("prompt_hash", "name"))


_MERGES = """SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN '{"decision": "Merge", "entity_id": "e' || p_size || '"}' WHEN 1 THEN '{"decision": "merge"}' WHEN 2 THEN '{"decision": "keep", "entity_id": "e1"}' ELSE 'x' END AS response FROM part"""


@query("SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN 'merge' ELSE 'new' END AS decision, CASE p_partkey % 4 WHEN 0 THEN 'e' || p_size END AS entity_id FROM part")
def merge_decisions(spark, d):
    return J.merge_decisions(view(spark, d, _MERGES))


_LISTS = """SELECT paper_id, batch, CASE batch % 3 WHEN 0 THEN '[' || array_join(transform(sequence(1, 2), x -> '{"valid": true, "type": "support", "confidence": 0.' || x || '}'), ',') || ']' WHEN 1 THEN '```json\\n[{"valid": false, "confidence": 0.4}]\\n```' ELSE 'broken' END AS response FROM b"""


@query(f"""WITH {WITH_CLAIMS}, k AS (SELECT *, (row_number() OVER (PARTITION BY paper_id ORDER BY claim_ord) - 1) // 3 AS batch, (row_number() OVER (PARTITION BY paper_id ORDER BY claim_ord) - 1) % 3 AS pos FROM claims),
 w AS (SELECT *, CASE WHEN subject_id = object_id THEN 'self_loop' WHEN lower(subject) = lower(object) THEN 'same_entity' WHEN regexp_matches(subject, '^({'|'.join(C.NAME_BLACKLIST)})|({'|'.join(C.NAME_BLACKLIST)})$') THEN 'invalid_subject' WHEN regexp_matches(object, '^({'|'.join(C.NAME_BLACKLIST)})|({'|'.join(C.NAME_BLACKLIST)})$') THEN 'invalid_object' END AS why FROM k)
SELECT claim_ord, CASE WHEN why IS NULL AND batch % 3 = 0 AND pos < 2 THEN 'validated' ELSE 'rejected' END AS status, coalesce(why, CASE WHEN batch % 3 = 0 AND pos < 2 THEN 'support' WHEN batch % 3 = 1 AND pos = 0 THEN 'new' ELSE 'format_error' END) AS validation_type,
 CASE WHEN why IS NOT NULL THEN 0.0 WHEN batch % 3 = 0 AND pos < 2 THEN (pos + 1) / 10 WHEN batch % 3 = 1 AND pos = 0 THEN 0.4 ELSE 0.0 END AS confidence FROM w""")
def batch_validation(spark, d):
    c = claims(spark, d)
    b = J.batched(c, 3)
    two = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2)), lambda x: F.concat(F.lit('{"valid": true, "type": "support", "confidence": 0.'), x, F.lit("}"))), ",")
    r = F.when(F.col("batch") % 3 == 0, F.concat(F.lit("["), two, F.lit("]"))).when(F.col("batch") % 3 == 1, '```json\n[{"valid": false, "confidence": 0.4}]\n```').otherwise("broken")
    v = J.positional(b, b.select("paper_id", "batch", r.alias("response")), "paper_id", "batch")
    return J.validated(c, v).select("claim_ord", "status", "validation_type", "confidence")


@query(f"WITH {WITH_CLAIMS} SELECT CAST(c.claim_ord AS BIGINT) AS claim_ord FROM claims c WHERE md5(concat_ws('|', subject, relation, object, paper_id)) NOT IN (SELECT md5(concat_ws('|', subject, relation, object, paper_id)) FROM claims WHERE claim_ord % 3 = 0)")
def uncached_claims(spark, d):
    c = claims(spark, d).withColumn("source_paper_id", F.col("paper_id"))
    key = X.fingerprint(*[F.coalesce(F.col(k), F.lit("")) for k in ("subject", "relation", "object", "source_paper_id")])
    return J.uncached(c, c.filter("claim_ord % 3 = 0").select(key.alias("fingerprint"))).select("claim_ord")


@query(f"""WITH {WITH_CLAIMS}, w AS (SELECT CASE WHEN subject_id = object_id THEN 'self_loop' WHEN lower(subject) = lower(object) THEN 'same_entity' WHEN regexp_matches(subject, '^({'|'.join(C.NAME_BLACKLIST)})|({'|'.join(C.NAME_BLACKLIST)})$') THEN 'invalid_subject' WHEN regexp_matches(object, '^({'|'.join(C.NAME_BLACKLIST)})|({'|'.join(C.NAME_BLACKLIST)})$') THEN 'invalid_object' END AS why FROM claims)
SELECT count(*) AS total, count_if(why IS NULL) AS validated, count_if(why IS NOT NULL) AS rejected, count_if(why = 'self_loop') AS self_loop, count_if(why = 'same_entity') AS same_entity, count_if(why = 'invalid_subject') AS invalid_subject, count_if(why = 'invalid_object') AS invalid_object, CAST(0 AS BIGINT) AS format_error FROM w""")
def validation_counters(spark, d):
    return P.validation_counters(J.validated(claims(spark, d)))


_QUESTIONS = """SELECT p_type AS section, CASE p_partkey % 4 WHEN 0 THEN '```json\\n{"question":"Q ' || p_name || '","options":{"A":"' || p_brand || '"},"correct_answer":"A","explanation":"e"}\\n```' WHEN 1 THEN '{"question":"Q","options":{"A":"x"},"correct_answer":"A"}' WHEN 2 THEN 'none' ELSE '{"question":"R ' || p_name || '","options":{"A":"y"},"correct_answer":"B","explanation":"f"}' END AS response FROM part"""


@query("SELECT p_type AS section, CASE p_partkey % 4 WHEN 0 THEN 'Q ' ELSE 'R ' END || p_name AS question, CASE p_partkey % 4 WHEN 0 THEN p_brand ELSE 'y' END AS a, CASE p_partkey % 4 WHEN 0 THEN 'A' ELSE 'B' END AS correct_answer FROM part WHERE p_partkey % 4 IN (0, 3)")
def generated_questions(spark, d):
    return W.question_rows(view(spark, d, _QUESTIONS)).select("section", "question", F.col("options")["A"].alias("a"), "correct_answer")


_ITEMS = """SELECT '' || p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'no' ELSE '{"items":[{"类型":"关系","名称":" ' || p_name || ' ","片段":"n"},{"类型":"其他","名称":"x","片段":"y"},{"类型":"概念","名称":"' || p_brand || '","片段":"' || CASE WHEN p_size % 2 = 0 THEN '' ELSE 'm' END || '"},7]}' END AS response FROM part"""


@query("SELECT '' || p_partkey AS path, 0 AS pos, '关系' AS kind, p_name AS name, 'n' AS note FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT '' || p_partkey, 2, '概念', p_brand, 'm' FROM part WHERE p_partkey % 5 > 0 AND p_size % 2 = 1")
def mentor_items(spark, d):
    return J.triples_from(view(spark, d, _ITEMS))


@query("""WITH q AS (SELECT '' || o_orderkey AS paper_id, o_orderkey, unnest(['m1', 'm2']) AS model FROM orders WHERE o_orderkey % 5 > 0)
SELECT paper_id, model, CASE WHEN model = 'm2' AND o_orderkey % 2 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'C' END AS extracted_answer, NOT (model = 'm2' AND o_orderkey % 2 = 0) AND o_orderkey % 3 = 0 AS is_correct FROM q""")
def benchmark_run(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("paper_id"), F.lit("q").alias("question"), F.lit("A").alias("correct_answer"), "o_orderkey")
    said = F.when((F.col("model") == "m2") & F.expr("o_orderkey % 2 = 0"), "it is unclear").when(F.expr("o_orderkey % 3 = 0"), "答案是 A").otherwise("c.")
    out = B.benchmark(q, q.filter("o_orderkey % 5 = 0"), ["m1", "m2"], lambda t: t.withColumn("response", said), X.extract_answer)
    return out.select("paper_id", "model", "extracted_answer", "is_correct")


# ---- taxonomy without a model

_EDGES = "SELECT p_type || ' .' AS child, CASE WHEN p_size % 9 = 0 THEN '' ELSE replace(p_brand, '#', '_') END AS parent, p_partkey AS ord FROM part"
_N = r"trim(regexp_replace(replace(lower({0}), '_', ' '), '\s+', ' ', 'g'), ' .;:,')"


@query(f"""WITH e AS ({_EDGES}), l AS (SELECT {_N.format('child')} AS name, 2 * ord AS ord FROM e UNION ALL SELECT {_N.format('parent')}, 2 * ord + 1 FROM e UNION ALL SELECT 'biomedicine', -1) SELECT name, min(ord) AS ord FROM l WHERE name <> '' GROUP BY 1""")
def known_labels(spark, d):
    return T.known_labels(view(spark, d, _EDGES), "Biomedicine")


@query(f"WITH e AS (SELECT {_N.format('child')} AS child, {_N.format('parent')} AS parent, ord FROM ({_EDGES})) SELECT child, arg_min(parent, ord) AS parent FROM e WHERE child <> '' AND parent <> '' GROUP BY 1")
def first_parents(spark, d):
    return T.first_parents(view(spark, d, _EDGES))


_RULE_ROWS = [("oncology", "Cancer Immunotherapy", ("th", "PD-1", "er")), ("pathology", "Molecular_Pathology", ("eau", "ion")), ("law", "Courts", ("sch", "ung", "lich"))]
_KEYED = "SELECT doc_id AS paper_id, CASE doc_id % 9 WHEN 0 THEN 'A tumor' WHEN 1 THEN 'Fetal_care' WHEN 2 THEN 'a virus' WHEN 3 THEN 'zzz' ELSE text END AS text FROM documents"


@query(f"""WITH n AS (SELECT paper_id, {_N.format('text')} AS t FROM ({_KEYED})), s AS (SELECT *, CAST(contains(t, 'th') AS INTEGER) + CAST(contains(t, 'pd-1') AS INTEGER) + CAST(contains(t, 'er') AS INTEGER) AS a, CAST(contains(t, 'eau') AS INTEGER) + CAST(contains(t, 'ion') AS INTEGER) AS b, CAST(contains(t, 'sch') AS INTEGER) + CAST(contains(t, 'ung') AS INTEGER) + CAST(contains(t, 'lich') AS INTEGER) AS c FROM n), g AS (SELECT *, greatest(a, b, c) AS score FROM s)
SELECT paper_id, CASE WHEN score = 0 THEN CASE WHEN regexp_matches(t, 'cancer|tumor|carcinoma') THEN 'cancer biology and therapy' WHEN regexp_matches(t, 'pregnan|maternal|fetal') THEN 'maternal-fetal medicine' WHEN regexp_matches(t, 'infection|virus|bacterial') THEN 'clinical infectious diseases' ELSE 'general clinical medicine' END WHEN a = score THEN 'cancer immunotherapy' WHEN b = score THEN 'molecular pathology' ELSE 'courts' END AS subdomain,
 CASE WHEN score = 0 THEN CASE WHEN regexp_matches(t, 'cancer|tumor|carcinoma') THEN 'oncology' WHEN regexp_matches(t, 'pregnan|maternal|fetal') THEN 'obstetrics and gynecology' WHEN regexp_matches(t, 'infection|virus|bacterial') THEN 'infectious diseases' END WHEN a = score THEN 'oncology' WHEN b = score THEN 'pathology' ELSE 'law' END AS parent_domain, score, CAST(CASE WHEN score > 0 THEN 0.4 ELSE 0.25 END AS DOUBLE) AS confidence FROM g""")
def keyword_fallback(spark, d):
    return T.keyword_scores(view(spark, d, _KEYED), _RULE_ROWS)


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 's>up;' ELSE 's>up;t>' || lower(p_brand) || ';' END ELSE CASE WHEN p_size % 3 = 0 THEN '' ELSE 't>' || lower(p_brand) || ';' END END AS x FROM part""")
def relation_lists(spark, d):
    r = lambda s, rel, o: F.struct(F.lit(s).alias("subject"), F.lit(rel).alias("relation"), o.alias("object"))
    own = F.array(r("T.", "subclass_of", F.col("p_brand")), r("t", "Subclass_Of", F.col("p_brand")), r("t", "part_of", F.col("p_brand")), r("t", "subclass_of", F.lit(" T ")), r("", "subclass_of", F.col("p_brand")))
    given = F.when(F.expr("p_size % 3 = 0"), F.lit(None).cast("array<struct<subject:string,relation:string,object:string>>")).otherwise(own)
    out = T.relations_of(F.lit("s"), F.lit("up"), F.expr("p_size % 2 = 1"), given)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(out, lambda x: F.concat(x.subject, F.lit(">"), x.object, F.lit(";"))), "").alias("x"))


_CLASSIFIED = "SELECT '' || p_partkey AS paper_id, p_type || CASE WHEN p_size % 2 = 0 THEN '.' ELSE ' odd label' END AS label, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_brand END AS parent, CAST(p_size AS DOUBLE) / 25 - 0.2 AS confidence FROM part"
_KNOWN_TYPES = "SELECT p_type AS name, CAST(min(p_partkey) AS BIGINT) AS ord FROM part GROUP BY 1"


@query(f"""WITH p AS ({_CLASSIFIED}), k AS ({_KNOWN_TYPES}), lab AS (SELECT DISTINCT label FROM p), m AS (SELECT label, name, ord, {_N.format('label')} AS a, {_N.format('name')} AS b FROM lab, k),
 t AS (SELECT *, list_distinct(regexp_extract_all(a, '[a-z0-9]+')) AS ta, list_distinct(regexp_extract_all(b, '[a-z0-9]+')) AS tb FROM m),
 s AS (SELECT label, name, ord, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b)) ELSE greatest(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), len(list_intersect(ta, tb)) / least(len(ta), len(tb))) END AS score FROM t),
 best AS (SELECT label, name FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, ord) AS rn FROM s WHERE score >= 0.72) WHERE rn = 1)
SELECT paper_id, coalesce(name, label) AS subdomain, coalesce(nullif(trim(parent), ''), 'root') AS parent_domain, round(greatest(0, least(1, confidence)), 6) AS confidence, CASE WHEN name IS NULL THEN 'candidate' ELSE 'confirmed' END AS status FROM p LEFT JOIN best USING (label)""")
def classified_papers(spark, d):
    return T.classify(view(spark, d, _CLASSIFIED), view(spark, d, _KNOWN_TYPES), "root").withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH c AS (SELECT DISTINCT p_type || CASE WHEN p_size % 2 = 0 THEN ' .' ELSE ' new' END AS candidate, '' AS parent FROM part), k AS (SELECT {_N.format('name')} AS n, arg_max(name, ord) AS target FROM ({_KNOWN_TYPES}) GROUP BY 1)
SELECT candidate, CASE WHEN target IS NULL THEN 'promote' ELSE 'merge' END AS action, coalesce(target, candidate) AS target_subdomain, 'root' AS parent_domain FROM c LEFT JOIN k ON {_N.format('candidate')} = n""")
def refinement_fallback(spark, d):
    c = view(spark, d, "SELECT DISTINCT p_type || CASE WHEN p_size % 2 = 0 THEN ' .' ELSE ' new' END AS name, '' AS suggested_parent FROM part")
    return T.fallback_decisions(c, view(spark, d, _KNOWN_TYPES), "root")


@query("""SELECT p_partkey AS paper_id, CASE WHEN p_size % 4 = 0 THEN p_type WHEN p_size % 4 = 1 THEN 'To ' || lower(p_type) ELSE p_type END AS subdomain, CASE WHEN p_size % 4 = 1 THEN 'up' ELSE p_brand END AS parent_domain, CASE WHEN p_size % 4 = 1 THEN 'confirmed' ELSE 'candidate' END AS subdomain_status, CASE WHEN p_size % 4 = 1 THEN 7 ELSE 1 END AS taxonomy_version FROM (SELECT p_partkey, p_brand, p_type || ' ' || (p_size % 4) AS p_type, p_size FROM part)""")
def propagated_papers(spark, d):
    p = table(spark, d, "part").withColumn("subdomain", F.concat("p_type", F.lit(" "), F.expr("p_size % 4")))
    papers = p.select(F.col("p_partkey").alias("paper_id"), "subdomain", F.col("p_brand").alias("parent_domain"), F.lit("candidate").alias("subdomain_status"), F.lit(1).alias("taxonomy_version"))
    low = F.lower("subdomain")
    decisions = p.filter("p_size % 4 in (0, 1)").select(F.upper("subdomain").alias("candidate"), F.concat(F.lit("To "), low).alias("target_subdomain"), F.lit("up").alias("parent_domain"), F.when(F.expr("p_size % 4 = 1"), "promote").otherwise("dropped").alias("action")).distinct()
    return T.propagate(papers, decisions, 7)


# ---- names

_SIDES = "SELECT p_brand AS paper_id, p_name AS name, p_size % 2 AS side, p_partkey FROM part"


@query(f"""WITH s AS ({_SIDES}), g AS (SELECT DISTINCT paper_id, name FROM s WHERE side = 0), p AS (SELECT DISTINCT paper_id, upper(name) AS name FROM s WHERE p_partkey % 3 = 0)
SELECT paper_id, 'gold' AS side, name FROM g WHERE (paper_id, upper(name)) NOT IN (SELECT (paper_id, name) FROM p) UNION ALL SELECT paper_id, 'pred', name FROM p WHERE (paper_id, name) NOT IN (SELECT (paper_id, upper(name)) FROM g)""")
def unmatched_names(spark, d):
    s = view(spark, d, _SIDES)
    gold, pred = s.filter("side = 0").select("paper_id", "name"), s.filter("p_partkey % 3 = 0").select("paper_id", F.upper("name").alias("name"))
    pairs = gold.select("paper_id", F.col("name").alias("gold"), F.upper("name").alias("name")).join(pred, ["paper_id", "name"]).select("paper_id", "gold", F.col("name").alias("pred"))
    return M.unmatched(gold, pred, pairs)


@query(f"WITH {WITH_CLAIMS} SELECT chunk_index, count(*) AS n FROM (SELECT * FROM claims WHERE chunk_index < 3 UNION ALL SELECT * FROM claims WHERE chunk_index >= 2) GROUP BY 1")
def chunk_claims_union(spark, d):
    c = claims(spark, d)
    return C.bag_union(c.filter("chunk_index < 3"), c.filter("chunk_index >= 2").select(*reversed(c.columns))).groupBy("chunk_index").agg(F.count("*").alias("n"))


# ---- state and streams


@query("SELECT 'b' || (o_custkey % 5) AS batch_id, 'p' || o_orderkey AS paper, CASE WHEN o_custkey % 5 = 2 THEN 'completed' ELSE 'pending' END AS status, o_totalprice AS score FROM orders")
def saved_states(spark, d):
    path = scratch.folder(spark, "states")
    s = lambda status: table(spark, d, "orders").select(F.expr("'b' || (o_custkey % 5)").alias("batch_id"), F.expr("'p' || o_orderkey").alias("paper"), F.lit(status).alias("status"), F.col("o_totalprice").alias("score"), F.lit(None).cast("string").alias("error"), F.lit(1).cast("bigint").alias("updated"))
    B.save(s("pending"), path)
    B.save(s("completed").filter("batch_id = 'b2'"), path)
    return B.load(spark, path).select("batch_id", "paper", "status", "score")


@query("SELECT 'b' AS batch_id, 'p' || o_orderkey AS paper, CASE o_orderkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' ELSE 'pending' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'e2' END AS error FROM orders")
def updated_states(spark, d):
    s = lambda cond, status, error, at: table(spark, d, "orders").filter(cond).select(F.lit("b").alias("batch_id"), F.expr("'p' || o_orderkey").alias("paper"), F.lit(status).alias("status"), F.lit(0.0).alias("score"), F.lit(error).cast("string").alias("error"), F.lit(at).cast("bigint").alias("updated"))
    changes = s("o_orderkey % 3 = 0", "failed", "e1", 3).union(s("o_orderkey % 3 = 0", "failed", "e2", 4)).union(s("o_orderkey % 3 = 1", "completed", None, 2)).union(s("o_orderkey % 3 = 2", "completed", None, 1))
    return B.updated(s("true", "pending", None, 2), changes).select("batch_id", "paper", "status", "error")


@query("""WITH q AS (SELECT o_custkey AS b, o_orderkey AS k, 'p' || o_orderkey AS paper FROM orders), m AS (SELECT b, min(k) FILTER (k % 7 = 0) AS stop FROM q GROUP BY 1)
SELECT '' || b AS batch_id, paper, CASE WHEN k > stop THEN 'pending' WHEN k = stop OR k % 5 = 0 THEN 'failed' WHEN k % 3 = 0 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN k > stop THEN NULL WHEN k = stop THEN 'file not found' WHEN k % 5 = 0 THEN 'e' END AS error FROM q JOIN m USING (b)""")
def finalized_batches(spark, d):
    q = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("batch_id"), F.col("o_orderkey").alias("ord"), F.expr("'p' || o_orderkey").alias("paper"))
    results = q.filter("ord % 5 = 0 or ord % 3 = 0").select("paper", F.when(F.expr("ord % 5 = 0"), "e").alias("error"))
    return B.finalized(q, q.filter("ord % 7 != 0"), results).select("batch_id", "paper", "status", "error")


@query("""WITH p AS (SELECT DISTINCT lower(p_name) AS name, min(p_partkey) OVER (PARTITION BY lower(p_name)) % 2 = 0 AS known, p_partkey FROM part), k AS (SELECT lower(p_name) AS name, min('a' || p_partkey) FILTER (p_size < 20) AS old, min('b' || p_partkey) FILTER (p_size >= 20) AS new FROM part GROUP BY 1)
SELECT name, coalesce(old, new) AS entity_id, old IS NOT NULL AS hit FROM k""")
def entity_cache(spark, d):
    p = table(spark, d, "part")
    cache = p.filter("p_size < 20").select(F.upper("p_name").alias("name"), F.concat(F.lit("a"), "p_partkey").alias("entity_id"))
    hits, misses = B.cached_names(cache, p.select(F.col("p_name").alias("name")))
    found = p.filter("p_size >= 20").select(F.col("p_name").alias("name"), F.concat(F.lit("b"), "p_partkey").alias("entity_id"))
    known = hits.select(F.lower("name").alias("name")).distinct().withColumn("hit", F.lit(True)).union(misses.withColumn("hit", F.lit(False)))
    return B.grown(cache, found).join(known, "name")


@query("SELECT r_regionkey AS batch_id, (SELECT count(*) FROM nation n WHERE n.n_regionkey <= r_regionkey) AS n, CAST(r_regionkey + 2 AS INTEGER) AS version, (SELECT count(*) FROM nation n WHERE n.n_regionkey < r_regionkey) AS seen FROM region")
def frozen_batches(spark, d):
    p = table(spark, d, "nation").select(F.col("n_regionkey").alias("batch_id"), "n_name")

    def classify(batch, store):
        return batch.groupBy("batch_id").agg(F.count("*").alias("k")).join(F.broadcast(store["names"].agg(F.count("*").alias("seen"))))  # one row

    def apply(store, assigned, version):
        names = store["names"].union(p.join(assigned.select("batch_id"), "batch_id", "left_semi").select("n_name"))
        row = assigned.select("batch_id", (F.col("seen") + F.col("k")).alias("n"), F.lit(version).alias("version"), "seen")
        return {"names": names, "log": row if store["log"] is None else store["log"].union(row)}

    return B.by_batch(p, {"names": p.limit(0).select("n_name"), "log": None}, classify, apply)["log"]


_STREAMED = f"""{WITH_CLAIMS}, g AS (SELECT *, {ROUTE_SQL} AS route, row_number() OVER (PARTITION BY subject, relation, object, paper_id ORDER BY claim_ord) AS k FROM claims WHERE claim_ord % 5 > 0 AND subject_id <> object_id AND lower(trim(subject)) <> lower(trim(object))), f AS (SELECT * FROM g WHERE k = 1)"""


def _streamed(spark, d):
    src, out, ck = (scratch.folder(spark, k) for k in ("claims", "graph", "checkpoint"))
    c = claims(spark, d).withColumn("status", F.expr("CASE WHEN claim_ord % 5 = 0 THEN 'rejected' ELSE 'validated' END")).withColumn("source_paper_id", F.col("paper_id"))
    # Two runs over a growing folder; all claims of a key come in order.
    for half in ("claim_ord < 30000000", "claim_ord >= 30000000"):
        c.filter(half).write.mode("append").parquet(src)
        q = I.claims_to_graph(spark.readStream.schema(c.schema).parquet(src), out, ck)
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return out


@query(f"WITH {_STREAMED} SELECT subject_id AS src, object_id AS dst, count(*) AS n FROM f GROUP BY 1, 2")
def streamed_edges(spark, d):
    return spark.read.parquet(f"{_streamed(spark, d)}/edges").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {_STREAMED}, e AS (SELECT subject_id AS id, route IN ('ontology_subclass', 'ontology_property') AS c FROM f UNION ALL SELECT object_id, route <> 'instance' FROM f) SELECT id, CASE WHEN bool_or(c) THEN true END AS is_concept FROM e GROUP BY 1")
def streamed_nodes(spark, d):
    return I.stored_nodes(spark, _streamed(spark, d)).select("id", "is_concept")


@query("SELECT time_bucket(INTERVAL '1 hour', CAST(ts AS TIMESTAMP)) AS start, event_type, count(*) AS calls, round(sum(value), 4) AS seconds FROM events GROUP BY 1, 2")
def stage_timing_windows(spark, d):
    return I.stage_timings(table(spark, d, "events")).withColumn("seconds", F.round("seconds", 4))
