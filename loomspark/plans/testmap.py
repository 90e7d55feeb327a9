"""Views of the star schema as the graph and claim model. The texts are plain SQL, the same for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

EDGES = """
SELECT 'C' || c_custkey AS src, 'placed' AS rel_type, 'O' || o_orderkey AS dst, false AS is_ontology FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT DISTINCT 'O' || l_orderkey, 'contains', 'P' || l_partkey, false FROM lineitem
UNION ALL SELECT DISTINCT 'P' || l_partkey, 'supplied_by', 'S' || l_suppkey, false FROM lineitem
UNION ALL SELECT 'C' || c_custkey, 'located_in', 'N' || c_nationkey, CAST(NULL AS BOOLEAN) FROM customer
UNION ALL SELECT 'S' || s_suppkey, 'located_in', 'N' || s_nationkey, CAST(NULL AS BOOLEAN) FROM supplier
UNION ALL SELECT 'N' || n_nationkey, 'subclass_of', 'R' || n_regionkey, true FROM nation
"""

NODES = """
SELECT 'C' || c_custkey AS id, c_name AS name, CAST(NULL AS BOOLEAN) AS is_concept FROM customer
UNION ALL SELECT 'S' || s_suppkey, s_name, false FROM supplier
UNION ALL SELECT 'P' || p_partkey, p_brand || ' ' || p_type, false FROM part
UNION ALL SELECT 'N' || n_nationkey, n_name, true FROM nation
UNION ALL SELECT 'R' || r_regionkey, r_name, true FROM region
"""

CLAIMS = """
SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS claim_ord,
       CASE WHEN l_partkey % 17 = 0 THEN 'Figure 3' WHEN l_partkey % 19 = 0 THEN ' This Study' WHEN l_partkey % 23 = 0 THEN '---' ELSE p_brand || '  ' || p_type END AS subject,
       CASE l_partkey % 10 WHEN 0 THEN 'subclass_of' WHEN 1 THEN 'subclassOf' WHEN 2 THEN 'associated with' WHEN 3 THEN 'Risk-Factor' WHEN 4 THEN 'increased' WHEN 5 THEN 'treats' WHEN 6 THEN 'predicts' WHEN 7 THEN 'is_a' WHEN 8 THEN 'mentioned' ELSE 'improves' END AS relation,
       CASE WHEN l_suppkey % 7 = 0 THEN p_brand || '  ' || p_type WHEN l_suppkey % 11 = 0 THEN 'Table of (contents ) , index' ELSE s_name END AS object,
       CASE WHEN l_quantity < 3 THEN 'short' WHEN l_linenumber = 6 THEN 'In this study we found a link' ELSE 'observed for ' || p_type END AS evidence,
       CASE l_linenumber WHEN 1 THEN 'Introduction' WHEN 2 THEN 'Materials and Methods' WHEN 3 THEN 'Results' WHEN 4 THEN '' ELSE 'Discussion' END AS section_title,
       CASE WHEN l_returnflag = 'R' THEN 'instance' ELSE 'ontology' END AS claim_type,
       CAST(l_orderkey AS VARCHAR(20)) AS paper_id, l_linenumber AS chunk_index, 'P' || l_partkey AS subject_id, CASE WHEN l_suppkey % 13 = 0 THEN 'P' || l_partkey ELSE 'S' || l_suppkey END AS object_id
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the tables of a folder; names are passed as frames, so nothing is registered in the session."""
    used = [t for t in TABLES if t in sql]
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces of the text are no names
    for t in used:
        sql = re.sub(rf"\b{t}\b", "{" + t + "}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EDGES)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, NODES)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CLAIMS)
