"""The graph in the formats of the exchange (K04, K05, K08–K10). Sheets and documents are frames; a dispatcher writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.store import collected_names
from . import writers as W

#: Relation types that count as explicit ontology, and those of instances, parents and children.
EXPLICIT = ("SUB_CLASS_OF", "SUBCLASS_OF", "INSTANCE_OF", "RDF_TYPE", "TYPE")
AROUND = {"instance_of_concepts": ("TYPE", "out"), "concept_parent_classes": ("SUBCLASS_OF", "out"), "concept_child_classes": ("SUBCLASS_OF", "in")}


def _flag(c: str):
    return F.coalesce(F.col(c), F.lit(False))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes_count, concept_nodes_count, relationships_count, ontology_relations_count."""
    s = G.graph_stats(nodes, edges)
    return s.select(F.col("nodes").alias("nodes_count"), F.col("concept_nodes").alias("concept_nodes_count"), F.col("relationships").alias("relationships_count"), F.col("ontology_relations").alias("ontology_relations_count"))


def document(nodes: DataFrame, edges: DataFrame, around: dict[str, tuple[str, str]] = AROUND) -> DataFrame:
    """(part, value): the counts, the nodes with the names around them, and the relationships, each as a JSON text."""
    n = nodes.join(collected_names(nodes, edges, around), "id")
    as_json = lambda t: F.to_json(F.struct(*t.columns), {"ignoreNullFields": "false"}).alias("value")
    c = counts(nodes, edges)
    parts = [c.select(F.lit("metadata").alias("part"), as_json(c)), n.select(F.lit("node"), as_json(n)), edges.select(F.lit("relationship"), as_json(edges))]
    return parts[0].union(parts[1]).union(parts[2])


def simplified(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row a node id (name, is_concept), and edges with their evidence cut to 200 characters; unset flags are false, unset texts empty."""
    n = nodes.filter("id is not null and id != ''").groupBy("id").agg(F.min(F.struct("name", _flag("is_concept").alias("is_concept"))).alias("r")).select("id", "r.*")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    e = edges.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.col("rel_type").alias("relation"), _flag("is_ontology").alias("is_ontology"), F.left(F.coalesce("evidence", F.lit("")), F.lit(200)).alias("evidence"), text("source_paper"))
    return n, e


def ontology_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level, subject, relation, object: explicit ontology edges; where there are none, edges that touch a concept; where none either, concept nodes.

    Of the three only the first filled level comes out; a concept node is a row without relation and object.
    """
    end = lambda side: nodes.select(F.col("id").alias(side), F.struct("id", "name", _flag("is_concept").alias("is_concept")).alias(f"_{side}"))
    e = edges.join(end("src"), "src").join(end("dst"), "dst")
    level = F.when(_flag("is_ontology") | F.col("rel_type").isin(*EXPLICIT), 1).when((F.col("_src.is_concept") | F.col("_dst.is_concept")) & (F.col("rel_type") != "INSTANCE_OF"), 2)
    rows = e.withColumn("level", level).filter("level is not null").select("level", F.col("_src.id").alias("subject_id"), F.col("_src.name").alias("subject_name"), F.col("rel_type").alias("relation"), F.col("_dst.id").alias("object_id"), F.col("_dst.name").alias("object_name"))
    alone = nodes.filter(_flag("is_concept")).select(F.lit(3).alias("level"), F.col("id").alias("subject_id"), F.col("name").alias("subject_name"), *[F.lit(None).cast("string").alias(c) for c in ("relation", "object_id", "object_name")])
    every = rows.union(alone)
    best = every.agg(F.min("level").alias("level"))
    return every.join(F.broadcast(best), "level", "left_semi")  # one row


def sheets(nodes: DataFrame, edges: DataFrame, around: dict[str, tuple[str, str]] = AROUND) -> dict[str, DataFrame]:
    """The sheets nodes (with role and the names around each), relations, ontology and stats of a workbook."""
    n = nodes.join(collected_names(nodes, edges, around), "id")
    n = n.select("id", "name", F.array_join("labels", ";").alias("labels"), _flag("is_concept").alias("is_concept"), F.when(_flag("is_concept"), "concept").otherwise("instance").alias("node_role"), *around)
    return {"nodes": n, "relations": W.edge_rows(edges, nodes), "ontology": ontology_rows(nodes, edges), "stats": G.graph_stats(nodes, edges)}


FORMATS = ("json", "simple", "cypher", "csv", "excel", "ontology", "ontology-excel")


def export(fmt: str, nodes: DataFrame, edges: DataFrame, path: str) -> list[str]:
    """Write one of ``FORMATS`` below ``path`` and return the folders. Workbooks become one CSV folder a sheet, as no spreadsheet writer is at hand."""
    if fmt == "json":
        document(nodes, edges).write.mode("overwrite").partitionBy("part").text(f"{path}/graph")
        return [f"{path}/graph"]
    if fmt == "cypher":
        W.write_text(W.cypher_lines(nodes, edges), f"{path}/cypher")
        return [f"{path}/cypher"]
    tables = {
        "simple": lambda: dict(zip(("nodes", "relationships"), simplified(nodes, edges))), "csv": lambda: {"nodes": W.node_rows(nodes), "relations": W.edge_rows(edges, nodes)},
        "excel": lambda: sheets(nodes, edges), "ontology": lambda: {"ontology": ontology_rows(nodes, edges)}, "ontology-excel": lambda: {k: v for k, v in sheets(nodes.filter(_flag("is_concept")), edges).items() if k in ("nodes", "ontology")},
    }
    if fmt not in tables:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    out = []
    for name, t in tables[fmt]().items():
        (W.write_csv if fmt != "simple" else lambda x, p: x.write.mode("overwrite").json(p))(t, f"{path}/{name}")
        out.append(f"{path}/{name}")
    return out
