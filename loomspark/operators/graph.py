"""Property-graph operators over nodes(id, name, is_concept) and edges(src, dst, rel_type, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relations and concepts that route a claim.
SUBCLASS = ("subclass_of", "subtype_of", "子类", "属于", "是", "为")
TYPE = ("type", "instance_of", "is_a", "类型", "实例类型")
PROPERTY = ("藏", "主", "生", "克", "合", "开窍于", "其华在", "走", "入", "伤", "胜", "畏", "恶", "苦", "欲", "出", "起于", "络", "循", "属", "应", "通于", "biomarker_for", "risk_factor_for", "associated_with", "treats", "measured_in", "part_of", "inhibits", "activates", "causes", "predicts")
CONCEPTS = ("心", "肝", "脾", "肺", "肾", "胃", "胆", "大肠", "小肠", "膀胱", "三焦", "精", "气", "血", "津", "液", "神", "魂", "魄", "意", "志", "风", "寒", "暑", "湿", "燥", "火", "阴阳", "五行", "木", "土", "金", "水", "酸", "苦", "甘", "辛", "咸", "春", "夏", "秋", "冬", "长夏")


def claim_route(claim_type: Column, relation: Column, subject: Column, object_: Column) -> Column:
    """ontology_subclass, ontology_type, ontology_property or instance."""
    r = F.lower(F.trim(F.coalesce(relation, F.lit(""))))
    by_relation = F.when(r.isin(*SUBCLASS), "ontology_subclass").when(r.isin(*TYPE), "ontology_type")
    return F.coalesce(by_relation, F.when((claim_type == "ontology") | r.isin(*PROPERTY) | (subject.isin(*CONCEPTS) & object_.isin(*CONCEPTS)), "ontology_property").otherwise("instance"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge from both ends, with its direction: the edges are read once and each row becomes two."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ways = F.array(F.struct("src", "dst", F.lit("out").alias("direction")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("in").alias("direction")))
    return edges.select(F.explode(ways).alias("_w"), *rest).select("_w.src", "_w.dst", *rest, "_w.direction")


def entity_context(nodes: DataFrame, edges: DataFrame, names: DataFrame, limit: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Up to ``limit`` neighbours of each name (of a node's name or id), with the edge columns ``more``.

    The two ways to meet are two joins, not an OR.
    """
    by_name = names.join(nodes, names["wanted"] == nodes["name"]).select("wanted", "id")
    by_id = names.join(nodes, names["wanted"] == nodes["id"]).select("wanted", "id")
    found = by_name.union(by_id).distinct()
    near = found.join(undirected(edges), F.col("id") == F.col("src"), "left").select("wanted", "id", "rel_type", "direction", F.col("dst").alias("neighbour"), *more)
    w = Window.partitionBy("wanted").orderBy("id", "rel_type", "direction", "neighbour")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row; each table is read once, and the two single rows meet."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("is_concept")).alias("concept_nodes"), F.count_if(~F.coalesce("is_concept", F.lit(False))).alias("entity_nodes"))
    e = edges.agg(F.count("*").alias("relationships"), F.count_if(F.col("is_ontology")).alias("ontology_relations"), F.count_if(~F.coalesce("is_ontology", F.lit(False))).alias("instance_relations"))
    return n.withColumn("_one", F.lit(1)).join(e.withColumn("_one", F.lit(1)), "_one").drop("_one")


def duplicates(nodes: DataFrame) -> DataFrame:
    """Groups of nodes with the same name but for case: size and smallest and largest id (ids may be many)."""
    return nodes.groupBy(F.lower("name").alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("n > 1")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n): the ends of edges at each node."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def context_text(context: DataFrame) -> DataFrame:
    """``entity_context`` rows with edge types, evidence and names as lines: [type] 'name' --relation--> 'neighbour' (Evidence: ...)."""
    q = lambda c: F.concat(F.lit("'"), F.coalesce(F.col(c), F.lit("")), F.lit("'"))
    seen = F.when(F.coalesce("evidence", F.lit("")) != "", F.concat(F.lit(" (Evidence: "), F.left("evidence", F.lit(100)), F.lit("...)"))).otherwise("")
    ends = F.when(F.col("direction") == "out", F.concat(q("wanted"), F.lit(" --"), "rel_type", F.lit("--> "), q("neighbour"))).otherwise(F.concat(q("neighbour"), F.lit(" --"), "rel_type", F.lit("--> "), q("wanted")))
    kind = F.when(F.coalesce("is_ontology", F.lit(False)), "[ontology] ").otherwise("[instance] ")
    return context.filter("rel_type is not null").select("wanted", "rank", F.concat(kind, ends, seen).alias("line"))


def path_text(paths: DataFrame) -> DataFrame:
    """Section, path_rank, the path in words, and its contexts joined by bars, of paths with hops (from, relation, to, context)."""
    steps = F.aggregate("hops", F.lit(""), lambda s, h: F.concat(s, F.lit(" --["), h.relation, F.lit("]--> "), h.to))
    return paths.select("section", "path_rank", F.concat(F.lit("Path: "), F.get("hops", F.lit(0))["from"], steps).alias("description"), F.array_join(F.transform("hops", lambda h: h.context), " | ").alias("context"))


def isolated(nodes: DataFrame, edges: DataFrame, keep_concepts: bool = False) -> DataFrame:
    """Nodes without an edge; concepts may be kept (an unset flag is no concept)."""
    out = nodes.join(endpoints(edges), "id", "left_anti")
    return out.filter(~F.coalesce("is_concept", F.lit(False))) if keep_concepts else out


def merge_entities(edges: DataFrame, same: DataFrame) -> DataFrame:
    """J17 on bare edges: each secondary node (same: secondary, primary) replaced; loops go, and so do repeated (src, type, dst).

    ``store.merge_entities`` has the checks, the attributes and the nodes of G12.
    """
    to = same.select(F.col("secondary").alias("_s"), F.col("primary").alias("_p"))
    for end in ("src", "dst"):
        edges = edges.join(to, F.col(end) == F.col("_s"), "left").withColumn(end, F.coalesce("_p", end)).drop("_s", "_p")
    return edges.filter("src != dst").select("src", "rel_type", "dst").distinct()


def repair_labels(nodes: DataFrame, edges: DataFrame, concept_relations: tuple[str, ...]) -> DataFrame:
    """Nodes at an end of the listed relations are concepts; unset flags become false."""
    ends = endpoints(edges.filter(F.col("rel_type").isin(*concept_relations))).withColumn("_c", F.lit(True))
    return nodes.join(ends, "id", "left").withColumn("is_concept", F.coalesce("_c", "is_concept", F.lit(False))).drop("_c")


def upsert_nodes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row an id; a flag stays once it is set."""
    every = stored.select("id", "name", "is_concept").union(new.select("id", "name", "is_concept"))
    return every.groupBy("id").agg(F.min("name").alias("name"), F.max("is_concept").alias("is_concept"))


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """(child, ancestor, distance) up to ``depth`` steps up a hierarchy."""
    step = edges.select(F.col("src").alias("child"), F.col("dst").alias("ancestor")).distinct()
    found = reached = step.withColumn("distance", F.lit(1))
    up = step.select(F.col("child").alias("_m"), F.col("ancestor").alias("_a"))
    for d in range(2, depth + 1):
        reached = reached.join(up, F.col("ancestor") == F.col("_m")).select("child", F.col("_a").alias("ancestor"), F.lit(d).alias("distance"))
        found = found.union(reached)
    return found.groupBy("child", "ancestor").agg(F.min("distance").alias("distance"))


def three_hop_paths(first: DataFrame, second: DataFrame, third: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` paths of each section, by the nodes in order. first: section, n0, n1; then (n1, n2), (n2, n3).

    A start node with a path gives at least one, so the ``limit`` smallest start nodes of a section are all that is joined further;
    interior repeats are allowed, but the last node is none of the others. To tell whether a start node has such a path, three ends
    of each n2 are enough (n1 and n0 can be two of them), and of those that n1 reaches the smallest and the largest.
    """
    ends = third.filter("n3 != n2").select("n2", "n3").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("n2").orderBy("n3"))).filter("_r <= 3").drop("_r")
    reach = second.join(ends, "n2").filter("n3 != n1").groupBy("n1").agg(F.min("n3").alias("_lo"), F.max("n3").alias("_hi"))
    starts = first.join(reach, "n1").filter("_lo != n0 or _hi != n0")
    w = Window.partitionBy("section").orderBy("n0")
    few = starts.select("section", "n0").distinct().withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")
    paths = first.join(few, ["section", "n0"], "left_semi").join(second, "n1").join(third, "n2").filter("n3 != n2 and n3 != n1 and n3 != n0").select("section", "n0", "n1", "n2", "n3").distinct()
    order = Window.partitionBy("section").orderBy("n0", "n1", "n2", "n3")
    return paths.withColumn("path_rank", F.row_number().over(order)).filter(F.col("path_rank") <= limit)
