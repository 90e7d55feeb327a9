"""Scalar functions as column builders: normalisers, keys, scores, answer extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relation synonyms, by spelling after the case and separator rules. The last of repeated spellings counts.
RELATION_SYNONYMS = {
    "subclassof": "subclass_of", "subclass_of": "subclass_of", "subtype_of": "subclass_of", "is_a": "type", "type_of": "type", "instance_of": "type", "rdf_type": "type", "type": "type",
    "risk_factor": "risk_factor_for", "risk_factor_for": "risk_factor_for", "associated_with": "associated_with", "associated": "associated_with", "correlated_with": "associated_with",
    "biomarker_of": "biomarker_for", "biomarker_for": "biomarker_for", "measured_by": "measured_by", "measured_in": "measured_in", "treated_with": "received_treatment",
    "received_treatment": "received_treatment", "combination_with": "combined_with", "combined_with": "combined_with", "causes": "causes", "induces": "causes", "inhibits": "inhibits",
    "activates": "activates", "reduced": "reduced", "increases": "increases", "predicts": "predicts", "has_diagnosis": "has_diagnosis", "has_symptom": "has_symptom",
    "has_adverse_event": "has_adverse_event", "measured_value": "measured_value", "improved": "improves", "improves": "improves", "improvement_in": "improves", "reduced_after": "reduces",
    "reduction_in": "reduces", "reduction_of": "reduces", "reduces": "reduces", "increase_in": "increases", "increase_of": "increases", "increased": "increases", "had_diagnosis": "has_diagnosis",
    "diagnosed_with": "has_diagnosis", "received": "received_treatment", "therapy_with": "received_treatment",
}
#: Relations allowed by claim type, tiers of relations.
ONTOLOGY_RELATIONS = ("subclass_of", "type", "biomarker_for", "risk_factor_for", "treats", "measured_in", "part_of", "associated_with", "inhibits", "activates", "causes", "predicts")
INSTANCE_RELATIONS = ("has_diagnosis", "received_treatment", "combined_with", "improves", "reduces", "increases", "associated_with", "predicts", "has_adverse_event", "measured_value", "measured_in")
HIGH_RELATIONS = ("subclass_of", "type", "biomarker_for", "risk_factor_for", "treats", "has_diagnosis", "received_treatment", "predicts", "has_adverse_event")
MEDIUM_RELATIONS = ("associated_with", "inhibits", "activates", "causes", "combined_with", "measured_in")
#: Patterns of an answer letter, in order.
ANSWER_PATTERNS = (r"The correct answer is boxed\s*\{([ABCD])\}", r"boxed\s*\{([ABCD])\}", r"答案是\s*([ABCD])", r"选择\s*([ABCD])", r"正确答案是\s*([ABCD])", r"答案：\s*([ABCD])", r"选项\s*([ABCD])", r"^([ABCD])$", r"^([ABCD])\.", r"\b([ABCD])\b")


#: White space as texts are stripped of it.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Trim all Unicode white space; by a set of signs, which costs no search over the whole text."""
    return F.btrim(x, F.lit(SPACES))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def n_words(x: Column) -> Column:
    """The runs of signs that are no white space."""
    return F.regexp_count(x, F.lit(r"(?U)\S+"))


def one_of(x: Column, values) -> Column:
    return x.isin(*values)


def sanitize_relation_type(x: Column, default: str = "关系") -> Column:
    """an edge type of CJK, letters, digits and underscores."""
    kept = F.regexp_replace(F.replace(strip(x), F.lit(" "), F.lit("_")), "[^一-龥a-zA-Z0-9_]", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def normalize_label(x: Column, keep_underscore: bool = False) -> Column:
    """lower case, single spaces, no outer punctuation."""
    x = F.lower(x) if keep_underscore else F.replace(F.lower(x), F.lit("_"), F.lit(" "))
    return F.btrim(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(" .;:,"))


def tokens(label: Column) -> Column:
    """distinct ASCII tokens of a normalised label."""
    return F.array_distinct(F.regexp_extract_all(label, F.lit("[a-z0-9]+"), 0))


def label_similarity(a: Column, b: Column) -> Column:
    """1 if equal; length ratio if one contains the other; else the better of Jaccard and overlap of tokens."""
    ta, tb = tokens(a), tokens(b)
    both = F.size(F.array_intersect(ta, tb)).cast("double")
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    by_tokens = F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(F.greatest(both / F.size(F.array_union(ta, tb)), both / F.least(F.size(ta), F.size(tb))))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(a.contains(b) | b.contains(a), shorter / longer).otherwise(by_tokens)


def normalize_relation(x: Column, claim_type: Column) -> Column:
    """snake case, synonyms, then the allow-list of the claim type; empty if not allowed."""
    snake = F.lower(F.regexp_replace(strip(x), "([a-z])([A-Z])", "$1_$2"))
    snake = F.btrim(F.regexp_replace(F.regexp_replace(F.translate(snake, "- ", "__"), "[^a-z_]", ""), "_+", "_"), F.lit("_"))
    known = F.create_map(*[F.lit(v) for kv in RELATION_SYNONYMS.items() for v in kv])
    named = F.coalesce(F.try_element_at(known, snake), F.coalesce(F.nullif(snake, F.lit("")), strip(x)))
    allowed = F.when(claim_type == "ontology", named.isin(*ONTOLOGY_RELATIONS)).when(claim_type == "instance", named.isin(*INSTANCE_RELATIONS)).otherwise(named.isin(*ONTOLOGY_RELATIONS, *INSTANCE_RELATIONS))
    return F.when(allowed, named).otherwise("")


def normalize_entity(x: Column, tighten: bool = False) -> Column:
    """the deduplication key of an entity name: single spaces, no outer stops, lower case.

    The rule to be matched names signs around which space goes, but its class of signs ends early, so that it only finds a sign before
    ``/-]``; that is the default. ``tighten`` takes the space around , ; : ( ) [ ] / - as the rule reads.
    """
    single = F.regexp_replace(strip(x), r"(?U)\s+", " ")
    signs = r"\s*([,;:()\[\]/\-])\s*" if tighten else r"\s*([,;:()\\\[]/-\])\s*"
    return F.lower(F.btrim(F.regexp_replace(single, signs, "$1"), F.lit(" .;:,")))


def camel_to_words(x: Column) -> Column:
    """F08."""
    return F.replace(F.regexp_replace(F.regexp_replace(x, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"), F.lit("_"), F.lit(" "))


def normalize_name(x: Column) -> Column:
    """F09."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def to_uri(x: Column) -> Column:
    """words joined by underscores, each with an upper first letter, after a colon."""
    words = F.filter(F.transform(F.split(strip(x), r"(?U)[\s_]+"), lambda w: F.regexp_replace(w, r"(?U)[^\w]", "")), lambda w: w != "")
    name = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "_")
    return F.when(name == "", ":Unknown").otherwise(F.concat(F.lit(":"), name))


def split_triple(x: Column) -> Column:
    """subject | predicate | object; more bars belong to the object, fewer leave the rest empty."""
    p = F.transform(F.split(x, r"\|"), strip)
    full = F.size(p) >= 3
    part = lambda k: F.when(full, F.try_element_at(p, F.lit(k))).otherwise("")
    subject = F.when(full, F.try_element_at(p, F.lit(1))).otherwise(strip(x))
    return F.struct(subject.alias("subject"), part(2).alias("predicate"), F.when(full, F.array_join(F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0))), "|")).otherwise("").alias("object"))


def extract_answer(x: Column) -> Column:
    """F16: the first answer letter by the patterns in order; null if none."""
    return F.upper(F.coalesce(*[F.nullif(F.regexp_extract(x, "(?i)" + p, 1), F.lit("")) for p in ANSWER_PATTERNS]))


def json_maps(x: Column, schema: str) -> Column:
    """the maps in a JSON list, in order; entries of other kinds are left out one by one."""
    return F.transform(F.filter(F.from_json(x, "ARRAY<STRING>"), lambda e: e.startswith("{")), lambda e: F.from_json(e, schema))


def fingerprint(*parts: Column) -> Column:
    """F21."""
    return F.md5(F.concat_ws("|", *parts))


def ratio(a: Column, b: Column) -> Column:
    """A share, 0 where the base is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def claim_priority(claim_type: Column, relation: Column, section: Column, subject: Column, object_: Column) -> Column:
    """F34."""
    s = F.lower(strip(section))
    starts = lambda *xs: s.rlike("^(" + "|".join(xs) + ")")
    return (
        F.when(claim_type == "ontology", 6).otherwise(3)
        + F.when(relation.isin(*HIGH_RELATIONS), 4).when(relation.isin(*MEDIUM_RELATIONS), 2).otherwise(0)
        + F.when(starts("results", "discussion", "conclusion", "case presentation", "case report", "abstract"), 2).otherwise(0)
        - F.when(starts("introduction", "background"), 2).otherwise(0)
        - F.when(s.rlike("methods|experimental|materials"), 3).otherwise(0)
        + F.when(n_words(subject) <= 4, 1).otherwise(0)
        + F.when(n_words(object_) <= 5, 1).otherwise(0)
    )
