"""Predicates by group, category (A19, A20) and standard form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Spellings of each predicate, and the category of each.
GROUPS = {
    "increases": ("increases", "increase", "increased", "elevates", "elevated", "upregulates", "upregulated"),
    "improves": ("improves", "improved", "improvement", "better", "ameliorates"),
    "enhances": ("enhances", "enhanced", "enhancement", "boosts", "boosted", "potentiates"),
    "reduces": ("reduces", "reduced", "reduction", "decreases", "decreased", "decrease", "lowers", "lowered", "downregulates", "downregulated"),
    "inhibits": ("inhibits", "inhibited", "inhibition", "suppresses", "suppressed", "suppression", "抑制", "抑制生长"),
    "blocks": ("blocks", "blocked", "blockade", "prevents", "prevented"),
    "associated_with": ("associated_with", "association", "related_to", "linked_to", "connection", "相关", "关联", "相关因素", "具有"),
    "correlated_with": ("correlated_with", "correlation", "correlates"),
    "causes": ("causes", "caused", "causality", "etiology", "导致", "引起"),
    "leads_to": ("leads_to", "lead_to", "resulted_in", "results_in", "consequence"),
    "induces": ("induces", "induced", "induction", "triggers", "triggered", "诱导", "激活"),
    "treats": ("treats", "treated", "treatment", "therapy", "therapeutic", "manages", "management", "治疗"),
    "targets": ("targets", "targeted", "targeting", "binds", "binding", "靶向", "结合"),
    "adverse_event_of": ("adverse_event_of", "adverse_event", "side_effect", "side_effect_of", "toxicity", "toxic"),
    "risk_factor_for": ("risk_factor_for", "risk", "risky", "增加风险", "increases_risk_of", "increased_risk"),
    "protective_factor_for": ("protective_factor_for", "protective", "protection", "protects", "preventive"),
    "has_measurement": ("has_measurement", "measurement", "measured", "level", "value", "concentration"),
}
CATEGORIES = {
    "Effect Modification": ("increases", "improves", "enhances", "reduces", "inhibits", "blocks"),
    "Association": ("associated_with", "correlated_with"),
    "Causation": ("causes", "leads_to", "induces", "mediated_by", "regulates"),
    "Treatment": ("treats", "targets", "indicated_for", "contraindicated_with", "adverse_event_of"),
    "Risk": ("risk_factor_for", "protective_factor_for", "prognostic_marker_for"),
    "Measurement": ("has_measurement", "has_clinical_feature", "diagnosed_by"),
}


def _lookup(x: Column, table: dict[str, tuple[str, ...]], default: str) -> Column:
    known = F.create_map(*[F.lit(v) for name, xs in table.items() for x_ in xs for v in (x_, name)])
    return F.coalesce(F.try_element_at(known, x), F.lit(default))


def predicate_group(x: Column) -> Column:
    """Exact membership, else ``other``; null is other."""
    return _lookup(x, GROUPS, "other")


def predicate_category(x: Column) -> Column:
    """Of a predicate group, else ``Other``."""
    return _lookup(x, CATEGORIES, "Other")


def standard_predicate(x: Column, variants: dict[str, tuple[str, ...]]) -> Column:
    """the standard form of a predicate by a table of variants, standard by standard.

    An exact variant counts first (of equal variants the last standard), then the first variant that holds the predicate or is held
    by it; what is left, nulls and blanks included, is ``unknown``. The table is a parameter and is evaluated as one literal.
    """
    table = {v.lower().strip(): name for name, vs in variants.items() for v in vs} | {"": "unknown"}
    p = strip(F.lower(F.coalesce(x, F.lit(""))))
    pairs = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(name).alias("name")) for v, name in table.items()])
    exact = F.try_element_at(F.create_map(*[F.lit(y) for pair in table.items() for y in pair]), p)
    return F.coalesce(exact, F.get(F.filter(pairs, lambda r: F.contains(r.v, p) | F.contains(p, r.v)), F.lit(0)).getField("name"))
