"""Loose matching of entity names (F10, F11), and the keys by which an equi-join finds every match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

#: Endings a name may lose, abbreviations and their long forms.
SUFFIXES = ("encoder", "model", "method", "system", "dataset", "score", "task", "based", "attention")
ABBREVIATIONS = {
    "knwl": "knowledge", "attn": "attention", "self": "self", "si": "softmaxinterpolation", "mca": "multichannelattention", "kisa": "knowledgeinformedselfattention",
    "cnn": "convolutionalneuralnetwork", "rnn": "recurrentneuralnetwork", "lstm": "longshorttermmemory", "bert": "bert", "gpt": "gpt", "llm": "largelanguagemodel",
    "nlp": "naturallanguageprocessing", "pos": "partofspeech", "ner": "namedentityrecognition", "gcn": "graphconvolutionalnetwork",
}


def name_variants(name: Column) -> Column:
    """the normal form, without a known ending, as an acronym, and with abbreviations written out or put in; null counts as empty."""
    name = F.coalesce(name, F.lit(""))
    base = X.normalize_name(name)
    endings = F.array(*map(F.lit, SUFFIXES))
    shorter = F.transform(F.filter(endings, lambda s: base.endswith(s) & (F.length(base) > F.length(s) + 3)), lambda s: F.left(base, F.length(base) - F.length(s)))
    words = F.regexp_extract_all(name, F.lit("[A-Z][a-z]*|[a-z]+"), 0)
    acronym = F.lower(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for kv in ABBREVIATIONS.items() for a, b in (kv, kv[::-1])])
    swapped = F.transform(F.filter(pairs, lambda p: base.contains(p["a"])), lambda p: F.replace(base, p["a"], p["b"]))
    return F.array_distinct(F.concat(F.array(base), shorter, F.when(F.size(words) > 1, F.array(acronym)).otherwise(F.array().cast("array<string>")), swapped))


def core_words(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(X.normalize_name(name), F.lit("[a-z]{4,}"), 0))


def names_match(a: Column, b: Column, va: Column, vb: Column, shortest: int = 3) -> Column:
    """F11. va and vb are the variants of a and b, computed once a name."""
    na, nb = X.normalize_name(a), X.normalize_name(b)
    long = (F.length(na) >= shortest) & (F.length(nb) >= shortest)
    within = lambda x, y: x.contains(y) | y.contains(x)
    by_part = F.exists(va, lambda x: (F.length(x) >= shortest) & F.exists(vb, lambda y: (F.length(y) >= shortest) & within(x, y)))
    common = F.array_intersect(core_words(a), core_words(b))
    by_core = (F.size(common) >= 2) | F.exists(common, lambda w: F.length(w) >= 6)
    return (na != "") & (nb != "") & ((na == nb) | (long & (within(na, nb) | F.arrays_overlap(va, vb) | by_part | by_core)))


def grams(x: Column, n: int) -> Column:
    """Distinct pieces of n characters."""
    size = F.length(x) - (n - 1)
    return F.when(size > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda k: F.substring(x, k, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _tagged(tag: str, xs: Column) -> Column:
    return F.transform(xs, lambda x: F.concat(F.lit(tag), x))


def match_keys(name: Column, variants: Column, flipped: bool = False) -> Column:
    """Keys such that two matching names share one, where one side is flipped.

    A variant within another begins with three letters that are a piece of the other; equal variants share themselves, and long
    core words are keys too. So the join on keys loses no match and never meets all names with all.
    """
    long = F.filter(variants, lambda v: F.length(v) >= 3)
    heads = F.array_distinct(F.transform(long, lambda v: F.left(v, F.lit(3))))
    pieces = F.array_distinct(F.flatten(F.transform(long, lambda v: grams(v, 3))))
    a, b = ("p:", "h:") if flipped else ("h:", "p:")
    whole = F.filter(variants, lambda v: (v != "") & (F.length(v) < 3))
    return F.concat(_tagged(a, heads), _tagged(b, pieces), _tagged("w:", whole), _tagged("c:", core_words(name)))


def part_keys(label: Column, flipped: bool = False) -> Column:
    """Keys of normalised labels such that two share one if one contains the other or they share a token, where one side is flipped."""
    n = F.least(F.length(label), F.lit(3))
    head = F.when(label != "", F.array(F.substring(label, F.lit(1), n))).otherwise(F.array().cast("array<string>"))
    pieces = F.concat(*[grams(label, k) for k in (1, 2, 3)])
    a, b = ("p:", "h:") if flipped else ("h:", "p:")
    return F.concat(_tagged(a, head), _tagged(b, pieces), _tagged("t:", X.tokens(label)))
