"""Secret scan with multipart credential linking; DataFrame functions only.

Base findings, leftmost and non-overlapping per kind, with code-point offsets, end exclusive:

* ``assign``: a key word, a separator and a value of 12 characters or more;
* ``access``: access identifiers of 18 characters or more;
* ``hex``: runs of 16 and more hexadecimal digits.

The offsets come from cutting a text at the matches: what lies between them and the matches themselves, summed in turn, give
each start and end. The method adds *weak* candidates, parts that mean little alone:

* ``secret``: a token that looks like a secret key (a whole run of 40 characters and more of base64 with upper case, lower case and
  digits, whatever other sign stands beside it);
* ``endpoint``: a service address (a URL, or an IPv4 address with or without a port);
* ``account``: a named account (user, login, account or client, a separator, a value) or an e-mail address;
* ``short``: an ``assign`` match whose value has only 4 to 11 characters.

Parts of one document whose starts are at most ``SCOPE`` code points apart are in each other's scope. A weak part is reported when its
complements are there: a secret with an identifier (access or account); a short with an identifier and an endpoint; an account
with an assign or secret, or with a short and an endpoint; an endpoint with an identifier and an assign, secret or short.

The interval join: parts are put in bins of ``SCOPE`` code points, and a bin keeps the smallest and largest start of each group of
parts. Each weak part meets its own bin, in which all is in scope, and the two beside it, of which the nearest start tells. So
a part costs three rows whatever the number of its partners. Null and empty texts have no findings; their digest is that
of the empty text. Repeated rows give repeated results. An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of, sha_hex_utf8

SCOPE = 400

# Fixed patterns of the base findings.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the same as runs of which the shorter ones are dropped
# The weak parts.
SECRET = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/])"
ENDPOINT = r"(?:https?|s3|ftp|jdbc:[a-z]+)://[A-Za-z0-9._~:@/?#%&=+-]{4,}|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9]|\.[0-9])"
ACCOUNT = r"""(?i:user|login|account|client)(?i:[_-]?(?:name|id))?["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"""
LONG, SHORT = 12, 4  # characters of an assigned value

KINDS = ("assign", "access", "hex", "secret", "endpoint", "account", "short")
#: Which kinds each group of parts holds, for the bins.
GROUPS = {"id": (1, 5), "key": (0, 3), "short": (6,), "end": (4,)}


def _prefix_sums(df: DataFrame, text: str, pattern: str, kind: int, least: int, out: str, maybe: Column, group: int = 0) -> DataFrame:
    """Add the spans of one kind. ``maybe`` is a cheap test that every text with a match passes."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    none = "cast(array() as array<struct<start:int,kind:int,end:int>>)"
    df = df.withColumn("_m", F.when(maybe, F.expr(f"regexp_extract_all({text}, '{quoted}', 0)")))
    df = df.withColumn("_v", F.when(F.size("_m") > 0, F.expr(f"regexp_extract_all({text}, '{quoted}', {group})")) if group else F.col("_m"))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.expr(f"slice(split({text}, '{quoted}', -1), 1, size(_m))")))
    of_kind = f"if(char_length(x._v) >= {LONG}, 0, 6)" if kind == 0 else str(kind)
    walked = f"""
      coalesce(filter(aggregate(
        arrays_zip(_m, _g, _v),
        named_struct('at', 0, 'out', {none}),
        (acc, x) -> named_struct(
          'at', acc.at + char_length(x._g) + char_length(x._m),
          'out', if(char_length(x._v) >= {least},
                    array_append(acc.out, named_struct('start', acc.at + char_length(x._g), 'kind', {of_kind}, 'end', acc.at + char_length(x._g) + char_length(x._m))),
                    acc.out)),
        acc -> acc.out), x -> x is not null), {none})"""
    return df.withColumn(out, F.expr(walked)).drop("_m", "_v", "_g")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def parts(docs: DataFrame) -> DataFrame:
    """A row per document with the base spans and the weak parts that may have complements (a written table)."""
    t = rows_of(docs)
    low = F.lower("text")
    any_of = lambda *xs: F.exists(F.array(*map(F.lit, xs)), lambda x: low.contains(x))
    t = _prefix_sums(t, "text", ASSIGN, 0, SHORT, "_assigned", any_of("passw", "secret", "token", "api"), group=2)
    t = t.withColumn("assign", F.filter("_assigned", lambda s: s.kind == 0)).withColumn("short", F.filter("_assigned", lambda s: s.kind == 6)).drop("_assigned")
    t = _prefix_sums(t, "text", ACCESS, 1, 18, "access", F.col("text").contains("AKIA"))
    t = _prefix_sums(t, "text", HEX, 2, 16, "hex", F.lit(True))
    # No weak part is reported without an identifier and some secret in its scope, so they are looked for in that order.
    named = F.col("text").contains("@") | any_of("user", "login", "account", "client")
    t = _prefix_sums(t, "text", SECRET, 3, 40, "secret", (F.size("access") > 0) | named)
    t = t.withColumn("secret", F.filter("secret", lambda s: F.substring(F.col("text"), s.start + 1, s.end - s.start).rlike("^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])")))
    keyed = F.size("assign") + F.size("secret") + F.size("short") > 0
    t = _prefix_sums(t, "text", ACCOUNT, 5, 6, "account", keyed & named)
    t = _prefix_sums(t, "text", ENDPOINT, 4, 7, "endpoint", keyed & (F.size("access") + F.size("account") > 0))
    return materialize(t.drop("text"), "secret-parts")


def linked(p: DataFrame) -> DataFrame:
    """(_rid, span): the weak parts with their complements in scope."""
    p = p.filter((F.size("access") + F.size("account") > 0) & (F.size("assign") + F.size("secret") + F.size("short") > 0) & (F.size("secret") + F.size("endpoint") + F.size("account") > 0))
    every = p.select("_rid", F.explode(F.concat("assign", "access", "secret", "endpoint", "account", "short")).alias("span"))
    every = every.withColumn("bin", F.floor(F.col("span.start") / SCOPE))
    at = lambda g: F.when(F.col("span.kind").isin(*GROUPS[g]), F.col("span.start"))
    bins = every.groupBy("_rid", "bin").agg(*[f(at(g)).alias(f"{g}_{n}") for g in GROUPS for n, f in (("lo", F.min), ("hi", F.max))])
    weak = every.filter(~F.col("span.kind").isin(0, 1)).select("_rid", "span", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    # A bin is as wide as the scope: the largest start of the bin before and the smallest of the next are the nearest ones.
    near = lambda g: F.coalesce((F.abs(F.col(f"{g}_lo") - F.col("span.start")) <= SCOPE) | (F.abs(F.col(f"{g}_hi") - F.col("span.start")) <= SCOPE), F.lit(False))
    met = weak.join(bins, ["_rid", "bin"]).groupBy("_rid", "span").agg(*[F.max(near(g)).alias(g) for g in GROUPS])
    kind = F.col("span.kind")
    rule = F.when(kind == 3, F.col("id")).when(kind == 6, F.col("id") & F.col("end")).when(kind == 5, F.col("key") | F.col("short") & F.col("end")).when(kind == 4, F.col("id") & (F.col("key") | F.col("short")))
    return met.filter(rule).select("_rid", "span")


def secret_scan(docs: DataFrame) -> DataFrame:
    """_rid, doc_id, base (array of start, kind, end) and all (base and linked spans), each by start and kind."""
    p = parts(docs)
    more = linked(p).groupBy("_rid").agg(F.collect_list("span").alias("more"))  # the parts of one document
    p = p.withColumn("base", F.sort_array(F.concat("assign", "access", "hex"))).join(more, "_rid", "left")
    every = F.sort_array(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")))
    return p.select("_rid", "doc_id", "assign", "access", "hex", "base", every.alias("all"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    count = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), sha_hex_utf8(_listed(F.col("base"))).alias("base_sha256"), _listed(F.col("all")).alias("spans"))
