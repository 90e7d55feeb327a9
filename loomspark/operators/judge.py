"""What a language model answers, as tables: prompts in, responses out, decoded without trust.

A provider is a function of a frame (prompt_hash, payload) to one of (prompt_hash, response). ``replay`` reads stored answers; rules are plain
columns; ``remote`` wraps a function that answers a batch of prompts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import claims as C

CLAIM = "STRUCT<subject STRING, relation STRING, object STRING, evidence STRING>"


def with_hash(prompts: DataFrame) -> DataFrame:
    """prompt_hash by the payload's text, so that equal prompts are asked once."""
    return prompts.withColumn("prompt_hash", F.sha2(F.coalesce("payload", F.lit("")), 256))


def replay(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Stored answers; a prompt without one gets null."""
    return prompts.select("prompt_hash").distinct().join(answers.select("prompt_hash", "response"), "prompt_hash", "left")


#: Parts of messages that mark an error as passing.
PASSING = ("connection error", "timeout", "timed out", "max retries exceeded", "ssl", "eof occurred in violation of protocol", "temporarily unavailable", "server error", "rate limit", "429", "503", "502", "504")


def retryable(error: BaseException) -> bool:
    """Connections, timeouts, server statuses, and messages that say so."""
    status = getattr(error, "status", getattr(getattr(error, "response", None), "status_code", None))
    if status is not None:
        return int(status) >= 500
    return isinstance(error, (ConnectionError, TimeoutError)) or any(m in str(error).lower() for m in PASSING)


def delay(attempt: int, base: float = 2.0, most: float = 12.0) -> float:
    """The seconds to wait after a try, from 1."""
    return min(base * 2 ** max(0, attempt - 1), most)


def remote(prompts: DataFrame, ask: Callable[[list[str]], list[str | None]], tries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Answers by ``ask`` for Arrow batches of distinct prompts; passing errors are tried again with growing waits.

    A batch that fails for good is answered by ``API Error: ...``, which no decoder takes for an answer. ``ask`` is made once a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers: list[str | None] = []
            for attempt in range(1, tries + 1):
                try:
                    answers = ask(list(b["payload"]))
                    break
                except Exception as e:  # noqa: BLE001  any error of a client is data here
                    answers = [f"API Error: {e}"] * len(b)
                    if attempt == tries or not retryable(e):
                        break
                    wait(delay(attempt))
            yield pd.DataFrame({"prompt_hash": b["prompt_hash"], "response": answers})

    return prompts.select("prompt_hash", "payload").dropDuplicates(["prompt_hash"]).mapInPandas(run, "prompt_hash STRING, response STRING")


def chat_body(model: str, payload: Column, system: str = "", json_mode: bool = False, temperature: float = 0.1, most: int = 8192) -> Column:
    """The JSON body of a chat request for each payload, for any client that posts it."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(*([say("system", F.lit(system))] if system else []), say("user", payload))
    more = [F.struct(F.lit("json_object").alias("type")).alias("response_format")] if json_mode else []
    return F.to_json(F.struct(F.lit(model).alias("model"), messages.alias("messages"), F.lit(most).alias("max_tokens"), F.lit(temperature).alias("temperature"), *more))


def response_text(body: Column) -> Column:
    """The text in a response body of any known shape: a list with content parts; choices, output (parts or text), content, text; else the body itself."""
    b = F.ltrim(F.coalesce(body, F.lit("")))
    got = lambda p: F.get_json_object(b, p)
    part = lambda p: F.get(F.filter(F.transform(F.from_json(got(p), "ARRAY<STRING>"), lambda x: F.get_json_object(x, "$.text")), lambda x: x.isNotNull()), F.lit(0))
    listed = part("$[0].content")
    mapped = F.when(got("$.choices[0]").isNotNull(), F.coalesce(got("$.choices[0].message.content"), F.lit(""))).when(got("$.output").isNotNull(), F.coalesce(part("$.output[0].content"), got("$.output"))).otherwise(F.coalesce(got("$.content"), got("$.text")))
    return F.coalesce(F.nullif(F.when(b.startswith("["), listed).when(b.startswith("{"), mapped), F.lit("")), body)


def verdicts(answers: DataFrame) -> DataFrame:
    """(prompt_hash, valid, confidence, reasoning) of judgements; what is no JSON is invalid with confidence 0."""
    j = F.from_json(cleaned(F.col("response")), "STRUCT<valid BOOLEAN, confidence DOUBLE, reasoning STRING>")
    t = answers.select("prompt_hash", j.alias("j"))
    return t.select("prompt_hash", F.coalesce("j.valid", F.lit(False)).alias("valid"), F.coalesce("j.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("j.reasoning", F.lit("Error: no judgement")).alias("reasoning"))


def grounded_names(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """(prompt_hash, name, entity_id): what each answer maps the asked names (prompt_hash, name) to; null where it doesn't."""
    m = answers.select("prompt_hash", F.from_json(cleaned(F.col("response")), "MAP<STRING, STRING>").alias("_m"))
    return asked.join(m, "prompt_hash", "left").select("prompt_hash", "name", F.try_element_at("_m", F.col("name")).alias("entity_id"))


def merge_decisions(answers: DataFrame) -> DataFrame:
    """(query_id, decision, entity_id): ``merge`` only where the answer says so and names an entity, else ``new``."""
    j = F.from_json(cleaned(F.col("response")), "STRUCT<decision STRING, entity_id STRING>")
    t = answers.select("query_id", j.alias("j"))
    merge = F.coalesce((F.lower("j.decision") == "merge") & (F.coalesce("j.entity_id", F.lit("")) != ""), F.lit(False))
    return t.select("query_id", F.when(merge, "merge").otherwise("new").alias("decision"), F.when(merge, F.col("j.entity_id")).alias("entity_id"))


def mock(prompts: DataFrame) -> DataFrame:
    """The fixed provider of tests: every judgement is valid with confidence 0.9."""
    return prompts.select("prompt_hash").distinct().withColumn("response", F.lit('{"valid": true, "confidence": 0.9, "reasoning": "mock_reasoning"}'))


def batched(claims: DataFrame, size: int = 20, group: str = "paper_id") -> DataFrame:
    """(group, batch, claim_ords): the claims of each group in batches of ``size`` by ``claim_ord``."""
    w = Window.partitionBy(group).orderBy("claim_ord")
    b = claims.select(group, "claim_ord", F.floor((F.row_number().over(w) - 1) / size).alias("batch"))
    return b.groupBy(group, "batch").agg(F.array_sort(F.collect_list("claim_ord")).alias("claim_ords"))


def positional(batches: DataFrame, answers: DataFrame, *keys: str) -> DataFrame:
    """(claim_ord, response): the answer list of each batch (keys, response) dealt to its claims by position; null where it is too short or no list."""
    a = answers.select(*keys, F.from_json(cleaned(F.col("response")), "ARRAY<STRING>").alias("_a"))
    t = batches.join(a, list(keys), "left").select(F.posexplode("claim_ords").alias("_k", "claim_ord"), "_a")
    return t.select("claim_ord", F.get("_a", F.col("_k")).alias("response"))


def uncached(claims: DataFrame, cache: DataFrame) -> DataFrame:
    """The claims whose fingerprint (subject, relation, object, paper) no cached verdict has."""
    key = X.fingerprint(*[F.coalesce(F.col(c), F.lit("")) for c in ("subject", "relation", "object", "source_paper_id")])
    return claims.withColumn("fingerprint", key).join(cache.select("fingerprint").distinct(), "fingerprint", "left_anti")


def triples_from(answers: DataFrame) -> DataFrame:
    """(path, kind, name, note) of items in mentor answers; items of other kinds or without name or note go."""
    item = "STRUCT<`类型` STRING, `名称` STRING, `片段` STRING>"
    r = cleaned(F.col("response"))
    t = answers.select("path", F.posexplode(X.json_maps(F.get_json_object(F.when(r.startswith("{"), r), "$.items"), item)).alias("pos", "i"))
    text = lambda c: X.strip(F.coalesce(F.col(f"i.{c}"), F.lit("")))
    t = t.select("path", "pos", text("类型").alias("kind"), text("名称").alias("name"), text("片段").alias("note"))
    return t.filter(F.col("kind").isin("概念", "关系") & (F.col("name") != "") & (F.col("note") != ""))


def cleaned(response: Column) -> Column:
    """the text inside a fence, else the text without loose fence marks."""
    r = X.strip(F.coalesce(response, F.lit("")))
    inner = F.regexp_extract(r, r"(?s)^```(?:json)?\s*\n?(.*?)\n?```\s*$", 1)
    loose = F.regexp_replace(r, r"^```(?:json)?\s*|\s*```$", "")
    return X.strip(F.when(inner != "", inner).otherwise(loose))


def decoded_claims(answers: DataFrame) -> DataFrame:
    """(prompt_hash, pos, claim_type, subject, relation, object, evidence) of responses.

    A map gives its lists ``ontology`` and ``instances``; without both, the first filled list of claims, results, data, items counts as
    instances, and so does a bare list. Text that is no JSON, and entries that are no map, give no rows.
    """
    t = answers.select("prompt_hash", cleaned(F.col("response")).alias("r")).filter(F.try_parse_json("r").isNotNull())
    keys = ("ontology", "instances", "claims", "results", "data", "items")
    m = F.from_json("r", "STRUCT<" + ", ".join(f"{k} STRING" for k in keys) + ">")
    some = lambda x: F.when(F.ltrim(x).startswith("["), X.json_maps(x, CLAIM))
    t = t.withColumn("m", F.when(F.col("r").startswith("{"), m))
    lists = {k: some(F.col(f"m.{k}")) for k in keys}
    none = F.from_json(F.lit("[]"), f"ARRAY<{CLAIM}>")
    onto, inst = F.coalesce(lists["ontology"], none), F.coalesce(lists["instances"], none)
    flat = F.coalesce(*[F.when(lists[k].isNotNull(), lists[k]) for k in keys[2:]], none)
    inst = F.when(F.col("r").startswith("["), some(F.col("r"))).when((F.size(onto) == 0) & (F.size(inst) == 0), flat).otherwise(inst)
    typed = lambda a, name: F.transform(F.filter(a, lambda x: x.isNotNull()), lambda x: F.struct(F.lit(name).alias("claim_type"), x.alias("c")))
    t = t.select("prompt_hash", F.posexplode(F.concat(typed(onto, "ontology"), typed(inst, "instance"))).alias("pos", "e"))
    return t.select("prompt_hash", "pos", "e.claim_type", "e.c.*")


def validated(claims: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Claims with status, validation_type, confidence.

    The structural rules come first. Then verdicts (claim_ord, response) decide; a missing or malformed one rejects with
    ``format_error``. Without verdicts every remaining claim is accepted with confidence 1.
    """
    t = claims.withColumn("_why", C.structural_verdict())
    if verdicts is None:
        ok, kind, sure = F.lit(True), F.lit("new"), F.lit(1.0)
    else:
        j = F.from_json(cleaned(F.col("response")), "STRUCT<valid BOOLEAN, type STRING, confidence DOUBLE>")
        t = t.join(verdicts.select("claim_ord", j.alias("_j")), "claim_ord", "left")
        ok = F.coalesce("_j.valid", F.lit(False))
        kind = F.when(F.col("_j.valid").isNull(), "format_error").otherwise(F.coalesce("_j.type", F.lit("new")))
        sure = F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_j.confidence", F.lit(0.0))))).otherwise(F.coalesce("_j.confidence", F.lit(0.0)))
    fine = F.col("_why").isNull()
    out = t.withColumn("status", F.when(fine & ok, "validated").otherwise("rejected")).withColumn("validation_type", F.when(fine, kind).otherwise(F.col("_why")))
    return out.withColumn("confidence", F.when(fine, sure).otherwise(0.0)).drop("_why", "_j")
