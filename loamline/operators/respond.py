"""From requests to responses and audit records, as one batched plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions import predicates as p
from loamline.functions.scalar import https_source, source_label
from loamline.operators.answers import validated
from loamline.operators.retrieve import FINAL_K, RAW_K, passages, retrieve

# What a model is told, and what a text message says instead of an answer.
INSTRUCTION = "Answer from these passages if relevant; otherwise reply NOT_ENOUGH_INFORMATION. Each factual sentence must end with a [n] citation."
NOTHING_FOUND, UNABLE = "No authoritative information found.", "Unable to provide information."


def canonical_request(raw: DataFrame) -> DataFrame:
    """raw: request_id, language, channel, query, question, asr_confidence (text or number). Adds the trimmed, lower-cased form and the first fault."""
    trim = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    out = raw.withColumn("language", F.lower(trim(F.col("language")))).withColumn("channel", F.lower(trim(F.col("channel"))))
    out = out.withColumn("query", trim(F.coalesce(F.nullif("query", F.lit("")), F.col("question")))).withColumn("asr_confidence", F.when(F.col("channel") == "voice", F.expr("try_cast(asr_confidence AS double)")))
    # Numbers that can't be read count as not given.
    for k in ("top_k", "raw_k"):
        if k in raw.columns:
            out = out.withColumn(k, F.expr(f"try_cast({k} AS int)"))
    return out.withColumn("error", p.request_error(F.col("language"), F.col("channel"), F.col("query"), F.col("asr_confidence")))


def gate(requests: DataFrame) -> DataFrame:
    """Adds guidance_key: why a request is refused before anything is looked up, the cheapest reason first."""
    return requests.withColumn("guidance_key", F.coalesce(F.when(F.col("error").isNotNull(), "refusal_invalid_request"), p.asr_refusal(F.col("channel"), F.col("asr_confidence")), p.blocked_intent(F.col("query"))))


def prompt(language: Column, query: Column, found: Column) -> Column:
    said = F.array_join(F.transform(found, lambda x: F.concat(x["number"].cast("string"), F.lit(". "), F.regexp_replace(F.coalesce(x["text"], F.lit("")), r"(?U)^\s+|\s+$", ""), F.lit("\n"))), "")
    return F.concat(F.lit("LANGUAGE: "), language, F.lit("\n\nPASSAGES:\n"), said, F.lit("\nQUESTION:\n"), query, F.lit("\n\n" + INSTRUCTION))


def citations(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["number"].alias("citation"), x["chunk_id"].alias("chunk_id"), https_source(x["source_url"]).alias("source_url"), x["meta"].alias("meta")))


def echo(prompt_text: Column) -> Column:
    """A deterministic stand-in for a generation model: the first passage's first 80 characters with a citation."""
    return F.concat(F.substring(F.regexp_extract(prompt_text, r"\n1\. ([^\n]*)", 1), 1, 80), F.lit(" [n]."))


def guarded(generate: Callable[[str], str]) -> Callable[[Column], Column]:
    """A model from a Python function of one prompt. Where it fails, twice, that request alone is refused."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def once(text):
            for _ in range(2):
                try:
                    return generate(text)
                except Exception:  # noqa: BLE001  whatever a model's client raises
                    continue
            return None

        for prompts in batches:
            yield prompts.map(once, na_action="ignore").astype(object)

    return run


def answer(raw: DataFrame, chunks: DataFrame, generate: Callable[[Column], Column] = echo, strict: bool = False, raw_k: int = RAW_K, final_k: int = FINAL_K, compose: bool = True) -> DataFrame:
    """A response per request: request_id, resolution, guidance_key, answer_lines, citations, sources, confidence, citation_missing, top_similarity, used_chunk_ids.

    raw: as canonical_request() and an embedding of the query. Requests that a
    gate refuses are never looked up.
    """
    asked = gate(canonical_request(raw))
    open_ = asked.where("guidance_key is null")
    found = passages(retrieve(open_.select("request_id", "embedding", *(c for c in ("filters", "top_k", "raw_k") if c in raw.columns)), chunks, raw_k, final_k, compose=compose))
    out = asked.join(found, "request_id", "left")
    out = out.withColumn("prompt", F.when(F.col("enough"), prompt(F.col("language"), F.col("query"), F.col("passages"))))
    out = out.withColumn("generated", F.when(F.col("prompt").isNotNull(), generate(F.col("prompt")))).withColumn("most", F.array_max(F.transform("passages", lambda x: x["number"])))
    out = validated(out, "generated", "most")
    resolution = (
        F.when(F.col("guidance_key").isNotNull(), "refusal")
        .when(~F.coalesce("enough", F.lit(False)), "not_enough_info")
        .when(F.col("generated").isNull(), "refusal")  # the model failed
        .when(F.col("decision") == "NOT_ENOUGH_INFORMATION", "not_enough_info")
        .when((F.col("decision") != "ACCEPT") & F.lit(strict), "invalid_output")
        .otherwise("answer")
    )
    out = out.withColumn("resolution", resolution).withColumn("cites", citations(F.col("passages")))
    answered, accepted = F.col("resolution") == "answer", F.col("decision") == "ACCEPT"
    return out.select(
        "request_id", "language", "channel", "query", "resolution", "guidance_key", "top_similarity",
        F.when(answered, F.when(accepted, F.transform("cited", lambda c: c["text"])).otherwise(F.array(F.trim("generated")))).alias("answer_lines"),
        F.when(answered & accepted, F.col("cites")).alias("citations"),
        F.when(answered, F.transform("cites", lambda c: c["source_url"])).alias("sources"),
        F.when(answered, F.when(accepted, "high").otherwise("low")).alias("confidence"),
        F.when(answered & ~accepted, True).alias("citation_missing"),
        F.coalesce(F.transform("passages", lambda x: x["chunk_id"]), F.array().cast("array<string>")).alias("used_chunk_ids"),
    )


def web_language(language: Column) -> Column:
    """The language, or English for one that isn't served."""
    value = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    return F.when(value.isin(*p.LANGUAGES), value).otherwise("en")


def sms(responses: DataFrame) -> DataFrame:
    """One text message per response: the first line and its source's host, or why there is none."""
    label = source_label(F.get(F.col("citations"), F.lit(0))["source_url"])
    said = F.concat(F.coalesce(F.get(F.col("answer_lines"), F.lit(0)), F.lit("")), F.coalesce(F.concat(F.lit("\nSource: "), label), F.lit("")))
    refused = F.when(F.col("resolution") == "not_enough_info", NOTHING_FOUND).otherwise(UNABLE)
    answered = F.col("resolution") == "answer"
    return responses.select("request_id", F.when(answered, said).otherwise(refused).alias("message"), F.when(~answered, F.coalesce("guidance_key", "resolution")).alias("reason"))


def web(responses: DataFrame, *more: str) -> DataFrame:
    """Responses with citations cut down to their sources."""
    return responses.select("request_id", "resolution", "guidance_key", "answer_lines", F.transform("citations", lambda c: c["source_url"]).alias("citation_urls"), *more)


def voice(responses: DataFrame) -> DataFrame:
    """As web(), with what was heard: the query of an answered voice request."""
    heard = F.when((F.col("resolution") == "answer") & (F.col("channel") == "voice"), F.col("query"))
    return web(responses.withColumn("transcript", heard), "transcript")


def audit(records: DataFrame, at: Column) -> DataFrame:
    """Audit records by UTC day: the query itself is replaced by its digest."""
    return records.withColumn("query_hash", F.when(F.coalesce("query", F.lit("")) != "", F.sha2("query", 256))).drop("query").withColumn("audit_date", F.date_format(at, "yyyy-MM-dd"))


def write_audit(records: DataFrame, path: str) -> None:
    records.write.mode("append").partitionBy("audit_date").json(path)
