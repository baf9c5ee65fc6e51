"""Enrichment: prompts, replies, cache. The model is a function of the caller, run once for each distinct new text."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark import workspace
from vellumspark.config import ENRICHMENTS, EnrichmentConfig
from vellumspark.functions import text as T
from vellumspark.operators import graph

SECONDS_SAVED_BY_HIT = 1.5

#: A model: prompts in, for each a reply or an exception object.
Model = Callable[[list[str]], list]


#: What a chat model is told ahead of every prompt.
SYSTEM = "You index passages for a search engine. Answer with one JSON object and nothing else."


def chat_model(call: Callable[[list[dict[str, str]], str, float], str], config: EnrichmentConfig) -> Model:
    """A model of a chat service: call(messages, model, temperature) gives a reply's text; the settings come from config."""

    def model(prompts: list[str]) -> list:
        out: list = []
        for p in prompts:
            try:
                out.append(call([{"role": "system", "content": SYSTEM}, {"role": "user", "content": p}], config.model, config.temperature))
            except Exception as failure:  # noqa: BLE001 - the caller decides whether to ask again
                out.append(failure)
        return out

    return model


def prompt(text: Column, context: Column) -> Column:
    where = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("It stands under the headings: "), context)).otherwise(F.lit("Its headings are not known."))
    ask = 'Describe the passage below as one JSON object. Keys: "summary" (one sentence), "entities" (names, places, sums and dates that occur), "keywords" (three to eight search terms), "confidence" (0 to 1: can it be read by itself?). Reply with the object only.'
    return F.concat(F.lit(ask + "\n"), where, F.lit("\n---\n"), text, F.lit("\n---"))


# --- replies --------------------------------------------------------------------------------------------------


def parsed(reply: Column) -> Column:
    """VARIANT of a reply: as JSON, else what its first code fence holds, else from the first { to the last }; or null."""
    whole = T.strip(reply)
    fence = T.strip(F.regexp_extract(whole, r"(?s)```(?:json)?\s*(.*?)\s*```", 1))
    fenced = F.regexp_like(whole, F.lit(r"(?s)```(?:json)?\s*.*?\s*```"))
    rest = F.when(fenced, fence).otherwise(whole)
    braces = F.regexp_extract(rest, r"(?s)(\{.*\})", 1)
    as_json = lambda c: F.try_parse_json(T.nonempty(c))
    return F.coalesce(as_json(whole), F.when(fenced, as_json(fence)), as_json(braces))


def _truthy(value: Column) -> Column:
    """JSON text of a value, or null where Python would call it false."""
    return F.when(~value.isin("null", '""', "[]", "{}", "false", "0", "0.0", "-0.0", "-0"), value)


def _plain(value: Column) -> Column:
    """A JSON string without its quotes; other JSON as it stands."""
    return F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(F.when(value == "true", "True").when(value == "null", "None").otherwise(value))


def _listed(value: Column) -> Column:
    """A JSON array's items as strings; anything else as an array of one."""
    return F.when(value.startswith("["), F.transform(F.from_json(value, "array<string>"), lambda x: F.coalesce(x, F.lit("None")))).otherwise(F.array(_plain(value)))


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of value, which a lambda's variable holds, so that it is worked out once and not at each mention."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _entries(reply: Column) -> Column:
    """A JSON object's keys in lower case with their values' JSON text, and that text where Python would call it true."""
    shown = F.transform(F.map_entries(reply.cast("map<string,variant>")), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value")))
    return F.transform(shown, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), _truthy(e["value"]).alias("truthy")))


def _entry(entries: Column, key: str) -> Column:
    """The entry of a key, null where it isn't there; of keys that differ in case the last one counts."""
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))


ALIASES = {
    "summary": ("summary", "description"),
    "entities": ("entities", "named_entities", "named entities"),
    "keywords": ("keywords", "tags"),
    "confidence": ("confidence", "score"),
}


def fields(reply: Column, enrichments: tuple[str, ...] = ENRICHMENTS) -> Column:
    """A struct of the asked-for fields of a VARIANT reply; null where it doesn't have them, or isn't an object.

    Keys don't depend on case. A false value (empty, 0, null) gives way to the next alias; the last alias counts as it is.
    To be made a column of its own ahead of its fields, so that it is worked out once for all of them.
    """
    found = F.when(F.schema_of_variant(reply).startswith("OBJECT"), _entries(reply))

    def field(m: Column, name: str) -> Column:
        *first, last = ALIASES[name]
        return F.coalesce(*[_entry(m, k)["truthy"] for k in first], _entry(m, last)["value"])

    def shown(v: Column, name: str) -> Column:
        known = v.isNotNull() & (v != "null")
        if name == "summary":
            return F.when(known, _plain(v))
        if name == "confidence":
            number = _bound(_plain(v).try_cast("double"), lambda n: F.when(F.isnan(n), 0.0).otherwise(F.coalesce(n, F.lit(0.0))))
            return F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
        return F.when(known, _listed(v))

    values = _bound(found, lambda m: F.struct(*[field(m, name).alias(name) for name in enrichments]))
    return _bound(values, lambda v: F.struct(*[shown(v[name], name).alias(name) for name in enrichments]))


def extracted(reply: Column, enrichments: tuple[str, ...] = ENRICHMENTS) -> dict[str, Column]:
    """The fields as columns, each of which works out all of them."""
    return {name: fields(reply, enrichments)[name] for name in enrichments}


# --- the cache and the model ----------------------------------------------------------------------------------


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def with_cache(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks with text_hash, payload (null for a miss) and cache_status.

    A chunk hits where the cache has its text, or where an earlier chunk of the same text is asked about first.
    cache: text_hash, payload.
    """
    rows = chunks.withColumn("text_hash", text_hash(F.col("text")))
    # a row for each distinct text says who asks first and what is known, so a hot text's chunks are only looked up
    first = rows.groupBy("text_hash").agg(F.min(F.struct("doc_id", "chunk_index")).alias("first"))
    seen = first.join(cache.select("text_hash", "payload"), "text_hash", "left").toDF("seen_hash", "first", "payload")
    # equal texts have equal hashes; texts without one (nulls) have the null hash in common
    rows = rows.join(seen, F.col("text_hash").eqNullSafe(F.col("seen_hash")), "left")
    asks = F.struct("doc_id", "chunk_index").eqNullSafe(F.col("first"))
    return rows.withColumn("cache_status", F.when(F.col("payload").isNotNull() | ~asks, "HIT").otherwise("MISS")).drop("seen_hash", "first")


def cache_stats(looked_up: DataFrame, entries: Column | None = None) -> DataFrame:
    """hits, misses, entries, hit_rate_percent, calls_saved, time_saved_seconds."""
    hits = F.count_if(F.col("cache_status") == "HIT")
    misses = F.count_if(F.col("cache_status") == "MISS")
    known = F.countDistinct("text_hash") if entries is None else entries
    rate = F.when(hits + misses > 0, F.round(hits * 100.0 / (hits + misses), 1)).otherwise(0.0)
    return looked_up.agg(hits.alias("hits"), misses.alias("misses"), known.alias("entries"), rate.alias("hit_rate_percent"), hits.alias("calls_saved"), F.round(hits * SECONDS_SAVED_BY_HIT, 2).alias("time_saved_seconds"))


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """(text_hash, payload) of both; where both have a text, the new payload."""
    both = cache.select("text_hash", "payload", F.lit(0).alias("age")).unionByName(new.select("text_hash", "payload", F.lit(1).alias("age")))
    return both.groupBy("text_hash").agg(F.max_by("payload", "age").alias("payload"))


def extractive_model(prompts: list[str]) -> list[str]:
    """An offline stand-in for a language model, of our own: first sentence, capitalised words, frequent words."""
    import re
    from collections import Counter

    out = []
    for p in prompts:
        body = p.split("\n---\n", 1)[-1].removesuffix("\n---")
        said = re.split(r"(?<=[.!?])\s+", body.strip())
        names = list(dict.fromkeys(re.findall(r"(?<=[a-z,] )([A-Z]\w{2,})", body)))[:8]
        common = Counter(w for w in re.findall(r"\w+", body.lower()) if len(w) > 4)
        terms = [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:5]]
        out.append(json.dumps({"summary": said[0][:200], "entities": names, "keywords": terms, "confidence": min(1.0, len(body) / 400)}, ensure_ascii=False))
    return out


def ask(misses: DataFrame, model: Model, config: EnrichmentConfig, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(text_hash, payload, prompt_tokens, completion_tokens): replies to (text_hash, prompt), one row each.

    A batch's prompts are asked max_concurrency at a time, each up to max_retries times with pauses of 1, 2, 4 ...
    seconds; a prompt that keeps failing has a null payload. Prompts and replies count as words.
    """

    def reply_to(prompt: str) -> str | None:
        for turn in range(config.max_retries):
            try:
                found = model([prompt])[0]
            except Exception:  # noqa: BLE001 - a model's failure is a blank chunk, not a failed job
                found = None
            if isinstance(found, str):
                return found
            wait(2.0**turn)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(min(config.batch_size, config.max_concurrency)) as pool:
            for batch in batches:
                for low in range(0, len(batch), config.batch_size):
                    part = batch.iloc[low : low + config.batch_size]
                    replies = list(pool.map(reply_to, part["prompt"]))
                    words = [[len((t or "").split()) for t in texts] for texts in (part["prompt"], replies)]
                    yield pd.DataFrame({"text_hash": part["text_hash"].to_numpy(), "payload": replies, "prompt_tokens": words[0], "completion_tokens": words[1]})

    return misses.mapInPandas(run, "text_hash string, payload string, prompt_tokens long, completion_tokens long")


def enrich(chunks: DataFrame, cache: DataFrame, model: Model = extractive_model, config: EnrichmentConfig | None = None, keep: Callable[[DataFrame], DataFrame] = workspace.kept) -> tuple[DataFrame, DataFrame]:
    """(chunks with enrichments and neighbours' summaries, replies of this run: text_hash, payload and tokens).

    keep materialises the replies, so that a model is asked once whatever is read from them later; the default writes
    them to the workspace.
    """
    config = config or EnrichmentConfig()
    looked = with_cache(chunks, cache)
    new = looked.where("payload is null").groupBy("text_hash").agg(F.min_by(F.struct("text", "parent_context"), F.struct("doc_id", "chunk_index")).alias("c"))
    replies = keep(ask(new.select("text_hash", prompt(F.col("c.text"), F.col("c.parent_context")).alias("prompt")), model, config))
    answered = replies.select("text_hash", F.col("payload").alias("reply"))
    rows = looked.join(answered, "text_hash", "left").withColumn("_reply", parsed(F.coalesce("payload", "reply")))
    # a first call that failed isn't in the cache: its later twins missed as well
    rows = rows.withColumn("cache_status", F.when(F.coalesce("payload", "reply").isNull(), "MISS").otherwise(F.col("cache_status")))
    rows = rows.withColumn("_found", fields(F.col("_reply"), config.enrichments))
    rows = rows.withColumns({k: F.coalesce(F.col("_found")[k], F.col(k)) for k in config.enrichments})
    return graph.neighbor_summaries(rows.drop("_reply", "_found", "reply", "payload", "text_hash")), replies


def usage(replies: DataFrame, prompt_price: float | None = None, completion_price: float | None = None) -> DataFrame:
    """Tokens of all replies, and their cost where the prices of a thousand are given (null where they aren't)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    said = replies.agg(total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"), total(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
    known = prompt_price is not None or completion_price is not None
    cost = F.col("prompt_tokens") / 1000 * (prompt_price or 0.0) + F.col("completion_tokens") / 1000 * (completion_price or 0.0) if known else F.lit(None)
    return said.withColumn("cost", cost.cast("double"))
