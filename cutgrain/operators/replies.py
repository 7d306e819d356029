"""Providers' HTTP replies: what each means, and answers of all of them in one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutgrain.functions.variants import boolean, items, number, string

#: Providers' names in messages (fixed values).
LABELS = {"anthropic": "Anthropic", "openai": "OpenAI", "gemini": "Gemini"}

#: What replies other than answers say (fixed values): provider, status, texts of which one is in `where` ("message" in lower
#: case, "Message" as it is, "code" whole), outcome. The first row that fits counts; a reply that none fits is rejected.
STATUS = (
    ("*", (401, 403), None, (), "key_rejected"),
    ("anthropic", (402,), None, (), "out_of_credit"),
    ("anthropic", (400,), "message", ("credit balance",), "out_of_credit"),
    ("anthropic", (400,), "message", ("usage limit", "spend limit", "spending limit"), "limit_reached"),
    ("openai", (429,), "code", ("insufficient_quota",), "out_of_credit"),
    ("gemini", (400,), "detail", ("API_KEY_INVALID",), "key_rejected"),
    ("gemini", (400,), "Message", ("API key not valid", "API key expired"), "key_rejected"),
    ("gemini", (429,), "message", ("prepayment", "credits are depleted"), "out_of_credit"),
    ("*", (429,), None, (), "rate_limited"),
    ("*", (500, 502, 503), None, (), "retry"),
    ("anthropic", (529,), None, (), "retry"),
    ("openai", (504,), None, (), "retry"),
    ("gemini", (504,), None, (), "retry"),
)

#: Outcomes that end a whole run, with the message of each (fixed values).
STOPS_RUN = {"key_rejected": "Stopped: {} rejected the key. Check it in Settings.", "out_of_credit": "Stopped: the {} account has no credit left.", "limit_reached": "Stopped: {}"}

#: Why a file failed (fixed values); of other outcomes the provider's own message says so.
REASONS = {"key_rejected": "{} rejected the key", "out_of_credit": "The {} account has no credit left", "network": "Network error", "timeout": "No answer in time", "bad_answer": "The answer could not be read", "cancelled": "Cancelled"}

#: provider -> (finish reason -> stop reason), others as they are (fixed values).
STOP_REASONS = {
    "anthropic": {},
    "openai": {"stop": "end_turn", "length": "max_tokens", "content_filter": "refusal"},
    "gemini": {"STOP": "end_turn", "": "end_turn", "MAX_TOKENS": "max_tokens", "SAFETY": "refusal", "BLOCKLIST": "refusal", "PROHIBITED_CONTENT": "refusal", "SPII": "refusal", "RECITATION": "refusal", "IMAGE_SAFETY": "refusal"},
}


def _any(column: Column, texts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for x in texts:
        found = found | F.contains(column, F.lit(x))
    return found


def _label(provider: Column) -> Column:
    return F.coalesce(*[F.when(provider == k, v) for k, v in LABELS.items()], provider)


def _filled(by: dict[str, str], outcome: Column, provider: Column, message: Column) -> Column:
    """The sentence of an outcome with the provider's name, or for a reached limit its message, in it."""
    what = F.when(outcome == "limit_reached", message).otherwise(_label(provider))
    return F.coalesce(*[F.when(outcome == k, F.replace(F.lit(v), F.lit("{}"), what)) for k, v in by.items()])


def classify(replies: DataFrame, wait_s: float = 20.0) -> DataFrame:
    """(provider, status, raw, retry_after_s double) -> the same with outcome, message, wait_s, reason and stops_run.

    outcome is answer (status 200), key_rejected, out_of_credit, limit_reached, rate_limited, retry or rejected. wait_s is
    how long a rate limit asks to wait: what the body says (Gemini), else retry_after_s, else `wait_s`. reason is what the
    list of failures shows; stops_run is the run's last message where no other request would do better, else null.
    """
    p, status = F.col("provider"), F.col("status")
    j = F.try_parse_json("raw")
    own = string(j, "$.error.message")
    message = F.coalesce(own, F.concat(F.lit("HTTP "), status.cast("string")))
    details = F.coalesce(items(j, "$.error.details"), F.expr("cast(array() as array<variant>)"))
    looks = {"message": lambda x: _any(F.lower(message), x), "Message": lambda x: _any(F.coalesce(own, F.lit("")), x), "code": lambda x: F.coalesce(string(j, "$.error.code"), F.lit("")).isin(*x), "detail": lambda x: F.exists(details, lambda d: F.coalesce(string(d, "$.reason").isin(*x), F.lit(False)))}
    rules = [F.when(status == 200, "answer")]
    for provider, statuses, where, texts, outcome in STATUS:
        fits = status.isin(*statuses) & (F.lit(True) if provider == "*" else p == provider) & (looks[where](texts) if where else F.lit(True))
        rules.append(F.when(fits, outcome))
    delays = F.filter(F.transform(details, lambda d: F.regexp_extract(string(d, "$.retryDelay"), r"^([0-9]+(?:[.][0-9]+)?)s$", 1).try_cast("double")), lambda x: x.isNotNull())
    asked = F.when(p == "gemini", F.ceil(F.try_element_at(delays, F.lit(1))).cast("double"))
    got = replies.withColumns({"message": F.when(status != 200, message), "outcome": F.coalesce(*rules, F.lit("rejected"))})
    outcome = F.col("outcome")
    got = got.withColumn("wait_s", F.when(outcome == "rate_limited", F.coalesce(asked, "retry_after_s", F.lit(float(wait_s)))))
    reason = F.coalesce(_filled(REASONS, outcome, p, F.col("message")), F.col("message"))
    return got.withColumns({"reason": F.when(~outcome.isin("answer", "rate_limited", "retry"), reason), "stops_run": _filled(STOPS_RUN, outcome, p, F.col("message"))})


def _tokens(v: Column, path: str) -> Column:
    """A whole JSON number that isn't negative, else 0."""
    n = number(v, path)
    whole = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BIGINT"
    return F.when(whole & (n >= 0), n).otherwise(0.0).cast("bigint")


def read_envelopes(replies: DataFrame) -> DataFrame:
    """(clip_id, provider, raw) -> (clip_id, body, stop_reason, input_tokens, output_tokens, error_kind): each provider's answer
    as one shape. Parts of a text are joined, thoughts left out; thinking tokens count as output. A finished answer that isn't
    JSON is bad, as is a reply without an answer; a blocked prompt and a refusal are refusals, and their body is null."""
    j, p = F.col("j"), F.col("provider")
    none = F.expr("cast(array() as array<variant>)")
    joined = lambda path, keep: F.array_join(F.transform(F.filter(F.coalesce(items(j, path), none), keep), lambda x: F.coalesce(string(x, "$.text"), F.lit(""))), "")
    r = replies.withColumn("j", F.try_parse_json("raw"))
    said = lambda path: F.coalesce(string(j, path), F.lit(""))
    body = (
        F.when(p == "anthropic", joined("$.content", lambda x: F.coalesce(string(x, "$.type") == "text", F.lit(False))))
        .when(p == "openai", said("$.choices[0].message.content"))
        .when(p == "gemini", joined("$.candidates[0].content.parts", lambda x: ~F.coalesce(boolean(x, "$.thought"), F.lit(False))))
    )
    finish = F.when(p == "anthropic", said("$.stop_reason")).when(p == "openai", said("$.choices[0].finish_reason")).when(p == "gemini", said("$.candidates[0].finishReason"))
    candidate = F.try_variant_get(j, "$.candidates[0]", "variant")
    empty = (p == "gemini") & (candidate.isNull() | F.is_variant_null(candidate))
    blocked = empty & string(j, "$.promptFeedback.blockReason").isNotNull()
    refused = (p == "openai") & (said("$.choices[0].message.refusal") != "") | blocked
    mapped = F.coalesce(*[F.when((p == k) & (finish == a), F.lit(b)) for k, by in STOP_REASONS.items() for a, b in by.items()], finish)
    inp = F.when(p == "anthropic", _tokens(j, "$.usage.input_tokens")).when(p == "openai", _tokens(j, "$.usage.prompt_tokens")).otherwise(_tokens(j, "$.usageMetadata.promptTokenCount"))
    out = F.when(p == "anthropic", _tokens(j, "$.usage.output_tokens")).when(p == "openai", _tokens(j, "$.usage.completion_tokens")).otherwise(_tokens(j, "$.usageMetadata.candidatesTokenCount") + _tokens(j, "$.usageMetadata.thoughtsTokenCount"))
    got = r.select("clip_id", F.when(~refused, body).alias("body"), F.when(refused, "refusal").when(empty, "").otherwise(mapped).alias("stop_reason"), inp.alias("input_tokens"), out.alias("output_tokens"), (empty & ~blocked).alias("nothing"))
    json = F.try_parse_json("body")
    bad = F.col("nothing") | (F.col("stop_reason") == "end_turn") & (json.isNull() | F.is_variant_null(json))
    return got.withColumn("error_kind", F.when(bad, "bad_answer")).drop("nothing")
