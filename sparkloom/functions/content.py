"""Column functions over JSON and structured content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Argument names that may hold a path, by priority.
PATH_KEYS = ("file_path", "filePath", "path", "filename", "file")


def path_argument(arguments: Column, keys=PATH_KEYS) -> Column:
    """The first non-empty path argument of a tool call's JSON; null if there is none or it isn't JSON."""
    return F.coalesce(*[F.nullif(F.get_json_object(arguments, f"$.{k}"), F.lit("")) for k in keys])


def flatten_content(c: Column) -> Column:
    """A message's text from JSON: a string, a list of parts with text, or an object with text or content."""
    parts = F.from_json(c, "array<struct<type: string, text: string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "\n")
    return F.when(F.ltrim(c).startswith("["), joined).when(F.ltrim(c).startswith("{"), F.coalesce(F.get_json_object(c, "$.text"), F.get_json_object(c, "$.content"))).otherwise(c)


def decode_structured(c: Column) -> Column:
    """Structured JSON, plain or behind `b64:`; null if it isn't JSON."""
    plain = F.when(c.startswith("b64:"), F.try_to_binary(F.substring(c, 5, 1 << 30), F.lit("base64")).cast("string")).otherwise(c)
    return F.when(F.try_parse_json(plain).isNotNull(), plain)


def encode_structured(c: Column) -> Column:
    return F.concat(F.lit("b64:"), F.base64(c.cast("binary")))


def extracted_facts(c: Column) -> Column:
    """Facts of an extractor's JSON answer, its code fence off: bare strings get defaults, confidence is clamped to [0, 1], unknown types become observations, blanks go."""
    bare = F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    items = F.from_json(F.get_json_object(bare, "$.facts"), "array<string>")
    kinds = ["goal", "decision", "error", "state", "file_state", "tool_result", "observation"]
    one = lambda x: F.struct(
        F.coalesce(F.get_json_object(x, "$.content"), F.when(~F.ltrim(x).startswith("{"), x)).alias("content"),
        F.when(F.get_json_object(x, "$.fact_type").isin(kinds), F.get_json_object(x, "$.fact_type")).otherwise("observation").alias("fact_type"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.get_json_object(x, "$.confidence").try_cast("double"), F.lit(0.5)))).alias("confidence"),
    )
    return F.filter(F.transform(items, one), lambda f: F.coalesce(F.trim(f["content"]), F.lit("")) != "")


def overlay(base: Column, over: Column, allowed: list[str], denied: list[str]) -> Column:
    """A config map with the overlay's allowed and not denied keys laid over it."""
    fit = F.map_filter(over, lambda k, v: k.isin(allowed) & ~k.isin(denied))
    rest = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(fit), k))
    return F.map_concat(rest, fit)


def delta(base: Column, now: Column) -> Column:
    """Keys whose value differs from base."""
    return F.map_filter(now, lambda k, v: ~F.element_at(base, k).eqNullSafe(v))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for empty arrays, different lengths or zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def sse_payload(line: Column) -> Column:
    """The JSON of an SSE line; null for other lines and for the end mark."""
    body = F.trim(F.substring(line, 6, 1 << 30))
    return F.when(line.startswith("data:") & (body != "[DONE]"), body)


def sse_lines(answer: Column) -> Column:
    """An answer's text as SSE lines: one chunk with the content, then the end mark."""
    chunk = F.to_json(F.struct(F.array(F.struct(F.struct(answer.alias("content")).alias("delta"))).alias("choices")))
    return F.array(F.concat(F.lit("data: "), chunk), F.lit("data: [DONE]"))
