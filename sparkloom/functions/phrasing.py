"""Column functions that shorten or judge phrases: fact compression, recall and ambiguity, sanitising, commands."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip


def compressed_fact(c: Column, openings, shorter, needless, passes: int = 3) -> Column:
    """A fact without hedging, in shorter words, capitalised, without a closing dot; the fact itself where nothing would be left.

    openings and needless are patterns that go, at the start and anywhere; shorter are pairs of a pattern and what stands for it. All of them
    hang on how the facts were written, so the caller gives them.
    """
    # the phrase is looked for first, as it rarely stands anywhere; only then what stands before it, which mustn't belong to the match before
    at = lambda p: rf"(?i)(?={p})(?:^|(?<=\W)(?!\G)){p}"
    out = strip(F.coalesce(c, F.lit("")))
    for _ in range(passes):
        for p in openings:
            out = F.regexp_replace(out, f"(?i)^{p}", "")
    for p, r in shorter:
        out = F.regexp_replace(out, at(p) + r"(?=\W|$)", r.replace("$1", f"${re.compile(p).groups + 1}"))
    for p in needless:
        out = F.regexp_replace(out, at(p), "")
    out = F.regexp_replace(strip(F.regexp_replace(out, "  +", " ")), r"\.$", "")
    return let(out, lambda x: F.when(x == "", c).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))))


RECALL = ("do you remember", "as we discussed", "what did we decide", "earlier you said", "remind me")


def asks_to_recall(role: Column, c: Column) -> Column:
    """Whether a user's message asks for what was said before."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return (role == "user") & F.exists(F.array(*map(F.lit, RECALL)), lambda p: F.contains(low, p))


def ambiguous(c: Column, most_words: int = 6) -> Column:
    """Whether a short question hangs on what came before: it points at something without naming it."""
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    return (words > 0) & (words <= most_words) & low.rlike(r"(^|\W)(it|that|this|they|them|those|same|again)(\W|$)")


def sanitised_system(c: Column) -> Column:
    """A system prompt without what changes from day to day: dates, times and status sections."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?Z?)?", "<date>")
    out = F.regexp_replace(out, r"(?im)^(?:today|current date|current time|git status|recent commits).*$", "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def session_goal(c: Column, default: str = "Continue the session", most: int = 120) -> Column:
    """A goal in one sentence: fences, tags and role prefixes off; what tries to give orders becomes the default."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)```.*?```", " "), r"<[^>]{1,200}>", "")
    out = strip(F.regexp_replace(F.regexp_replace(out, r"(?im)^\s*(?:user|assistant|system)\s*:\s*", ""), r"\s+", " "))
    first = F.substring(F.regexp_extract(out, r"^(.*?[.!?])(?:\s|$)", 1), 1, most)
    bad = out.rlike(r"(?i)ignore (?:all |any )?(?:previous|prior) instructions|system prompt")
    return F.when((out == "") | bad, F.lit(default)).when(first == "", F.substring(out, 1, most)).otherwise(first)


def file_pattern(path: Column) -> Column:
    """The kind of a file by its name: the last capitalised word and the extensions."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    stem, ext = F.regexp_extract(name, r"^([^.]*)", 1), F.regexp_extract(name, r"^[^.]*(\..+)$", 1)
    word = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(stem, F.lit("([A-Z][a-z0-9]+)"), F.lit(1))), -1)
    return F.concat(F.lit("*"), word, ext)


BUILTINS = ("source", "export", "cd", "unset", "alias", "eval", "set", "exit")


def command_name(c: Column) -> Column:
    """The command that a shell line runs: assignments off, the first of several, shell built-ins as such."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: (w != "") & ~w.rlike(r"^[A-Z_]+=\S*$"))
    first = F.regexp_extract(F.coalesce(F.get(words, F.lit(0)), F.lit("")), r"^([^|;&]*)", 1)
    return F.when(first.isin(*BUILTINS), "builtin").otherwise(first)


def test_counts(c: Column) -> Column:
    """Struct of passed and failed tests that an output names."""
    n = lambda p: F.regexp_extract(F.coalesce(c, F.lit("")), p, 1).try_cast("long")
    return F.struct(n(r"(\d+) passed").alias("passed"), n(r"(\d+) failed").alias("failed"))


def error_lines(c: Column, most: int = 120) -> Column:
    """What follows `error` in the lines of an output."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?:error|Error|ERROR):?\s+([^\n]{0,%d})" % most), F.lit(1))


def outcome(c: Column) -> Column:
    """A tool's outcome by its text: error, soft_error or ok."""
    low = F.lower(F.ltrim(F.coalesce(c, F.lit(""))))
    return F.when(low.startswith("error") | low.startswith("traceback"), "error").when(F.contains(low, F.lit("not found")) | F.contains(low, F.lit("no such file")) | F.contains(low, F.lit("permission denied")), "soft_error").otherwise("ok")


def compressible(tool: Column, names=("read", "grep", "glob", "bash", "search")) -> Column:
    """Whether a tool's results may be shortened: one of these, or a name that ends in one of them behind an underscore."""
    return tool.isin(*names) | F.exists(F.array(*map(F.lit, names)), lambda n: F.endswith(tool, F.concat(F.lit("_"), n)))


def already_shown(text: Column, context: Column, lines: int = 8, fragment: int = 60) -> Column:
    """Whether a context holds a text already: of its first long lines' heads three or more, and at least half, are in it."""
    long = F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.char_length(F.trim(x)) >= 20), 1, lines)
    heads = F.transform(long, lambda x: F.substring(F.trim(x), 1, fragment))
    hits = F.size(F.filter(heads, lambda h: F.contains(F.coalesce(context, F.lit("")), h)))
    return (hits >= 3) & (hits * 2 >= F.size(heads))
