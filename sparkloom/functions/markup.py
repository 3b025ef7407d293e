"""Tool-call markup that leaks into answers: finding and removing it; and values for front matter and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .asking import once

#: A mark behind which nothing of an answer is meant, and pairs of marks that enclose a call; fixed values.
TAIL = "<｜｜DSML｜｜"
BLOCKS = [("<｜tool▁calls▁begin｜>", "<｜tool▁calls▁end｜>"), ("<tool_call>", "</tool_call>")]


def _without(c: Column, first: str, last: str) -> Column:
    """A text without what stands between two marks, the marks included; a first mark without a last one stays."""
    parts = lambda p: F.transform(p, lambda x, i: F.when(i == 0, x).when(F.contains(x, F.lit(last)), F.substring(x, F.instr(x, F.lit(last)) + len(last), F.char_length(x))).otherwise(F.concat(F.lit(first), x)))
    return F.array_join(once(F.split(c, rf"\Q{first}\E", -1), parts), "")


def strip_calls(c: Column) -> Column:
    """An answer without tool-call markup and the blanks at its end."""
    out = F.substring_index(F.coalesce(c, F.lit("")), TAIL, 1)
    for first, last in BLOCKS:
        out = _without(out, first, last)
    return F.regexp_replace(out, r"\s+\z", "")


def has_calls(c: Column) -> Column:
    """Whether a text holds tool-call markup."""
    c = F.coalesce(c, F.lit(""))
    closed = [F.contains(F.substring(c, F.instr(c, F.lit(a)), F.char_length(c)), F.lit(b)) & F.contains(c, F.lit(a)) for a, b in BLOCKS]
    return F.contains(c, F.lit(TAIL)) | closed[0] | closed[1]


def degraded(answer: Column, tokens: Column, least: int) -> Column:
    """Why an answer counts as degraded: too few tokens, or markup in it; null where it doesn't."""
    c = F.coalesce(answer, F.lit(""))
    marked = F.contains(c, F.lit(TAIL))
    for first, _ in BLOCKS:
        marked = marked | F.contains(c, F.lit(first))
    return F.when(tokens < least, F.concat(F.lit("low_tokens ("), tokens.cast("string"), F.lit(f"t < {least}t)"))).when(marked, "markup")


def yaml_value(c: Column) -> Column:
    """A text as a value of front matter: quoted where it holds what has a meaning there."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(c.rlike("[:'\"\n#\\\\]"), quoted).otherwise(c)


def at_least(version: Column, wanted: Column) -> Column:
    """Whether a dotted version is another one or newer; parts that are no numbers count as 0, missing ones too."""
    parts = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^(\d*)", 1).try_cast("long"), F.lit(0).cast("long")))
    both = F.zip_with(parts(version), parts(wanted), lambda a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))
    first = F.get(F.filter(both, lambda d: d != 0), F.lit(0))
    return F.coalesce(first > 0, F.lit(True))
