"""Column functions over text: normalising, tokens, similarity, estimates, compression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no relevance; fixed values.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "is", "it", "for", "on", "with", "this", "that", "be", "as", "at", "by", "from",
    "do", "does", "add", "now", "then", "your", "you", "we", "can", "class", "method", "function", "file", "code", "line",
]
#: What a Python str.strip() takes off, within ASCII.
_SPACE = r"[ \t\n\r\f\x0B]"


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of c, which is computed once however often `use` names it; within lambdas Spark computes each mention anew."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\f\x0B"))


def _bare(c: Column) -> Column:
    """Lower case, outer space and then outer quotes off."""
    return F.btrim(strip(F.lower(F.coalesce(c, F.lit("")))), F.lit("\"'`"))


def _unclosed(c: Column) -> Column:
    return F.rtrim(c, F.lit(".!?;:"))


def normalise(c: Column) -> Column:
    """Lower case, outer space and quotes off, inner space to one blank, closing punctuation off."""
    return _unclosed(F.regexp_replace(_bare(c), f"{_SPACE}+", " "))


def tokens(c: Column) -> Column:
    """The set of blank-separated words of the normalised text, as an array."""
    c = _unclosed(_bare(c))
    for space in "\t\n\r\f\x0B":  # plain replacements, and a split at a plain blank, take a fraction of a pattern's time
        c = F.replace(c, F.lit(space), F.lit(" "))
    return F.array_remove(F.array_distinct(F.split(c, " ")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Size of intersection by size of union of two token arrays; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / F.size(F.array_union(a, b)))


def content_hash(c: Column) -> Column:
    """Hash of the normal form; declared as never null, or else each join on it filters by it first and makes it twice."""
    return F.coalesce(F.substring(F.sha2(normalise(c), 256), 1, 32), F.lit(""))


def identifiers(c: Column) -> Column:
    """Distinct lower-case identifiers of two characters or more, without stop words."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[a-zA-Z_][a-zA-Z0-9_]+"), F.lit(0)), F.lower)
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))


def keyword_relevance(query: Column, text: Column) -> Column:
    """Share of the query's identifiers that the text has."""
    q, t = identifiers(query), identifiers(text)
    return F.when((F.size(q) == 0) | (F.size(t) == 0), 0.0).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def importance(c: Column) -> Column:
    """The first number of a reason, on a scale to 1; 0.5 without one."""
    n = F.try_to_number(F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1), F.lit("")), F.lit("999999999.999999999")).cast("double")
    return F.when(n.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.when(n > 1, n / 10).otherwise(n)))


def tokens_by_length(c: Column, least: int = 1) -> Column:
    """Token estimate: a token for four characters."""
    return F.greatest(F.lit(least).cast("long"), F.floor(F.char_length(F.coalesce(c, F.lit(""))) / 4).cast("long"))


def slug(c: Column, most: int = 60) -> Column:
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(c, "^-+|-+$", ""), 1, most), "-+$", "")


def truncate_words(c: Column, most_tokens: int) -> Column:
    """Cut at four characters a token, at the last blank if that keeps 70 %."""
    limit = most_tokens * 4
    head = F.substring(c, 1, limit)
    space = F.lit(limit) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (space > limit * 0.7), F.substring(head, F.lit(1), space.cast("int"))).otherwise(head)
    return F.when(F.char_length(c) <= limit, c).otherwise(F.concat(F.rtrim(cut), F.lit("...")))


def preview(c: Column, limit: int) -> Column:
    """The head of a text, cut at a line end in its second half, and how much was left out."""
    head = F.substring(c, 1, limit)
    last = F.char_length(head) - F.locate("\n", F.reverse(head)) + 1
    cut = F.when((F.locate("\n", F.reverse(head)) > 0) & (last > limit / 2), F.substring(head, F.lit(1), (last - 1).cast("int"))).otherwise(head)
    left = (F.char_length(c) - F.char_length(cut)).cast("string")
    return F.when(F.char_length(c) <= limit, c).otherwise(F.concat(cut, F.lit("\n... ["), left, F.lit(" chars omitted]")))


def redact(c: Column, level: str) -> Column:
    """Personal data: kept, cut to 32 characters, hashed, or left out."""
    return {"none": c, "truncate": F.substring(c, 1, 32), "hash": F.sha2(c, 256), "redact": F.when(c.isNotNull(), F.lit("[REDACTED]"))}[level]


def strip_reasoning(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?is)<(think|thinking|reasoning)>.*?</\1>", ""))


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, r"\x1B\[[0-9;]*[A-Za-z]", "")


def section(c: Column, name: str) -> Column:
    """The text under a line `=== NAME ===`, up to the next such line."""
    return strip(F.regexp_extract(c, rf"(?s)=== {name} ===\n(.*?)(?=\n=== |\z)", 1))


def references(c: Column) -> Column:
    """Distinct targets of imports, requires, links, sources and style urls, in sorted order, without query and fragment."""
    patterns = [r"""(?:href|src)\s*=\s*["']([^"']+)["']""", r"""\bfrom\s+["']([^"']+)["']""", r"""\brequire\(\s*["']([^"']+)["']""", r"""\bimport\s+["']([^"']+)["']""", r"""@import\s+["']([^"']+)["']""", r"""url\(\s*["']?([^"')]+)["']?\s*\)"""]
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(1)) for p in patterns]))
    return F.array_sort(F.array_remove(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "[?#].*$", ""))), ""))


def imported_modules(c: Column) -> Column:
    """Distinct modules that a Python text imports, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?m)^\s*(?:from|import)\s+([a-zA-Z_][\w.]*)"), F.lit(1))))


def module_paths(module: Column) -> Column:
    """Files that a dotted module name may mean."""
    path = F.replace(module, F.lit("."), F.lit("/"))
    return F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py")))


def head_and_tail(c: Column, most: int = 300) -> Column:
    """A long text's first two thirds and last third of `most` characters, both cut at a blank where they have one, and how much lies between; the mark between them is a fixed value."""
    head = F.regexp_replace(F.substring(c, 1, most * 2 // 3), r" [^ ]*\z", "")
    tail = F.regexp_replace(F.right(c, F.lit(most // 3)), r"\A[^ ]* ", "")
    left = (F.char_length(c) - F.char_length(head) - F.char_length(tail)).cast("string")
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(head, F.lit("\n[..."), left, F.lit(" chars compressed...]\n"), tail))


def _between(c: Column, first: str, last: str) -> Column:
    """What stands between two marks, whatever their case; empty without both."""
    def upto(rest: Column) -> Column:
        return let(F.instr(F.lower(rest), F.lit(last)), lambda end: F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(""))

    return let(F.instr(F.lower(c), F.lit(first)), lambda start: F.when(start > 0, let(F.substring(c, start + len(first), F.char_length(c)), upto)).otherwise(""))


def environment(system: Column) -> Column:
    """Fields of a system prompt's <env> block as a map, and who its head says that the agent is, as `harness`; of repeated names the last counts.

    A field is a line with a name, a colon and a value; names are in lower case, blanks in them underscores, apostrophes left out.
    """
    c = F.coalesce(system, F.lit(""))
    pair = "struct<k: string, v: string>"
    entry = lambda k, v: F.struct(k.alias("k"), v.alias("v")).cast(pair)
    name = lambda k: F.translate(F.lower(k), " '", "_")
    cut = lambda x: F.instr(x, F.lit(":"))
    one = lambda x: entry(name(F.trim(F.substring(x, F.lit(1), cut(x) - 1))), F.trim(F.substring(x, cut(x) + 1, F.char_length(x))))
    lines = F.filter(F.split(_between(c, "<env>", "</env>"), "\n"), lambda x: cut(x) > 1)
    fields = F.filter(F.transform(lines, one), lambda e: (e["k"] != "") & (e["v"] != ""))
    none = F.array().cast(f"array<{pair}>")

    def who(said: Column) -> Column:
        # a name ends at punctuation, and is of words
        named = lambda x: F.coalesce((x != "") & x.rlike(r"^\w[\w\s]*$") & said.rlike("[,.\u2014]"), F.lit(False))
        return let(F.trim(F.split(said, "[,.\u2014]")[0]), lambda x: F.when(named(x), F.array(entry(F.lit("harness"), x))).otherwise(none))

    head = F.substring(c, 1, 500)
    said = let(F.instr(F.lower(head), F.lit("you are ")), lambda at: F.when(at > 0, F.substring(head, at + 8, F.char_length(head))))
    last = lambda all_: let(F.transform(all_, lambda e: e["k"]), lambda keys: F.filter(all_, lambda e, i: F.array_position(keys, e["k"]) == i + 1))
    return F.map_from_entries(let(F.reverse(F.concat(let(said, who), fields)), last))


def fingerprint(system: Column, first_user: Column) -> Column:
    """A session's id: hash of the head of its system prompt and its first user message."""
    return F.substring(F.sha2(F.concat(F.substring(F.coalesce(system, F.lit("")), 1, 4000), F.lit("\n"), F.coalesce(first_user, F.lit(""))), 256), 1, 16)


def message_fingerprint(role: Column, content: Column) -> Column:
    return F.md5(F.concat(role, F.lit(":"), F.substring(F.coalesce(content, F.lit("")), 1, 200)))


def path_plausible(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[\w./\\@-]+\.[A-Za-z0-9]{1,8}$") & ~c.contains(".."), F.lit(False))
