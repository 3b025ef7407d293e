"""What a message asks for, told by its words: kind of question, references, change of topic, alignment with a goal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cues of each kind of question, in the order in which kinds are tried: phrases, and pairs of phrases and words of which one follows later in the line; fixed values.
CUES = [
    ("debug", ["error", "exception", "traceback", "stack trace", "failed", "failing", "broken", "debug", "not working", "doesn t work"],
     [(["why is", "why does", "why did", "why are", "why was"], ["fail", "error", "crash", "break", "wrong", "bug"]), (["fix"], ["bug", "issue", "error", "problem"]), (["won t"], ["work"])]),
    ("recall", ["remember when", "earlier we", "earlier you", "earlier i", "what happened with", "what happened to", "what happened when", "recap", "summarise", "summarize", "what s the status"],
     [(["what did we", "what did you", "what did i"], ["decide", "choose", "agree", "set", "use"]),
      (["what was the", "what was our", "what were the", "what were our", "what is the", "what is our"], ["decision", "approach", "choice", "plan"])]),
    ("status", ["what have we done", "what have you done", "what have i done", "where are we", "where were we", "progress", "status", "so far", "what s left", "what s remaining", "what s next"], []),
    ("exploration", ["explain", "describe", "walk me through", "architecture", "design", "structure"], [(["how does"], ["work"]), (["what is"], ["for", "doing"])]),
    ("action", ["refactor", "rewrite", "implement", "add", "create", "build", "write", "update", "change", "modify", "move", "rename", "delete", "remove", "let s", "go ahead"], [(["please"], ["make", "do", "fix", "add", "update"])]),
]
#: The kind of a message without cues.
FOLLOWUP = "followup"
#: Phrases that leave a topic; fixed values.
SHIFTS = ["actually", "instead", "switching", "different", "new topic", "moving on", "let s talk about", "forget about", "never mind"]
#: Endings that make a name a file; fixed values.
ENDINGS = ["py", "js", "ts", "tsx", "jsx", "json", "yaml", "yml", "toml", "md", "sql", "sh", "css", "html", "rs", "go", "java", "cpp", "c", "h"]


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def word_lines(c: Column) -> Column:
    """The lines of a text as words in lower case, one blank around each."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\n]+", " ")
    return F.transform(F.split(plain, "\n"), lambda x: F.concat(F.lit(" "), F.trim(x), F.lit(" ")))


def _padded(p: Column) -> Column:
    return F.concat(F.lit(" "), p, F.lit(" "))


def says(line: Column, phrases: list[str]) -> Column:
    return F.exists(_strings(phrases), lambda p: F.contains(line, _padded(p)))


def _leads_to(line: Column, first: list[str], later: list[str]) -> Column:
    """Whether one of the words `later` stands behind one of the phrases `first`."""
    behind = lambda p: F.substring(line, F.instr(line, _padded(p)) + F.char_length(p) + 1, F.char_length(line))
    return F.exists(_strings(first), lambda p: F.contains(line, _padded(p)) & once(behind(p), lambda rest: says(rest, later)))


def _cued(alone: list[str], pairs: list[tuple[list[str], list[str]]]) -> Callable[[Column], Column]:
    def held(line: Column) -> Column:
        found = says(line, alone)
        for first, later in pairs:
            found = found | _leads_to(line, first, later)
        return found

    return held


def kind(c: Column) -> Column:
    """Kind of question: the first whose cues a line holds, else FOLLOWUP."""

    def of(lines: Column) -> Column:
        out = F
        for name, alone, pairs in CUES:
            out = out.when(F.exists(lines, _cued(alone, pairs)), name)
        return out.otherwise(FOLLOWUP)

    return once(word_lines(c), of)


def references(c: Column) -> Column:
    """Distinct files, called functions and quoted identifiers of a message, sorted.

    A file is the head of a word that starts with a letter or underscore, up to its last known ending. A function is the dotted name that closes
    what stands before a bracket, if a blank or backtick or nothing stands before it. An identifier fills a pair of backticks.
    """
    text = F.coalesce(c, F.lit(""))
    path = lambda word: F.split(F.regexp_extract(word, r"^[A-Za-z_][\w./\\-]*", 0), r"\.")
    ending = lambda piece: F.regexp_extract(piece, r"^\w+", 0)
    last = lambda pieces: F.array_max(F.transform(pieces, lambda p, i: F.when((i > 0) & ending(p).isin(ENDINGS), i)))
    upto = lambda pieces: once(last(pieces), lambda n: F.concat(F.array_join(F.slice(pieces, F.lit(1), n), "."), F.lit("."), ending(F.get(pieces, n))))
    files = F.transform(F.split(text, "[\\s`\"']+"), lambda w: once(path(w), lambda p: F.when(last(p).isNotNull(), upto(p))))
    # what stands before each bracket
    before = once(F.split(text, r"\("), lambda parts: F.slice(parts, F.lit(1), F.size(parts) - 1))
    called = F.transform(before, lambda p, i: F.element_at(F.split(F.concat(F.when(i > 0, "(").otherwise(""), F.regexp_replace(p, r"\s+$", "")), r"[\s`]"), -1))
    called = F.filter(called, lambda n: n.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*$"))
    # a backtick that closes one identifier doesn't open the next
    quoted = F.aggregate(
        F.slice(F.split(text, "`"), F.lit(2), F.greatest(F.size(F.split(text, "`")) - 2, F.lit(0))),
        F.struct(F.array().cast("array<string>").alias("names"), F.lit(False).alias("closed")),
        lambda acc, p: F.when(~acc["closed"] & p.rlike(r"^[a-zA-Z_][\w.]*$"), F.struct(F.concat(acc["names"], F.array(p)).alias("names"), F.lit(True).alias("closed"))).otherwise(
            F.struct(acc["names"].alias("names"), F.lit(False).alias("closed"))
        ),
        lambda acc: acc["names"],
    )
    return F.array_sort(F.array_distinct(F.filter(F.concat(files, called, quoted), lambda x: x.isNotNull())))


def long_words(c: Column) -> Column:
    """Distinct words of four characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]{4,}"), F.lit(0)))


def leaves_topic(c: Column) -> Column:
    """Whether a text says that it leaves the topic."""
    return F.exists(word_lines(c), lambda line: says(line, SHIFTS))


def goal_aligned(c: Column, goal: Column) -> Column:
    """Whether a message holds more than a twentieth of the goal's words; true without a goal or words in it."""
    common = lambda g: (F.size(g) == 0) | (F.size(F.array_intersect(g, long_words(c))) * 20 > F.size(g))
    return once(long_words(goal), common)


def confidence(question: Column, refs: Column, domains: Column) -> Column:
    """How sure a reading is: half, and more for references, a kind of question, and domains."""
    more = F.when(F.size(refs) > 0, 0.2).otherwise(0.0) + F.when(question != FOLLOWUP, 0.15).otherwise(0.0) + F.when(F.size(domains) > 0, 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.5) + more)
