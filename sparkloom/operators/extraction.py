"""Facts from tool calls: one extractor for each family of tools, one call in, any number of typed facts out.

Families whose facts are a matter of arguments and lines are column functions, so they stay in the JVM. Families that read free text
are Python functions behind one Arrow table function, which takes the calls as a table, batch by batch; only their calls go there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.content import path_argument
from .provenance import ARGUMENT_KEYS, file_fact

#: Tools of each family by name; a name that ends in * stands for all that begin so. Fixed values.
FAMILIES = {
    "read": ["Read", "read_file"],
    "write": ["Write", "Edit", "NotebookEdit", "write_file", "edit_file", "notebook_edit"],
    "glob": ["Glob"],
    "find": ["find", "FindFiles", "find_files"],
    "list": ["LS", "ls", "list_directory", "listdir", "ListDirectory"],
    "grep": ["Grep"],
    "shell": ["Bash"],
    "search": ["WebSearch", "web_search", "websearch"],
    "memory": ["mcp__memory__recall*"],
}
#: How many paths of a listing, names of a folder, files and places of a search, results and memories a fact or call names; fixed values.
PATHS, NAMES, FILES, PLACES, RESULTS, MEMORIES = 8, 6, 10, 5, 5, 20
#: Characters of a raw result in a fact, and of an error.
RAW, ERROR = 300, 120
#: Commands that run tests, and shell words that are no commands; fixed values.
TESTERS = ["pytest", "python", "npm", "jest", "vitest", "cargo", "go"]
BUILTINS = ["source", "export", "cd", "unset", "alias", "eval", "set", "exit"]

Fact = tuple[str, str, float, str | None]
KIND = "struct<content: string, fact_type: string, confidence: double, touched: string>"


def family(tool: Column, families: dict[str, list[str]] = FAMILIES) -> Column:
    """The family of a tool: by its whole name, else by the longest beginning; of several families with one name the last. Null if there is none."""
    names, starts = {}, {}
    for f, tools in families.items():
        for t in tools:
            (starts if t.endswith("*") else names)[t.rstrip("*")] = f
    out = F
    for name, f in names.items():
        out = out.when(tool == name, f)
    for start in sorted(starts, key=len, reverse=True):
        out = out.when(tool.startswith(start), starts[start])
    return out.otherwise(None)


def _argument(arguments: Column, *keys: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(arguments, f"$.{k}"), F.lit("")) for k in keys], F.lit(""))


def _one(content: Column) -> Column:
    """An array of one certain fact about a tool's result."""
    return F.array(F.struct(content.alias("content"), F.lit("tool_result").alias("fact_type"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("touched")).cast(KIND))


def _lines(result: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(result, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _first(items: Column, most: int, more: Column) -> Column:
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(F.size(items) > most, more).otherwise(""))


def _text(n: Column) -> Column:
    return n.cast("string")


def listed_fact(kind: Column, arguments: Column, result: Column) -> Column:
    """The fact of a listing of files by pattern (glob), by search (find) or of a folder (list)."""
    lines = _lines(result)
    paths = F.filter(lines, lambda x: ~x.startswith("Found") & ((kind == "glob") | (F.char_length(x) > 1)))
    shown = _first(paths, PATHS, F.concat(F.lit(", ... ("), _text(F.size(paths)), F.lit(" total)")))
    folders = F.size(F.filter(lines, lambda x: x.endswith("/")))
    entries = F.concat(_text(F.size(lines)), F.lit(" entries ("), _text(F.size(lines) - folders), F.lit(" files, "), _text(folders), F.lit(" dirs) \u2014 "), _first(lines, NAMES, F.lit(", ...")))
    return (
        F.when(kind == "glob", F.concat(F.lit("[Glob] "), _argument(arguments, "pattern"), F.lit(" \u2192 "), _text(F.size(paths)), F.lit(" files: "), shown))
        .when(kind == "find", F.concat(F.lit("[find] found "), _text(F.size(paths)), F.lit(" paths matching query: "), shown))
        .otherwise(F.concat(F.lit("[ls] "), _argument(arguments, "path", "dir"), F.lit(": "), entries))
    )


def direct_facts(kind: Column, tool: Column, arguments: Column, result: Column, turn: Column) -> Column:
    """Facts of the families that need no free text; null for others."""
    return (
        F.when(kind.isin("read", "write"), F.array(file_fact(tool, path_argument(arguments, ARGUMENT_KEYS["path"]), result, turn).cast(KIND)))
        .when(kind.isin("glob", "find", "list"), _one(listed_fact(kind, arguments, result)))
    )


def grep_facts(arguments: dict, result: str) -> Iterable[Fact]:
    """One fact for each file with hits (lines `path:number:text`), for the first FILES of them; the raw head without any."""
    pattern, places, some = arguments.get("pattern") or "", {}, False
    for line in result.split("\n"):
        path, _, rest = line.partition(":")
        if len(path) == 1 and rest[:1] in ("\\", "/"):  # a drive letter
            more, _, rest = rest.partition(":")
            path = f"{path}:{more}"
        number, colon, text = rest.partition(":")
        if not (path and colon and text and number.isdecimal()):
            continue
        some = True
        if re.search(r"[/\\]|\.\w{1,8}$", path):
            places.setdefault(path, []).append(int(number))
    if not some:
        yield f"[Grep] '{pattern}' \u2014 no structured matches; raw output: {result[:RAW]}", "tool_result", 0.6, None
    for path, numbers in list(places.items())[:FILES]:
        shown = ", ".join(map(str, numbers[:PLACES])) + (f", ... ({len(numbers)} total)" if len(numbers) > PLACES else "")
        yield f"[Grep] '{pattern}' matched {len(numbers)} times in {path} (lines {shown})", "tool_result", 1.0, path


def command(line: str) -> str:
    """The command that a shell line runs first, `builtin` for a shell's own; assignments before it are left out."""
    words = line.split()
    while words and re.fullmatch(r"[A-Z_]+=\S*", words[0]):
        words = words[1:]
    first = re.split(r"&&|\|\||;|\|", words[0])[0] if words else ""
    return "builtin" if first in BUILTINS else first


def _tested(name: str, words: list[str]) -> Iterable[Fact]:
    """Facts of a test run: how many tests passed, failed or warned, which failed, and the result as a whole."""
    pairs = list(zip(words, words[1:], strict=False))
    js = name in ("npm", "jest", "vitest")
    for what, before in (("passed", "Tests:" if js else None), ("failed", None), ("warning", None)):
        if what == "warning" and name not in ("pytest", "python"):
            continue
        for i, (number, word) in enumerate(pairs):
            digits = re.search(r"\d+$", number)
            if digits and word.startswith(what) and (before is None or i and words[i - 1] == before):
                yield f"[Bash] {name}: {digits[0]} {'warnings' if what == 'warning' else what}", "tool_result", 1.0, None
    mark = "FAIL" if js else "FAILED"
    for word, test in pairs:
        if word == mark and name in ("pytest", "python", "npm", "jest", "vitest"):
            yield f"[Bash] {name} FAILED: {test if js else re.match(r'[\w/.:]*', test)[0]}", "error", 1.0, None
    for a, b, c in zip(words, words[1:], words[2:], strict=False):
        if (a, b) == ("test", "result:") and name in ("cargo", "go"):
            said = next((x for x in ("ok", "FAILED" if name == "cargo" else "FAIL") if c.startswith(x)), None)
            if said:
                yield f"[Bash] {name} test result: {said}", "tool_result", 1.0, None


def _versioned(line: str, output: str) -> Iterable[Fact]:
    """Facts of a version control command: files of a status or a difference, commits of a log."""
    words = line.split()
    what = words[words.index("git") + 1] if "git" in words[:-1] else ""
    for x in output.split("\n"):
        if what == "status" and x[:1].isspace():
            state, colon, path = x.strip().partition(":")
            if colon and state in ("modified", "new file", "deleted") and path.strip():
                yield f"[Bash] git status: {path.strip()}", "tool_result", 1.0, path.strip()
        elif what == "diff" and x[:4] in ("+++ ", "--- ") and x[4:6] in ("a/", "b/"):
            yield f"[Bash] git diff file: {x[6:].strip()}", "tool_result", 1.0, x[6:].strip()
        elif what == "log":
            commit, blank, text = x.partition(" ")
            if blank and text and len(commit) >= 7 and not commit.strip("0123456789abcdef"):
                yield f"[Bash] git log: {commit} {text.strip()}", "tool_result", 1.0, None


def shell_facts(arguments: dict, result: str) -> Iterable[Fact]:
    """Facts of a command's output, by the command; what follows the word error; the raw head where nothing is known."""
    line = arguments.get("command") or ""
    output = re.sub(r"\x1b\[[0-9;]*m", "", result)
    name = command(line)
    found = list(_versioned(line, output) if name == "git" else _tested(name, output.split()) if name in TESTERS else ())
    if name and name != "builtin":
        found += [(f"[Bash] error: {x.strip()}", "error", 0.9, None) for x in re.findall(r"(?:error|Error|ERROR):?\s+([^\n]{0,%d})" % ERROR, output)]
    yield from found or [(f"[Bash] {line[:100]}: {output[:200]}", "tool_result", 0.4, None)]


def _parsed(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def search_facts(arguments: dict, result: str) -> Iterable[Fact]:
    """One fact for each of the first RESULTS results: JSON, whatever it calls the list, or lines `Title:`, `URL:` and `Snippet:`."""
    query, data = arguments.get("query") or arguments.get("term") or "", _parsed(result)
    if isinstance(data, dict):
        web = data.get("web") if isinstance(data.get("web"), dict) else {}
        data = data.get("results") or web.get("results") or data.get("organic_results")
    items = [
        (x.get("title") or "", x.get("url") or x.get("link") or "", x.get("snippet") or x.get("description") or "")
        for x in (data if isinstance(data, list) else []) if isinstance(x, dict) and x.keys() & {"title", "url", "snippet", "description", "link"}
    ]
    if not items:
        told: dict[str, list[str]] = {"title": [], "url": [], "snippet": []}
        for x in result.split("\n"):
            key, colon, value = x.strip().partition(":")
            if colon and key.lower() in told and value.strip():
                told[key.lower()].append(value.strip())
        at = lambda key, i: told[key][i] if i < len(told[key]) else ""
        items = [(t, at("url", i), at("snippet", i)) for i, t in enumerate(told["title"])]
    if not items:
        yield f"[web_search] '{query}' \u2014 {result[:RAW]}", "tool_result", 0.5, None
    for title, url, snippet in items[:RESULTS]:
        yield f"[web_search] '{query}': '{title}' \u2014 {str(snippet)[:120]} ({url})", "tool_result", 0.8, None


def memory_facts(arguments: dict, result: str) -> Iterable[Fact]:
    """One fact for each of the first MEMORIES memories with a score of 0.5 or more: JSON, or texts between `---` or empty lines, which count 0.8."""
    data = _parsed(result)
    if isinstance(data, dict):
        data = data.get("memories") or data.get("results") or data.get("items")
    if not (isinstance(data, list) and data and all(isinstance(x, dict) for x in data)):
        parts = result.split("---") if "---" in result else result.split("\n\n")
        data = [{"text": p.strip()} for p in parts if p.strip()]
    for item in data[:MEMORIES]:
        try:
            score = float(item.get("score", 0.8))
        except (TypeError, ValueError):
            score = 0.8
        if score >= 0.5:
            yield f"[memory_recall] {item.get('text', '')}", "observation", min(1.0, score), None


#: Families that read free text: a call's arguments and result to facts.
READERS: dict[str, Callable[[dict, str], Iterable[Fact]]] = {"grep": grep_facts, "shell": shell_facts, "search": search_facts, "memory": memory_facts}


def table_function(key: str, readers: dict[str, Callable[[dict, str], Iterable[Fact]]] = READERS):
    """The Arrow table function of calls (key columns, family, arguments, result) to facts; key names the key columns and their types.

    In SQL: `SELECT * FROM name(TABLE(calls))`, once it is registered. A call that its reader can't make sense of gives no facts.
    """
    width = len(key.split(","))

    class Extracted:
        def eval(self, calls: pa.RecordBatch):
            kinds, arguments, results = (calls.column(width + i).to_pylist() for i in range(3))
            at, pos, rows = [], [], []
            for i, (kind, args, result) in enumerate(zip(kinds, arguments, results, strict=True)):
                given = _parsed(args or "{}")
                found = list(readers[kind](given if isinstance(given, dict) else {}, result or "")) if kind in readers else []
                at += [i] * len(found)
                pos += range(len(found))
                rows += found
            taken = [calls.column(j).take(pa.array(at, pa.int64())) for j in range(width)]
            kinds_ = [pa.string(), pa.string(), pa.float64(), pa.string()]
            facts = [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds_)]
            yield pa.table([*taken, pa.array(pos, pa.int64()), *facts], names=[*(calls.schema.names[:width]), "pos", "content", "fact_type", "confidence", "touched"])

    return F.arrow_udtf(Extracted, returnType=f"{key}, pos long, content string, fact_type string, confidence double, touched string")


def register(spark: SparkSession, name: str = "extracted_text", key: str = "session_id string, turn long, call_id string") -> None:
    """Make the table function known to SQL."""
    spark.udtf.register(name, table_function(key))


def extracted(calls: DataFrame, families: dict[str, list[str]] = FAMILIES, readers: dict[str, Callable[[dict, str], Iterable[Fact]]] = READERS) -> DataFrame:
    """(session_id, turn, call_id, tool, pos, content, fact_type, confidence, touched) for calls (session_id, turn, call_id, tool, arguments, result).

    A family of one's own is a name in families and a function in readers, which goes before a built-in one of that name. Tools without a family give nothing.
    """
    keys = ["session_id", "turn", "call_id", "tool"]
    rows = calls.select(*keys, "arguments", "result", family(F.col("tool"), families).alias("family"))
    facts = direct_facts(F.col("family"), F.col("tool"), F.col("arguments"), F.col("result"), F.col("turn"))
    own = rows.where(~F.col("family").isin(*readers)).select(*keys, F.posexplode(facts).alias("pos", "fact")).select(*keys, F.col("pos").cast("long").alias("pos"), "fact.*")
    key = ", ".join(f"{n} {t}" for n, t in rows.select(*keys).dtypes)
    text = rows.where(F.col("family").isin(*readers)).select(*keys, "family", "arguments", "result")
    return own.unionByName(table_function(key, readers)(text.asTable()))
