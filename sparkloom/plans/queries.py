"""The registered queries: each applies operators to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import markup as M
from ..functions import phrasing as P
from ..functions import rendering as R
from ..functions import text as T
from ..functions import tokens as K
from ..operators import briefing, compression, evals, extraction, facts, files, graph, intents, messages, outlines, provenance, ranking, reads, references, rewriting, sessions, traces
from ..sources import adapters as A
from ..streaming import stateful
from ..streaming import turns as turns_

def _rounded(df, **places):
    """Sums of floating-point numbers hang on their order in the last digits; reports show fewer."""
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


NOW = "2024-02-01 00:00:00"
QUERY = "install the href link and table of content title"


def _path_edges(s, d):
    """Edges between files of one session: each refers to the one at half its place in the session."""
    f = A.files(s, d)
    src = f.select("session_id", F.col("path").alias("src"), F.expr("session_id * 20 + last_updated_turn % 20 div 2").alias("half"))
    dst = f.select(F.col("path").alias("dst"), F.col("last_updated_turn").alias("m"))
    return src.join(dst, F.col("half") == F.col("m")).where("src <> dst").select("session_id", "src", "dst").distinct()


def _descriptions(s, d):
    b = A.table(s, d, "benchmark")
    return A.facts(s, d).where("not invalidated").select("session_id", F.col("fact_id").alias("id"), F.concat(F.lit("The "), F.col("content")).alias("content")).unionByName(
        b.select((F.col("item_id") % 50).alias("session_id"), (F.col("item_id") + 1000000000).alias("id"), F.col("text").alias("content"))
    )


def _said_again(s, d):
    """The facts, and each once more in other words, a few of them unchanged."""
    f = A.facts(s, d)
    other = F.when(F.col("fact_id") % 3 == 0, F.col("content")).otherwise(F.concat(F.col("content"), F.lit(" once more")))
    return f.unionByName(f.withColumns({"content": other, "fact_id": F.col("fact_id") + 1000000000}))


#: Openings that say nothing, phrases with a shorter form, and phrases that go.
PHRASES = (["(?:i|we) think that,? ", "as far as (?:i|we) can tell,? "], [("in the near future", "soon"), ("in the event that", "if"), ("a number of", "several")], ["to be frank,? ", "of course,? "])


def _runs(s, d):
    t = A.traces(s, d)
    return t.select("assembly_mode", "input_tokens", "savings_tokens", F.floor("latency_ms").cast("long").alias("output")).withColumnsRenamed({"assembly_mode": "arm", "input_tokens": "input", "savings_tokens": "saved"})


def _flag_runs(s, d, flag):
    li = A.table(s, d, "lineitem").where(F.col("l_returnflag") == flag)
    return li.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity"))


def _chunks(s, d):
    m = A.messages(s, d).where("role = 'assistant'").select(F.concat_ws(":", F.col("session_id").cast("string"), F.col("idx").cast("string")).alias("response_id"), "content")
    n = F.sequence(F.lit(0), F.floor((F.char_length("content") - 1) / 40).cast("int"))
    return m.where("char_length(content) > 0").select("response_id", "content", F.explode(n).alias("seq")).select(
        "response_id", F.col("seq").cast("long").alias("seq"), F.expr("substring(content, seq * 40 + 1, 40)").alias("delta"), F.when(F.col("seq") == 0, "m1").alias("model"),
        F.when(F.col("seq") * 40 + 40 >= F.char_length("content"), "stop").alias("finish"),
    )


#: What users ask, said after the messages' own texts; the last adds nothing.
ASKS = [
    " why does parse_it( fail in `src/a.py`", " explain the data model", " what did we decide on the requirement", " create a script", "", " what did we decide about the error", " let's go ahead", "\nactually, please\nadd it",
]


def _asks(s, d):
    said = F.element_at(F.array(*map(F.lit, ASKS)), F.expr("int((session_id + idx) % 8 + 1)"))
    return A.messages(s, d).withColumn("content", F.concat("content", said))


def _embedded(s, d):
    """Facts with vectors where there are some, and the vectors that sessions ask with."""
    v = A.table(s, d, "embeddings").select("vec_id", "embedding")
    f = A.facts(s, d).join(v.withColumnRenamed("vec_id", "fact_id"), "fact_id", "left")
    return f, v.select(F.col("vec_id").alias("session_id"), F.col("embedding").alias("query"))


def _by_intent(s, d):
    f, v = _embedded(s, d)
    return intents.scored(f, intents.last_asked(_asks(s, d)).join(v, "session_id", "left"))


def _by_embedding(s, d):
    f, v = _embedded(s, d)
    return intents.scored(f, v.withColumns({"weights": F.lit(None).cast("map<string,double>"), "refs": F.lit(None).cast("array<string>")}))


def _audited(s, d):
    f = A.facts(s, d).withColumn("turn", F.expr("session_id * 10 + (source_turn - 1) div 4"))
    truth = f.where("not invalidated").select("turn", F.col("fact_id").alias("truth_id"), F.concat(F.lit("also "), "content").alias("content"))
    return f.select("turn", F.col("fact_id").alias("id"), "content"), truth


def _file_calls(s, d):
    tool = F.when(F.col("tool") == "read", "Read").when(F.col("tool") == "write", "Write").otherwise("Edit")
    return A.reads(s, d).select("session_id", F.col("idx").alias("turn"), tool.alias("tool"), F.when(F.expr("idx % 4 > 0"), F.col("path")).alias("path"), F.concat("content", F.lit("\nend")).alias("result"))


def _tool_calls(s, d):
    """A call for each page, its text the result: reads, writes and listings in turn, some without a path."""
    tool = F.element_at(F.array(*map(F.lit, ["Read", "Write", "Glob", "find_files", "LS"])), F.expr("int(last_updated_turn % 5 + 1)"))
    arguments = F.to_json(F.struct(F.when(F.expr("last_updated_turn % 4 > 0"), F.col("path")).alias("path"), F.lit("*.html").alias("pattern")))
    return A.files(s, d).select("session_id", (F.col("last_updated_turn") % 20).alias("turn"), F.col("last_updated_turn").alias("call_id"), tool.alias("tool"), arguments.alias("arguments"), F.col("content").alias("result"))


def _encoded(s, d):
    """Tokens of all documents by a public vocabulary."""
    import public_tokenizers

    n = K.counter(public_tokenizers.path("word_bpe_49k.json"))
    return A.table(s, d, "documents").select("doc_id", n(F.col("text")).alias("tokens")).withColumn("estimate", K.estimate(F.col("tokens")))


def _payloads(s, d):
    """Answers as chunks of JSON, forty characters each; the last names the finish and the usage."""
    c = _chunks(s, d)
    safe = F.translate("delta", '"\\\n\t\r', "     ")
    end = F.when(F.col("finish").isNotNull(), F.concat(F.lit(',"finish_reason":"stop"}],"usage":{"total_tokens":'), (F.col("seq") * 40 + F.char_length("delta")).cast("string"), F.lit("}}"))).otherwise("}]}")
    return c.select("response_id", "seq", F.concat(F.lit('{"model":"m'), (F.col("seq") % 3).cast("string"), F.lit('","choices":[{"delta":{"content":"'), safe, F.lit('"}'), end).alias("payload"))


def _degrees(s, d):
    return files.in_degree(A.files(s, d).select("session_id", "path").distinct(), _path_edges(s, d))


def _failing_runs(s, d, flag):
    return _flag_runs(s, d, flag).withColumn("error", F.when(F.expr("quantity % 5 = 0"), "x"))


def _turn_traces(s, d):
    """A trace for each answer, with the messages before it."""
    m = A.messages(s, d)
    before = F.array_sort(F.collect_list(F.struct("idx", "role", "content")).over(Window.partitionBy("session_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)))
    rows = m.withColumn("messages", F.transform(before, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).where("role = 'assistant'")
    return rows.select("session_id", F.col("idx").alias("turn_number"), "messages", F.col("content").alias("response"), F.char_length("content").cast("long").alias("output_tokens"), F.when(F.expr("idx % 2 = 1"), 0.0).otherwise(F.col("idx") * 1.5).alias("upstream_ms"), (F.col("idx") * 2.0).alias("assembly_ms"))


def _leaking(s, d):
    """Answers, some with markup of calls in them."""
    c, k = F.col("content"), F.expr("(session_id + idx) % 4")
    leak = F.when(k == 0, F.concat(c, F.lit(M.TAIL + "x>"))).when(k == 1, F.concat(F.lit("<tool_call>{}</tool_call>"), c, F.lit(M.BLOCKS[0][0] + "a" + M.BLOCKS[0][1] + " \n"))).when(k == 2, F.concat(F.lit("<tool_call>"), c)).otherwise(c)
    return A.messages(s, d).where("role = 'assistant'").select("session_id", "idx", leak.alias("content"))


def _path_refs(s, d):
    """References between files, written in one of five ways."""
    ups = F.concat(F.lit("./"), F.expr("repeat('../', length(src) - length(replace(src, '/', '')))"), F.col("dst"))
    home = F.concat(F.lit("@/"), F.regexp_replace("dst", "^[^/]*/", ""))
    name, short = F.regexp_extract(F.regexp_replace("dst", "[?#].*$", ""), "([^/]*)/*$", 1), F.regexp_replace(F.regexp_replace("dst", "[?#].*$", ""), r"\.html$", "")
    target = F.element_at(F.array(ups, home, F.concat("dst", F.lit("?raw")), name, short), F.expr("int(length(dst) % 5 + 1)"))
    return _path_edges(s, d).select("session_id", F.col("src").alias("path"), target.alias("target"))


def _sources(s, d):
    """A Python file for each fact, with a method for each of its lines; every seventh is broken."""
    lines = F.split("content", "\n")
    methods = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("    def m"), i.cast("string"), F.lit("(self):\n        return "), F.char_length(x).cast("string"))), "\n")
    source = F.concat(F.lit("class C"), F.col("fact_id").cast("string"), F.lit(":\n"), methods, F.when(F.expr("fact_id % 7 = 0"), "\nnot python at all").otherwise(""))
    return A.facts(s, d).select("session_id", F.concat(F.lit("f"), F.col("fact_id").cast("string"), F.lit(".py")).alias("path"), source.alias("content"))


def _excerpts(s, d):
    """Three excerpts of each document: its first half and more, its last two thirds, and its first line as if it stood behind the end."""
    f = A.facts(s, d).withColumn("lines", F.split("content", "\n")).withColumn("n", F.size("lines"))
    part = lambda pos, first, of, size: F.struct(F.lit(pos).alias("pos"), first.cast("long").alias("first"), F.array_join(F.slice("lines", of, size), "\n").alias("result"))
    half, third = F.expr("n div 2 + 1"), F.expr("n div 3 + 1")
    parts = F.array(part(0, F.lit(1), F.lit(1), half), part(1, third, third, F.col("n")), part(2, F.col("n") + 5, F.lit(1), F.lit(1)))
    return f.select("session_id", F.col("fact_id").cast("string").alias("path"), F.explode(parts).alias("p")).select("session_id", "path", "p.*")


def _setters(s, d):
    """What the steps of a turn set: counts, zero at times, and texts, some of them twice."""
    t = A.traces(s, d)
    one = lambda pos, name, value: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    steps = F.array(
        one(0, "extractor_prompt_tokens", F.col("input_tokens")), one(1, "extractor_prompt_tokens", F.when(F.col("failed"), F.col("savings_tokens")).otherwise(F.lit(0))), one(0, "assembly_mode", F.lit("none")),
        one(2, "assembly_mode", F.col("assembly_mode")), one(2, "assembly_mode", F.col("assembly_mode")), one(1, "recall_used", F.col("recall_used")), one(1, "recall_question", F.repeat(F.col("assembly_mode"), F.lit(30))), one(1, "recall_trigger", F.when(F.col("failed"), "phrase").otherwise("")),
    )
    return t.select(F.col("event_id").alias("turn_id"), F.explode(steps).alias("e")).select("turn_id", "e.*")


def _briefings(s, d):
    t = A.traces(s, d).groupBy(F.col("session_id").cast("string").alias("session_id")).agg(F.max("turn_number").alias("source_turn"), F.sort_array(F.collect_set("turn_number")).alias("retained_turns"), F.max_by("assembly_mode", "turn_number").alias("mode"))
    return t.withColumn("mode", F.when(F.col("mode") != "curator", F.col("mode")))


def _tooled(s, d):
    """The conversations, a call in some answers and its result behind it, the call's id again in a later call of the session."""
    m = A.messages(s, d)
    call_id = F.concat(F.lit("c"), (F.col("idx") % 3).cast("string"))
    arguments = F.to_json(F.struct(F.concat(F.lit("src/"), F.col("idx").cast("string")).alias("path")))
    call = F.struct(call_id.alias("id"), F.lit("function").alias("type"), F.struct(F.when(F.expr("session_id % 2 = 0"), "grep").otherwise("read_file").alias("name"), arguments.alias("arguments")).alias("function"))
    called = (F.col("role") == "assistant") & F.expr("idx % 4 < 3")
    said = m.select("session_id", (F.col("idx") * 10).alias("idx"), "role", "content", F.when(called, F.array(call)).alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("name"))
    told = m.where(called).select("session_id", (F.col("idx") * 10 + 5).alias("idx"), F.lit("tool").alias("role"), F.concat("content", F.lit("\n"), "content").alias("content"), F.lit(None).cast("array<struct<id: string, type: string, function: struct<name: string, arguments: string>>>").alias("tool_calls"), call_id.alias("tool_call_id"), F.when(F.expr("session_id % 2 = 0"), "grep").otherwise("read_file").alias("name"))
    return said.union(told)


def _no_selection(s, d):
    return A.messages(s, d).select("session_id").distinct().withColumn("turns", F.lit(None).cast("array<bigint>"))


def _session_tree(s, d):
    """Edges from each session to its newest file and newest fact, and on along references and supersessions."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col("session_id").cast("string"), F.lit(":"), F.col(c).cast("string"))
    newest = A.files(s, d).groupBy("session_id").agg(F.max_by("path", "last_updated_turn").alias("path")).select("session_id", F.concat(F.col("session_id").cast("string"), F.lit(":"), F.col("path")).alias("id"))
    last = A.facts(s, d).groupBy("session_id").agg(F.max("fact_id").alias("fact_id")).select("session_id", F.concat(F.col("session_id").cast("string"), F.lit(":"), F.col("fact_id").cast("string")).alias("id"))
    refers = _path_edges(s, d).select(name("file", "src").alias("src"), name("file", "dst").alias("dst"))
    supersedes = A.supersedes(s, d).select(name("fact", "new_id").alias("src"), name("fact", "old_id").alias("dst"))
    edges = graph.session_graph({"file": newest, "fact": last}, {"refers": refers, "supersedes": supersedes})
    return edges, edges.where("kind = 'has'").select(F.col("src").alias("node"))


def _text_calls(s, d):
    """A call for each document, its text the result: searches of text, commands and memories in turn."""
    tool = F.element_at(F.array(*map(F.lit, ["Grep", "Bash", "mcp__memory__recall_all"])), F.expr("int(fact_id % 3 + 1)"))
    result = F.when(F.expr("fact_id % 2 = 0"), F.concat(F.lit("src/a.py:7:x\nerror: said\n\n"), "content")).otherwise(F.col("content"))
    return A.facts(s, d).select("session_id", F.col("source_turn").alias("turn"), F.col("fact_id").alias("call_id"), tool.alias("tool"), F.lit('{"pattern": "a", "command": "make all"}').alias("arguments"), result.alias("result"))


def _written(s, d):
    """Messages with a call in each of the assistant's."""
    arguments = F.to_json(F.struct(F.concat(F.lit("src/"), F.col("session_id").cast("string")).alias("filename"), "content"))
    name = F.when(F.col("idx") % 4 == 1, "write_file").otherwise("Edit")
    call = F.struct(F.concat(F.lit("c"), F.col("idx").cast("string")).alias("id"), F.lit("function").alias("type"), F.struct(name.alias("name"), arguments.alias("arguments")).alias("function"))
    return A.messages(s, d).withColumn("tool_calls", F.when(F.col("role") == "assistant", F.array(call)))


def _requests(s, d):
    sid = F.col("session_id").cast("string")
    return A.traces(s, d).select(
        F.col("event_id").alias("request_id"), F.when(F.expr("session_id % 3 = 0"), F.concat(F.lit("s"), sid)).otherwise("").alias("session_header"), F.when(F.expr("session_id % 3 = 1"), F.concat(F.lit("a"), sid)).alias("affinity_header"),
        F.when(~F.col("failed"), F.concat(F.lit("f"), sid)).alias("fingerprint"), F.when(F.col("recall_used"), "tool").otherwise("user").alias("last_role"),
    )


def _system_prompts(s, d):
    sid = F.col("session_id").cast("string")
    return A.traces(s, d).select("event_id", F.concat(F.lit("You are Some Agent, here to help.\n<env>\n  Working directory: /work/"), sid, F.lit("\nIs it the user's: "), F.col("failed").cast("string"), F.lit("\nPlatform: a\nPlatform: linux\n</env>\n")).alias("system"))


QUERIES = {
    "turn_usage": lambda s, d: sessions.usage(A.traces(s, d).select("session_id", F.floor((F.col("turn_number") - 1) / 4).alias("turn"), F.col("assembly_mode").alias("step"), F.when(~F.col("failed"), F.col("input_tokens")).alias("prompt_tokens"), "savings_tokens", F.col("savings_tokens").alias("completion_tokens"), F.lit(None).cast("long").alias("cached_tokens"), F.when(F.col("recall_used"), 1).when(F.col("failed"), 0).alias("llm_calls"))),
    "arm_metrics": lambda s, d: evals.arms(A.traces(s, d).withColumns({"arm": F.when(F.expr("session_id % 2 = 0"), "proxy").otherwise("passthrough"), "output_tokens": F.floor("latency_ms").cast("long")}), "arm", "passthrough"),
    "dry_run_stages": lambda s, d: sessions.dry_run_stages(
        _said_again(s, d).where("source_turn > 10").withColumn("pos", F.col("fact_id")), A.facts(s, d).where("source_turn <= 10").withColumn("pos", F.col("fact_id")), A.facts(s, d).where("source_turn = 3").select("session_id", F.col("fact_id").alias("id"), F.concat(F.lit("The "), F.col("content")).alias("content"))
    ),
    "turn_records": lambda s, d: messages.turn_records(_turn_traces(s, d)),
    "stripped_calls": lambda s, d: _leaking(s, d).select("session_id", "idx", M.strip_calls(F.col("content")).alias("text"), M.has_calls(F.col("content")).alias("leaks"), M.degraded(F.col("content"), F.char_length("content"), 300).alias("reason")),
    "solo_statistics": lambda s, d: compression.solo_statistics(compression.solo(_tooled(s, d).withColumn("content", F.when((F.col("role") == "tool") & F.expr("session_id % 5 = 0"), F.concat(F.lit("same "), F.repeat(F.lit("x "), F.lit(60)))).otherwise(F.col("content"))), 3, 400, 200, 1000), 1000),
    "yaml_values": lambda s, d: A.table(s, d, "pages").select("page_id", M.yaml_value(F.regexp_extract("url", "[^/]*$", 0)).alias("value"), M.at_least(F.regexp_replace("url", "[^0-9.]+", ""), F.lit("..5")).alias("newer")),
    "captured_answers": lambda s, d: stateful.captured(_payloads(s, d), 1000),
    "bounded_messages": lambda s, d: messages.bounded(_tooled(s, d), 100).select("session_id", "idx", "content", F.get("tool_calls", F.lit(0))["function"]["arguments"].alias("arguments")),
    "finished_requests": lambda s, d: messages.finished(A.traces(s, d).select(F.col("event_id").alias("request_id"), F.when(F.expr("turn_number % 2 = 0"), "user").otherwise("tool").alias("last_role"), F.when(F.col("failed"), "length").when(F.col("recall_used"), "stop").alias("finish_reason"))),
    "paired_runs": lambda s, d: evals.paired(_failing_runs(s, d, "A"), _failing_runs(s, d, "R"), "l_suppkey", "quantity"),
    "code_map_text": lambda s, d: files.rendered_map(_degrees(s, d), _path_edges(s, d), 3, 2, 400),
    "task_map_text": lambda s, d: files.rendered_task_map(files.relevance(A.files(s, d), QUERY), _degrees(s, d), ("1", "1/"), 4, 2, 300),
    "file_activity": lambda s, d: files.activity_scores(A.files(s, d).select("session_id", "path", F.substring("content", 1, 100).alias("outline"), F.expr("last_updated_turn % 20 - 10").alias("last_updated_turn")), "the example href of en", 3),
    "strategy_survivors": lambda s, d: evals.survivors(A.files(s, d).groupBy("session_id", "path").agg(F.min("content").alias("content")), {
        "topological": files.dependency_order(_degrees(s, d)), "combined": files.combined_order(files.relevance(A.files(s, d), QUERY), files.dependency_order(_degrees(s, d)), (".html", "/")),
    }, [5000, 20000]),
    "path_references": lambda s, d: references.resolved(_path_refs(s, d), A.files(s, d).select("session_id", "path")),
    "python_symbols": lambda s, d: outlines.symbols(_sources(s, d)),
    "python_focus": lambda s, d: outlines.focused(outlines.symbols(_sources(s, d)), "what does m3 return", 5),
    "outline_lookup": lambda s, d: outlines.lookup(
        A.files(s, d).select("session_id", "path", F.substring("content", 1, 20).alias("outline")).groupBy("session_id", "path").agg(F.min("outline").alias("outline")),
        A.files(s, d).select("session_id", F.when(F.expr("last_updated_turn % 2 = 0"), F.regexp_replace("path", "^[^/]*/", "")).otherwise(F.concat(F.lit("/root/"), "path")).alias("query")).distinct(),
    ),
    "briefing_ranges": lambda s, d: briefing.ranges(_excerpts(s, d)),
    "kept_briefings": lambda s, d: briefing.opened(briefing.kept(_briefings(s, d))).select("version", "session_id", "source_turn", F.array_join("retained_turns", ",").alias("retained_turns"), "mode", "latency_ms", F.size("files").alias("files")),
    "trace_fields": lambda s, d: briefing.merged_fields(_setters(s, d)),
    "encoded_tokens": lambda s, d: _encoded(s, d),
    "merged_tail": lambda s, d: compression.merged(compression.from_valid_head(messages.coherence_tail(_tooled(s, d), 4, 12))).select("session_id", "idx", "role", "content", "merged"),
    "ceiling_phases": lambda s, d: compression.under_ceiling(
        compression.turn_priority(_tooled(s, d), _no_selection(s, d)).withColumn("tail", F.col("idx") > F.expr("max(idx) over (partition by session_id)") - 20), 1500, limits=(300, 900), least=100
    ).select("session_id", "idx", "phase", "content"),
    "rewritten_request": lambda s, d: compression.request(
        _tooled(s, d), A.messages(s, d).select("session_id").distinct().select("session_id", F.when(F.expr("session_id % 3 > 0"), F.expr("array(2L, 1L)")).alias("turns")),
        A.facts(s, d).where("not invalidated").groupBy("session_id").agg(F.concat_ws("\n", F.array_sort(F.collect_list("content"))).alias("context")), base=3, ceiling=4000,
    ),
    "answered_calls": lambda s, d: reads.tool_results(_tooled(s, d)),
    "turn_eviction": lambda s, d: turns_.fold(A.traces(s, d).select("session_id", "turn_number", F.col("created_at").alias("at")), 3, 6 * 3600).withColumn("at", F.unix_micros("at")),
    "neighbourhood": lambda s, d: graph.reached(*_session_tree(s, d)),
    "extracted_calls": lambda s, d: extraction.extracted(_tool_calls(s, d)),
    "extracted_text": lambda s, d: extraction.extracted(_text_calls(s, d)),
    "intent_domains": lambda s, d: intents.asked(_asks(s, d)).select(
        "session_id", "idx", "question", F.array_join("refs", ",").alias("refs"), F.array_join(F.array_sort(F.map_keys("weights")), ",").alias("domains"), F.round(F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, x: a + x), 6).alias("weight")
    ),
    "topic_shift": lambda s, d: intents.topic_shift(_asks(s, d)),
    "fact_scores_intent": lambda s, d: _rounded(_by_intent(s, d), score=9),
    "fact_scores_embedding": lambda s, d: _rounded(_by_embedding(s, d), score=9),
    "read_arguments": lambda s, d: A.reads(s, d).select("session_id", "idx", provenance.read_arguments(F.concat(F.lit('{"path": "", "filename": "'), "path", F.lit('", "start_line": '), F.col("idx").cast("string"), F.when(F.col("tool") == "read", ', "line_count": "x"}').otherwise(', "limit": "40"}'))).alias("a")).select("session_id", "idx", "a.*"),
    "provenance_facts": lambda s, d: provenance.provenance(_file_calls(s, d)),
    "full_writes": lambda s, d: provenance.full_writes(_written(s, d)),
    "written_paths": lambda s, d: provenance.invalidated_paths(A.files(s, d).select("session_id", F.expr("concat('src/', session_id + last_updated_turn % 2)").alias("path")), provenance.full_writes(_written(s, d))),
    "resolved_sessions": lambda s, d: provenance.resolved_sessions(_requests(s, d)),
    "environment_fields": lambda s, d: _system_prompts(s, d).select("event_id", F.explode(T.environment(F.col("system"))).alias("name", "value")),
    "imported_modules": lambda s, d: A.table(s, d, "documents").select("doc_id", F.explode(T.imported_modules(F.concat(F.lit("import "), "source", F.lit(".x\n"), "text", F.lit("\n  from "), "lang", F.lit(" import y")))).alias("module")).withColumn("files", F.array_join(T.module_paths(F.col("module")), ",")),
    "head_and_tail": lambda s, d: A.table(s, d, "documents").select("doc_id", T.head_and_tail(F.col("text")).alias("text")),
    "retrieval_ranking": lambda s, d: _rounded(files.retrieval_ranked(A.files(s, d).withColumns({"reason": F.expr("concat('score ', last_updated_turn % 11, ' of 10')"), "pos": F.col("last_updated_turn")}), QUERY, (1.0, 0.5, 2.0)), score=9),
    "merged_files": lambda s, d: files.first_seen(A.reads(s, d).groupBy("session_id", F.expr("idx div 4").alias("turn")).agg(F.array_sort(F.collect_list(F.struct("idx", "path")))["path"].alias("paths"))),
    "cache_costs": lambda s, d: _rounded(traces.cache_costs(A.traces(s, d).withColumns({"cache_hit_tokens": F.col("savings_tokens"), "cache_miss_tokens": F.col("input_tokens") - F.col("savings_tokens")})), cost=9, uncached_cost=9, hit_rate=9),
    "briefing_freshness": lambda s, d: traces.briefing_freshness(A.traces(s, d)),
    "expired_cleanup": lambda s, d: sessions.expired_rows({"traces": A.traces(s, d), "messages": A.messages(s, d)}, A.traces(s, d).groupBy("session_id").agg(F.count_if("failed").alias("n")).where("n > 10")),
    "noise_facts": lambda s, d: evals.noise(*_audited(s, d)),
    "audit_gates": lambda s, d: _rounded(evals.audit_gates(A.table(s, d, "events").select(F.get_json_object("props", "$").isNotNull().alias("parsed")), QUERIES["truth_overlap"](s, d), evals.noise(*_audited(s, d))), parse_rate=9, accuracy=9, noise_rate=9),
    "session_summary": lambda s, d: traces.session_summary(A.traces(s, d)),
    "global_metrics": lambda s, d: _rounded(traces.global_metrics(A.traces(s, d)), curator_latency=6),
    "mode_counts": lambda s, d: traces.mode_counts(A.traces(s, d), ["curator", "briefing", "cold_start"]),
    "counters_and_gauges": lambda s, d: traces.counters_and_gauges(A.traces(s, d).select(F.col("assembly_mode").alias("metric"), F.col("event_id").alias("at"), F.col("input_tokens").alias("value"))),
    "latency_nearest_rank": lambda s, d: traces.nearest_rank(A.traces(s, d), "assembly_mode", "latency_ms", ["created_at", "event_id"]),
    "trace_cap": lambda s, d: traces.newest(A.traces(s, d), "session_id", ["turn_number"], 50).select("session_id", "turn_number", "event_id"),
    "lru_sessions": lambda s, d: traces.lru_sessions(A.traces(s, d)),
    "latency_deltas": lambda s, d: _rounded(traces.latency_deltas(A.traces(s, d)), trailing_mean=6, trailing_delta=6),
    "failure_streaks": lambda s, d: traces.failure_streaks(A.traces(s, d)),
    "output_collapse_runs": lambda s, d: traces.runs_below(A.traces(s, d), 30.0),
    "folded_events": lambda s, d: traces.folded_events(A.traces(s, d), ["passthrough", "cold_start"]),
    "session_ttl": lambda s, d: traces.expired_sessions(A.traces(s, d), F.lit(NOW).cast("timestamp"), 72),
    "running_token_budget": lambda s, d: traces.running_budget(A.traces(s, d), 100000),
    "recall_events": lambda s, d: traces.recall_events(A.traces(s, d)),
    "session_page": lambda s, d: traces.page(A.traces(s, d), 7, 10, 20).select("session_id", "turn_number", "event_id"),
    "rewrite_gate": lambda s, d: traces.rewrite_gate(A.traces(s, d)),
    "turn_reconciliation": lambda s, d: traces.reconcile_turns(A.facts(s, d).groupBy("session_id").agg(F.max("source_turn").alias("graph_turn")), A.traces(s, d)),
    "token_savings": lambda s, d: traces.savings(A.traces(s, d)),
    "windowed_modes": lambda s, d: stateful.windowed_modes(A.traces(s, d)),
    "read_redundancy": lambda s, d: reads.redundancy(A.reads(s, d)),
    "repeated_reads": lambda s, d: reads.repeated(A.reads(s, d)),
    "repeat_flags": lambda s, d: reads.repeats(A.reads(s, d)),
    "stuck_loops": lambda s, d: reads.stuck(A.reads(s, d).withColumn("bad", F.expr("int(substring(content, 6, 9)) % 2 = 0")), "bad", 2),
    "tool_call_join": lambda s, d: reads.calls_with_results(
        A.reads(s, d).select("session_id", F.concat(F.lit("c"), F.col("idx").cast("string")).alias("call_id"), "tool", "path"),
        A.reads(s, d).where("tool <> 'write'").select("session_id", F.concat(F.lit("c"), F.col("idx").cast("string")).alias("call_id"), "content"),
    ),
    "tool_families": lambda s, d: reads.tool_families(A.reads(s, d), s.createDataFrame([("re", "files"), ("read", "read"), ("b", "shell")], "prefix string, extractor string")),
    "turn_segmentation": lambda s, d: messages.turns(A.messages(s, d)).select("session_id", "idx", "role", "turn"),
    "turn_inventory": lambda s, d: messages.turn_inventory(A.messages(s, d)),
    "turn_boundaries": lambda s, d: messages.boundaries(A.messages(s, d)),
    "coherence_tail": lambda s, d: messages.coherence_tail(A.messages(s, d), 3),
    "last_exchanges": lambda s, d: messages.last_exchanges(A.messages(s, d), 2),
    "merged_roles": lambda s, d: messages.merged_roles(A.messages(s, d).withColumn("role", F.when(F.col("idx") % 3 == 1, "user").otherwise(F.col("role")))),
    "session_fingerprint": lambda s, d: messages.fingerprints(A.messages(s, d)),
    "message_fingerprint": lambda s, d: A.messages(s, d).select("session_id", "idx", T.message_fingerprint(F.col("role"), F.col("content")).alias("fingerprint")),
    "token_accounting": lambda s, d: messages.content_tokens(A.messages(s, d)),
    "request_prefixes": lambda s, d: messages.request_prefixes(A.messages(s, d)),
    "selected_turns": lambda s, d: messages.selected_turns(
        A.messages(s, d), A.messages(s, d).select("session_id").distinct().select("session_id", F.when(F.col("session_id") % 3 == 1, F.expr("array(1L)")).when(F.col("session_id") % 3 == 2, F.expr("cast(array() as array<bigint>)")).alias("turns")), 2
    ).select("session_id", "idx", "turn"),
    "intent_class": lambda s, d: messages.intents(A.messages(s, d)),
    "message_preview": lambda s, d: messages.previews(A.messages(s, d), 100),
    "result_tail": lambda s, d: messages.tail_of_results(A.messages(s, d), 600),
    "active_facts": lambda s, d: facts.active(A.facts(s, d), 5).select("session_id", "fact_id", "source_turn"),
    "facts_filtered": lambda s, d: facts.filtered(A.facts(s, d), ["error", "decision"], 0.4, 2, 15).select("session_id", "fact_id", "fact_type", "confidence"),
    "fact_counts": lambda s, d: facts.counts(A.facts(s, d)),
    "fact_types": lambda s, d: _rounded(facts.type_distribution(A.facts(s, d)), confidence=9),
    "keyword_search": lambda s, d: facts.keyword_search(A.facts(s, d), "The", 3).select("session_id", "fact_id"),
    "supersession_chains": lambda s, d: facts.chains(A.facts(s, d), A.supersedes(s, d)),
    "exact_dedup": lambda s, d: facts.exact_duplicates(A.facts(s, d)),
    "known_content": lambda s, d: facts.without_known(_said_again(s, d).where("fact_id >= 1000000000"), A.facts(s, d).where("source_turn <= 10")).select("session_id", "fact_id"),
    "best_match_invalidation": lambda s, d: facts.best_match(_descriptions(s, d), A.facts(s, d)),
    "near_dup_pairs": lambda s, d: facts.near_duplicates(_said_again(s, d)),
    "context_window": lambda s, d: facts.context_window(A.facts(s, d).where("fact_type = 'decision'"), A.facts(s, d)).select("session_id", "fact_id", "source_turn"),
    "fact_scores": lambda s, d: _rounded(facts.scored(A.facts(s, d)).select("session_id", "fact_id", "score"), score=9),
    "budget_prefix": lambda s, d: _rounded(facts.budget_prefix(A.facts(s, d), 3000), score=9),
    "budget_fill": lambda s, d: facts.budget_fill(A.facts(s, d), 3000),
    "promotable_facts": lambda s, d: facts.promotable(A.facts(s, d)).select("session_id", "fact_id", "dedupe_key"),
    "invalidated_facts": lambda s, d: facts.invalidate(A.facts(s, d), A.facts(s, d).where("fact_type = 'error'").select("session_id", "fact_id")).select("session_id", "fact_id", "invalidated"),
    "latest_fact": lambda s, d: facts.latest(A.facts(s, d).select("session_id", "fact_type", "fact_id", "source_turn"), ["session_id", "fact_type"], ["source_turn", "fact_id"]),
    "file_lookup": lambda s, d: files.lookup(A.files(s, d), A.files(s, d).select("session_id", F.regexp_extract("path", "([^/]+)$", 1).alias("query")).where("query <> ''").distinct()),
    "line_slice": lambda s, d: files.line_slice(A.files(s, d), 2, 5),
    "file_outline": lambda s, d: files.outline(A.files(s, d)),
    "file_eviction": lambda s, d: files.evicted(A.files(s, d), 100, 5).select("session_id", "path", "last_updated_turn"),
    "reference_extract": lambda s, d: files.references(A.files(s, d)),
    "in_degree": lambda s, d: files.dependency_order(files.in_degree(A.files(s, d).select("session_id", "path"), _path_edges(s, d))),
    "score_propagation": lambda s, d: _rounded(files.propagated(files.relevance(A.files(s, d), QUERY).select("session_id", "path", F.col("relevance").alias("score")), _path_edges(s, d)), score=9),
    "recurring_patterns": lambda s, d: files.recurring(A.files(s, d).withColumn("path", F.concat("path", F.when(F.col("last_updated_turn") % 2 == 0, ".html").otherwise(".py")))),
    "keyword_relevance": lambda s, d: files.relevance(A.files(s, d), QUERY),
    "combo_order": lambda s, d: files.combined_order(files.relevance(A.files(s, d), QUERY), files.dependency_order(files.in_degree(A.files(s, d).select("session_id", "path"), _path_edges(s, d)))),
    "file_touches": lambda s, d: files.touches(A.reads(s, d).select("session_id", "path", F.when(F.col("tool") == "write", "modified").when(F.col("tool") == "read", "read").otherwise("seen").alias("status"), F.col("idx").alias("turn"))),
    "file_union": lambda s, d: files.union(A.files(s, d), A.files(s, d).where("last_updated_turn % 3 = 0").select("session_id", "path", (F.col("last_updated_turn") + 5).alias("turn")).union(A.files(s, d).where("last_updated_turn % 3 = 1").select("session_id", F.concat("path", F.lit("/new")), "last_updated_turn"))),
    "semantic_topk": lambda s, d: _rounded(ranking.semantic_top(
        A.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), A.table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10
    ), similarity=9),
    "label_norms": lambda s, d: _rounded(ranking.label_centroid_similarity(A.table(s, d, "embeddings")), mean_norm=9),
    "probe_recall": lambda s, d: evals.keyword_recall(A.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), ["license", "the", "email", "und"]),
    "edit_fidelity": lambda s, d: evals.edit_fidelity(A.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), ["the", "and"], ["License"]),
    "run_totals": lambda s, d: evals.totals(_runs(s, d), 40),
    "run_compare": lambda s, d: evals.compared(_flag_runs(s, d, "A"), _flag_runs(s, d, "R"), "l_suppkey", "quantity"),
    "micro_averages": lambda s, d: evals.micro_average(
        A.table(s, d, "lineitem").selectExpr("l_quantity as file_hit", "l_quantity + l_linenumber as file_gold", "l_quantity + 1 as file_pred", "double(l_linenumber) as line_hit", "l_quantity as line_gold", "double(l_linenumber + 2) as line_pred"), ["file", "line"]
    ),
    "sweep_statistics": lambda s, d: _rounded(evals.sweep(A.table(s, d, "orders").select(F.col("o_orderpriority").alias("arm"), (F.col("o_orderstatus") == "F").alias("complete"), F.col("o_totalprice").alias("seconds"))), median=6, mean=4),
    "truth_overlap": lambda s, d: evals.truth_overlap(
        A.facts(s, d).where("not invalidated").select(F.expr("session_id * 10 + (source_turn - 1) div 4").alias("turn"), F.col("fact_id").alias("id"), "content"), A.facts(s, d).select(F.expr("session_id * 10 + (source_turn - 1) div 4").alias("turn"), F.col("fact_id").alias("truth_id"), F.concat(F.lit("also "), "content").alias("content"))
    ),
    "audit_gate": lambda s, d: evals.audit(QUERIES["truth_overlap"](s, d)),
    "calibration_gaps": lambda s, d: _rounded(evals.calibration(A.traces(s, d).select(F.col("assembly_mode").alias("category"), F.col("savings_tokens").alias("estimate"), F.col("input_tokens").alias("actual"))), mean_gap=6),
    "pii_redact": lambda s, d: A.table(s, d, "documents").select("doc_id", T.redact(F.col("text"), "truncate").alias("short"), T.redact(F.col("text"), "hash").alias("hash"), T.redact(F.col("text"), "redact").alias("redacted")),
    "slugs": lambda s, d: A.table(s, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug")),
    "event_json": lambda s, d: A.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), C.path_argument(F.col("props")).alias("path")),
    "sse_reassembly": lambda s, d: stateful.reassembled(_chunks(s, d)),
    "recent_sessions": lambda s, d: sessions.recent(A.table(s, d, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_acctbal").alias("updated")), A.table(s, d, "orders").select(F.col("o_custkey").alias("session_id")), 50),
    "storage_summary": lambda s, d: sessions.storage({"facts": A.facts(s, d), "files": A.files(s, d), "messages": A.messages(s, d)}),
    "pruned_state": lambda s, d: sessions.pruned(A.traces(s, d), A.traces(s, d).where("failed and turn_number > 60")).select("session_id", "turn_number"),
    "find_or_create": lambda s, d: sessions.find_or_create(
        messages.fingerprints(A.messages(s, d)).where("session_id % 2 = 0").groupBy("fingerprint").agg(F.min("session_id").cast("string").alias("session_id")), messages.fingerprints(A.messages(s, d))
    ),
    "changed_config": lambda s, d: sessions.changed_keys(A.traces(s, d).groupBy("assembly_mode").agg(F.create_map(
        F.lit("turns"), F.count("*").cast("string"), F.lit("fixed"), F.lit("1"), F.concat(F.lit("only_"), F.col("assembly_mode")), F.lit("x")).alias("config")).withColumnRenamed("assembly_mode", "experiment")),
    "plugin_metrics": lambda s, d: sessions.dotted_metrics(A.traces(s, d).select(F.concat(F.when(F.col("failed"), "plugin.").otherwise("other."), F.col("assembly_mode"), F.lit(".a.b")).alias("key"), F.col("input_tokens").alias("value"))),
    "reserved_calls": lambda s, d: sessions.reserved_calls(A.traces(s, d).select("session_id", F.floor((F.col("turn_number") - 1) / 8).alias("turn"), F.col("turn_number").alias("pos"), F.col("savings_tokens").alias("tokens"))),
    "embedding_cache": lambda s, d: sessions.cached(A.table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("at")), 300000.0, 100000.0),
    "compression_ratio": lambda s, d: _rounded(sessions.compression_ratio(A.messages(s, d)), ratio=9),
    "compressed_context": lambda s, d: sessions.compressed_to(A.messages(s, d), 300),
    "promotion_stats": lambda s, d: sessions.promotion_stats(A.facts(s, d)),
    "extraction_dry_run": lambda s, d: sessions.dry_run(_said_again(s, d).where("source_turn > 10"), A.facts(s, d).where("source_turn <= 10")),
    "recall_answer": lambda s, d: sessions.recall_answer(A.facts(s, d), 3000),
    "file_checks": lambda s, d: sessions.file_checks(A.files(s, d), "<h1", 5),
    "work_summary": lambda s, d: sessions.work_summary(A.facts(s, d), {"error": 2, "decision": 1, "state": 1, "goal": 3}),
    "consent_state": lambda s, d: sessions.consent(A.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", " TRUE ").when(F.col("o_orderstatus") == "O", "no").alias("header"))),
    "token_hints": lambda s, d: sessions.token_hints(A.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("header"), F.floor(F.col("o_totalprice") / 1000).cast("string").alias("meta"), F.col("o_orderkey").cast("string").alias("body"))),
    "code_map": lambda s, d: files.code_map(files.in_degree(A.files(s, d).select("session_id", "path"), _path_edges(s, d)), _path_edges(s, d)),
    "resolved_references": lambda s, d: files.resolved(_path_edges(s, d).select("session_id", F.col("src").alias("path"), F.concat(F.lit("./"), F.col("dst")).alias("target")), A.files(s, d)),
    "compression_priority": lambda s, d: messages.compression_priority(A.messages(s, d)),
    "session_windows": lambda s, d: stateful.expired(A.traces(s, d).select("session_id", F.col("created_at").alias("at")), 6),
    "first_seen_trail": lambda s, d: stateful.latest_first(A.traces(s, d), "session_id", "created_at", 20),
    "fact_supersession_edges": lambda s, d: facts.supersession_edges(A.facts(s, d).withColumn("source_turn", F.expr("(source_turn - 1) div 10"))),
    "fact_near_known": lambda s, d: facts.without_near_known(_said_again(s, d).where("source_turn > 10").withColumn("pos", F.col("fact_id")), A.facts(s, d).where("source_turn <= 10")).select("session_id", "fact_id"),
    "code_fill": lambda s, d: rewriting.code_fill(A.files(s, d).withColumn("rank", F.col("last_updated_turn")), 20000),
    "current_turn": lambda s, d: rewriting.current_turn(A.messages(s, d)).select("session_id", "idx"),
    "strongest_status": lambda s, d: rewriting.strongest(A.reads(s, d).select("session_id", "path", F.col("tool").alias("status"), F.col("idx").alias("pos")), ["grep", "bash", "read", "write"]),
    "resolved_issues": lambda s, d: rewriting.resolved_issues(
        A.facts(s, d).where("fact_type = 'error'").select("session_id", F.col("content").alias("summary"), F.col("source_turn").alias("turn")),
        _said_again(s, d).where("fact_type = 'error'").select("session_id", F.col("content").alias("summary"), F.col("source_turn").alias("turn")),
    ),
    "prefix_splice": lambda s, d: rewriting.spliced(A.messages(s, d), A.messages(s, d).where("idx = 1").select("session_id", F.lit(2).cast("long").alias("count"), T.message_fingerprint(F.when(F.col("session_id") % 2 == 0, F.col("role")).otherwise("x"), F.col("content")).alias("fingerprint"))),
    "search_hits": lambda s, d: rewriting.search_hits(A.files(s, d), "<p", 3, 6),
    "cached_view": lambda s, d: rewriting.cached_view(A.files(s, d), 8, 2),
    "rewritten_context": lambda s, d: rewriting.rewritten(A.messages(s, d), A.messages(s, d).select("session_id").distinct().select("session_id", F.expr("array(1L)").alias("turns")), 3, 120),
    "recall_requests": lambda s, d: A.messages(s, d).select("session_id", "idx", P.asks_to_recall(F.col("role"), F.col("content")).alias("recall"), P.ambiguous(F.col("content"), 40).alias("ambiguous")),
    "compressed_facts": lambda s, d: A.facts(s, d).select("fact_id", P.compressed_fact(F.concat(F.lit("I think that, to be frank, "), F.col("content"), F.lit(".")), *PHRASES).alias("fact")),
    "command_names": lambda s, d: A.traces(s, d).select("event_id", P.command_name(F.concat(F.lit("A=1 "), F.when(F.col("failed"), "cd").otherwise(F.col("assembly_mode")), F.lit("|head -3"))).alias("command")),
    "tool_outcomes": lambda s, d: A.reads(s, d).select("session_id", "idx", P.compressible(F.concat(F.lit("my_"), F.col("tool"))).alias("compressible"), P.outcome(F.when(F.col("idx") % 5 == 0, F.concat(F.lit(" Error: "), F.col("content"))).when(F.col("idx") % 7 == 0, "file not found").otherwise(F.col("content"))).alias("outcome")),
    "file_patterns": lambda s, d: A.table(s, d, "pages").select("page_id", P.file_pattern(F.concat(F.initcap(F.regexp_replace("url", "^https?://|/.*$|[.]", " ")), F.regexp_extract("url", "[.][a-z]+$", 0))).alias("pattern")),
    "context_blocks": lambda s, d: R.context_blocks(A.facts(s, d).select("session_id", F.col("fact_id").alias("pos"), F.upper("fact_type").alias("title"), F.when(~F.col("invalidated"), F.col("content")).alias("body"))),
    "task_map": lambda s, d: R.task_map(files.relevance(A.files(s, d), QUERY), "1"),
    "session_overview": lambda s, d: R.overview(A.files(s, d), A.facts(s, d).where("fact_type = 'decision'"), 5, 3),
    "focus_range": lambda s, d: R.focus_range(files.outline(A.files(s, d)), QUERY),
    "event_lines": lambda s, d: R.event_line(A.traces(s, d)),
    "front_matter": lambda s, d: R.front_matter(A.facts(s, d)),
    "cut_blocks": lambda s, d: A.table(s, d, "documents").select("doc_id", R.closed_fence(F.concat(F.lit("```\n"), "text", F.lit("\n```")), 60).alias("block")),
}
