"""Row-expanding and trajectory-building operators (survey T1-T23, W6), on arrays of turns.

Turns are array<struct<from, value>> unless a docstring says otherwise. Everything is a projection with higher-order
functions, at most one explode per row and no shuffle; T13 joins external texts and groups back by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_think, tag_think, text_or_empty, truthy

TURN = "struct<from:string,value:string>"
TURNS = f"array<{TURN}>"


def turn(who: str, value: Column) -> Column:
    return F.struct(F.lit(who).alias("from"), value.alias("value"))


def from_messages(messages: Column) -> Column:
    """Chat messages (role, content) to turns: user to human, assistant to gpt, tool to observation; system is left out; null content is ''."""
    kept = F.filter(messages, lambda m: m["role"] != "system")
    name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").when(r == "tool", "observation").otherwise(r)
    return F.coalesce(F.transform(kept, lambda m: F.struct(name(m["role"]).alias("from"), text_or_empty(m["content"]).alias("value"))), F.array().cast(TURNS))


def normalise_calls(turns: Column) -> Column:
    """D3: legacy calls (from, name, arguments, value null) get a JSON value; others keep theirs."""
    call = lambda t: F.concat(F.lit('{"name": "'), text_or_empty(t["name"]), F.lit('", "arguments": '), F.coalesce(truthy(t["arguments"]), F.lit("{}")), F.lit("}"))
    return F.transform(turns, lambda t: F.struct(t["from"].alias("from"), F.when(t["value"].isNull() & (t["from"] == "function_call"), call(t)).otherwise(text_or_empty(t["value"])).alias("value")))


def log_to_chat(question: Column, trace: Column, answer: Column) -> Column:
    """Human question; per call '<think>thought</think>\\n{"name", "arguments"}' and its observation; final answer.

    trace: array<struct<event, tool_name, args map, content_text, content_preview>>. Null if the answer is blank or
    'unknown', a call lacks a thought, or a call repeats the one before it.
    """
    calls = F.filter(trace, lambda e: e["event"] == "tool_call")
    thought = lambda e: F.trim(text_or_empty(F.element_at(e["args"], "thought")))
    body = lambda e: F.concat(F.lit('{"name": "'), F.trim(text_or_empty(e["tool_name"])), F.lit('", "arguments": '), F.to_json(F.map_filter(e["args"], lambda k, v: k != "thought")), F.lit("}"))
    sig = F.transform(calls, body)
    again = F.when(F.size(sig) > 1, F.exists(F.sequence(F.lit(1), F.size(sig) - 1), lambda i: F.get(sig, i) == F.get(sig, i - 1)))
    text = lambda e: F.coalesce(truthy(e["content_text"]), e["content_preview"], F.lit(""))
    middle = F.transform(F.coalesce(trace, F.array()), lambda e: F.when(e["event"] == "tool_call", turn("function_call", F.concat(F.lit("<think>"), thought(e), F.lit("</think>\n"), body(e)))).otherwise(turn("observation", text(e))))
    ok = (F.trim(text_or_empty(answer)) != "") & (F.lower(F.trim(text_or_empty(answer))) != "unknown") & ~F.coalesce(F.exists(calls, lambda e: thought(e) == ""), F.lit(False)) & ~F.coalesce(again, F.lit(False))
    return F.when(ok, F.concat(F.array(turn("human", text_or_empty(question))).cast(TURNS), middle.cast(TURNS), F.array(turn("gpt", F.trim(answer))).cast(TURNS)))


def rounds_to_chat(question: Column, responses: Column, observations: Column, recaps: Column) -> Column:
    """Tool mode. Response i is followed by observation i; recap i is shifted into the think block of response i + 1."""
    shifted = F.transform(responses, lambda r, i: F.when((i > 0) & (F.coalesce(F.get(recaps, i - 1), F.lit("")) != ""), tag_think(r, F.concat(F.get(recaps, i - 1), F.lit(" ")))).otherwise(r))
    n = F.size(responses)
    pair = lambda r, i: F.when(i < n - 1, F.array(turn("function_call", r), turn("observation", F.coalesce(F.get(observations, i), F.lit(""))))).otherwise(F.array(turn("gpt", r)))
    return F.concat(F.array(turn("human", text_or_empty(question))).cast(TURNS), F.flatten(F.transform(shifted, pair)).cast(TURNS))


def align_image_tags(turns: Column, images: Column, tag: str = "<image>") -> Column:
    """struct(turns, reason). One tag in the first human turn, the others on image-like observations in order.

    Rejected (turns null): no images, no human turn, or fewer image-like observations than further images.
    """
    n = F.coalesce(F.size(images), F.lit(0))
    bare = F.transform(turns, lambda t: F.struct(t["from"].alias("from"), F.trim(F.replace(text_or_empty(t["value"]), F.lit(tag), F.lit(""))).alias("value")))
    like = lambda t: (t["from"] == "observation") & F.lower(t["value"]).rlike("image|crop|zoom|img_round")
    at = F.filter(F.transform(bare, lambda t, i: F.when(like(t), i)), lambda i: i.isNotNull())
    human = F.array_min(F.filter(F.transform(bare, lambda t, i: F.when(t["from"] == "human", i)), lambda i: i.isNotNull()))
    use = F.array_union(F.array(human), F.when(n > 1, F.slice(at, F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")))
    tagged = F.transform(bare, lambda t, i: F.struct(t["from"].alias("from"), F.when(F.array_contains(use, i), F.concat(F.lit(tag + "\n"), t["value"])).otherwise(t["value"]).alias("value")))
    reason = F.when(n == 0, "rejected_no_images").when(human.isNull(), "rejected_no_human").when(F.size(at) < n - 1, "rejected_not_enough_image_observations")
    return F.struct(F.when(reason.isNull(), tagged).alias("turns"), reason.alias("reason"))


def finish_terminate(turns: Column) -> Column:
    """T4: turns whose last is a Terminate call get an observation and a final turn with its answer; a long think block moves to the final turn."""
    last = F.get(turns, F.size(turns) - 1)
    ans = F.coalesce(F.get_json_object(strip_think(last["value"]), "$.arguments.ans"), F.lit(""))
    is_end = (last["from"] == "function_call") & last["value"].contains("Terminate")
    think = F.regexp_extract(text_or_empty(last["value"]), r"(?s)(<think>.*?</think>)", 1)
    long_ = F.length(think) > 1000
    call = turn("function_call", F.when(long_, strip_think(last["value"])).otherwise(last["value"]))
    final = turn("gpt", F.when(long_, F.concat(think, F.lit("\n"), ans)).otherwise(ans))
    more = F.array(call, turn("observation", F.lit("finished")), final).cast(TURNS)
    return F.when(is_end, F.concat(F.slice(turns, F.lit(1), F.size(turns) - 1).cast(TURNS), more)).otherwise(turns)


# agents: array<struct<agent_role, instruction, messages array<struct<role, content>>>> -------------------------------


def agent(agents: Column, role: str) -> Column:
    """The first agent whose role contains the word; null if none."""
    return F.get(F.filter(agents, lambda a: F.lower(text_or_empty(a["agent_role"])).contains(role)), F.lit(0))


def said(a: Column, which: str = "last") -> Column:
    """The first or last assistant message of an agent, null if none."""
    m = F.filter(a["messages"], lambda x: x["role"] == "assistant")
    return F.get(m, F.lit(0) if which == "first" else F.size(m) - 1)["content"]


def pair_rows(question: Column, answer: Column) -> Column:
    return F.array(turn("human", text_or_empty(question)), turn("gpt", answer)).cast(TURNS)


#: Answers for traces without an assessor, by difficulty; other difficulties have none.
DIFFICULTY_ANSWERS = {
    "basic": "<think>One fact answers the question, so no second opinion is needed.</think>\n1) basic",
    "intermediate": "<think>Several findings have to be weighed together, so specialists should confer.</think>\n2) intermediate",
}
DIFFICULTY_PROMPT = "Say how difficult this question is: 1) basic, 2) intermediate or 3) advanced.\n\n{question}"


#: Fixed value: the reasoning of an assessment that gives none.
DIFFICULTY_UNSAID = "Based on the nature of this medical query, it can be classified accordingly."


def difficulty_think(c: Column) -> Column:
    """An assessment as '<think>reasoning</think>' and 'N) level': the reasoning after the word Reasoning, else what follows
    the level, else what stands before it, else a general sentence; an assessment without a level becomes a thought as a whole."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    named = r"\d\)\s*(?:basic|intermediate|advanced)"
    clean = strip(F.regexp_replace(text_or_empty(c), r"\*{2,}", ""))
    level = F.regexp_extract(clean, rf"(?i)({named})", 1)
    reason = strip(F.regexp_extract(clean, r"(?is)Reasoning:?\s*(.+)", 1))
    after = strip(F.regexp_replace(F.regexp_replace(clean, rf"(?is)^.*?{named}", ""), r"^[\s:#\-]+", ""))
    before = strip(F.regexp_replace(strip(F.regexp_extract(clean, rf"(?is)^(.*?){named}", 1)), r"(?i)^.*(?:Difficulty|Assessment)\s*:?\s*", ""))
    why = F.coalesce(*(F.when(x != "", x) for x in (reason, after, before)), F.lit(DIFFICULTY_UNSAID))
    return F.when(level == "", F.concat(F.lit("<think>"), clean, F.lit("</think>"))).otherwise(F.concat(F.lit("<think>"), why, F.lit("</think>\n"), level))


def difficulty_row(question: Column, agents: Column, difficulty: Column, image: Column | None = None, prompt: str = DIFFICULTY_PROMPT, answers: dict[str, str] | None = None) -> Column:
    """T5: the prompt, after an image tag where `image` holds, with the assessor's last response as thought and level; without an
    assessor a fixed answer for basic and intermediate. Null for an assessor without a response, and without both."""
    assessor = agent(agents, "difficulty")
    own = truthy(said(assessor))
    fixed = F.lit(None).cast("string")
    for level, text in (answers or DIFFICULTY_ANSWERS).items():
        fixed = F.when(difficulty == level, text).otherwise(fixed)
    answer = F.when(assessor.isNotNull(), F.when(own.isNotNull(), difficulty_think(own))).otherwise(fixed)
    head, tail = prompt.split("{question}")
    asked = F.concat(F.when(image, "<image>\n").otherwise("") if image is not None else F.lit(""), F.lit(head), text_or_empty(question), F.lit(tail))
    return F.when(answer.isNotNull(), pair_rows(asked, answer))


def recruitment_row(question: Column, agents: Column, difficulty: Column) -> Column:
    """Intermediate traces only, the recruiter's last message."""
    text = truthy(said(agent(agents, "recruiter")))
    return F.when((difficulty == "intermediate") & text.isNotNull(), pair_rows(question, text))


#: Roles that are no domain experts.
SERVICE_ROLES = ["recruiter", "moderator", "difficulty", "recap", "summar"]


def expert_rows(question: Column, agents: Column) -> Column:
    """Array of struct(role, turns), one per domain expert with at least 3 messages and a first response that is not truncated."""
    from .filters import truncated

    service = lambda a: F.lower(text_or_empty(a["agent_role"])).rlike("|".join(SERVICE_ROLES))
    good = F.filter(agents, lambda a: ~service(a) & (F.size(a["messages"]) >= 3) & said(a, "first").isNotNull() & ~truncated(said(a, "first")))
    return F.transform(good, lambda a: F.struct(a["agent_role"].alias("role"), pair_rows(question, said(a, "first")).alias("turns")))


def debate_rows(messages: Column, start: int = 3, participate_head: int = 20) -> Column:
    """Array of struct(turns, participated) from message `start` on: every user message with the assistant message
    that follows it. A bare No becomes a sentence; participated if the first characters do not say no."""
    n = F.size(messages)
    at = F.when(n > start + 1, F.sequence(F.lit(start), n - 2)).otherwise(F.array().cast("array<int>"))
    use = F.filter(at, lambda i: (F.get(messages, i)["role"] == "user") & (F.get(messages, i + 1)["role"] == "assistant"))
    answer = lambda i: text_or_empty(F.get(messages, i + 1)["content"])
    full = lambda i: F.when(F.lower(F.trim(answer(i))).isin("no", "no."), "No, I have nothing to add at this point.").otherwise(answer(i))
    return F.transform(use, lambda i: F.struct(pair_rows(F.get(messages, i)["content"], full(i)).alias("turns"), (~F.lower(F.substring(answer(i), 1, participate_head)).rlike(r"\bno\b")).alias("participated")))


def synthesis_row(question: Column, agents: Column, difficulty: Column) -> Column:
    """Basic: the last agent's last pair; intermediate: the summariser's text as think block before the moderator's answer."""
    last = F.get(agents, F.size(agents) - 1)
    summary = F.get(F.filter(agents, lambda a: F.lower(text_or_empty(a["instruction"])).contains("summarizing and synthesizing")), F.lit(0))
    final = truthy(said(agent(agents, "moderator")))
    mid = F.concat(F.lit("<think>"), F.coalesce(said(summary), F.lit("")), F.lit("</think>\n"), final)
    return F.when(difficulty == "intermediate", F.when(final.isNotNull(), pair_rows(question, mid))).otherwise(F.when(truthy(said(last)).isNotNull(), pair_rows(question, said(last))))


def recap_row(row: Column, recap: Column) -> Column:
    """A row whose answer gets the recap as think block; null without recap."""
    ans = F.get(row, F.size(row) - 1)
    return F.when(row.isNotNull() & truthy(recap).isNotNull(), F.concat(F.slice(row, F.lit(1), F.size(row) - 1), F.array(turn("gpt", F.concat(F.lit("<think>"), recap, F.lit("</think>\n"), strip_think(ans["value"])))).cast(TURNS)))


def fan_out(df: DataFrame, kinds: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per record and type whose turns are not null: keep columns, sft_type, turns. One explode, no union of scans."""
    all_ = F.filter(F.array(*(F.struct(F.lit(k).alias("sft_type"), c.cast(TURNS).alias("turns")) for k, c in kinds.items())), lambda s: s["turns"].isNotNull())
    return df.select(*keep, F.inline(all_))


def direct_answer(question: Column, response: Column) -> Column:
    """Question and final answer, when the response has no call and is not blank."""
    return F.when((F.trim(text_or_empty(response)) != "") & ~text_or_empty(response).contains("<tool_call>"), pair_rows(question, F.trim(response)))


def replace_thinking(df: DataFrame, texts: DataFrame, key: str, turns: str = "turns") -> DataFrame:
    """The think block of every call turn replaced by the text given for (key, step), step counting calls from 0.

    Records without any text are left out; calls without a text keep theirs. Adds retrospective = true. Texts are
    gathered per record before the join, so turns are not exploded.
    """
    per = texts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("step", "text"))).alias("__m"))
    x = df.join(per, key)
    c = F.col(turns)
    no = F.transform(c, lambda t, i: F.size(F.filter(F.slice(c, F.lit(1), i + 1), lambda u: u["from"] == "function_call")) - 1)
    new = F.zip_with(c, no, lambda t, k: F.struct(t["from"].alias("from"), F.when((t["from"] == "function_call") & F.element_at("__m", k).isNotNull(), F.concat(F.lit("<think>"), F.element_at("__m", k), F.lit("</think>\n"), strip_think(t["value"]))).otherwise(t["value"]).alias("value")))
    return x.withColumn(turns, new).withColumn("retrospective", F.lit(True)).drop("__m")


def numbered_calls(turns: Column) -> Column:
    """Array of struct(step from 1, call, observation): call turns with the observation that follows at once, else ''."""
    at = F.filter(F.transform(turns, lambda t, i: F.when(t["from"] == "function_call", i)), lambda i: i.isNotNull())
    nxt = lambda i: F.when(F.get(turns, i + 1)["from"] == "observation", F.get(turns, i + 1)["value"])
    return F.transform(at, lambda i, k: F.struct((k + 1).alias("step"), F.get(turns, i)["value"].alias("call"), F.coalesce(nxt(i), F.lit("")).alias("observation")))


def render(turns: Column, head: int = 500) -> Column:
    """T14: 'Step n: call' and '→ observation' lines, observations up to 500 characters (the format's limit)."""
    return F.array_join(F.transform(numbered_calls(turns), lambda s: F.concat(F.lit("Step "), s["step"].cast("string"), F.lit(": "), strip_think(s["call"]), F.lit("\n→ "), F.substring(s["observation"], 1, head))), "\n")


def long_questions(df: DataFrame, keep: list[str], columns: dict[str, str], absent: str = "N/A") -> DataFrame:
    """Wide question columns to rows (keep, slot, question); null and N/A left out."""
    parts = F.array(*(F.struct(F.lit(slot).alias("slot"), F.col(c).cast("string").alias("question")) for c, slot in columns.items()))
    return df.select(*keep, F.inline(F.filter(parts, lambda s: s["question"].isNotNull() & (s["question"] != absent))))


def align_system(system: Column, turns: Column, instruction: str) -> Column:
    """The think instruction goes from the system prompt if no call thinks."""
    thinks = F.exists(turns, lambda t: (t["from"] == "function_call") & t["value"].contains("<think>"))
    return F.when(F.coalesce(thinks, F.lit(False)), system).otherwise(F.trim(F.replace(text_or_empty(system), F.lit(instruction), F.lit(""))))


def tree_paths(edges: DataFrame, root: str, found: str | None = None, depth: int = 1000) -> DataFrame:
    """(node, path, level) of the nodes below a root that are found (a boolean column of their edge; all without one),
    by a recursive query over (parent, child). A tree of `depth` levels or more, or a cycle, is an error; no node is left out."""
    e = edges.select(F.col("parent").cast("string").alias("parent"), F.col("child").cast("string").alias("child"), (F.coalesce(F.col(found), F.lit(False)) if found else F.lit(True)).alias("found"))
    return edges.sparkSession.sql(
        f"""WITH RECURSIVE walk(node, path, level, found) MAX RECURSION LEVEL {int(depth)} AS (
 SELECT child, concat(:root, ' > ', child), 1, found FROM {{edges}} WHERE parent = :root
 UNION ALL SELECT e.child, concat(w.path, ' > ', e.child), w.level + 1, e.found FROM walk w JOIN {{edges}} e ON e.parent = w.node)
 SELECT node, path, level FROM walk WHERE found""",
        args={"root": root},
        edges=e,
    )


def merge_sections(thought: Column, action: Column, value: Column) -> Column:
    """Three fields folded into one text with section markers; absent ones left out."""
    part = lambda n, c: F.when(truthy(c).isNotNull(), F.concat(F.lit(f'"{n}" '), c))
    return F.concat_ws("\n", part("thought", thought), part("action", action), part("value", value))


def with_distractors(answer: Column, distractors: Column, key: Column, seed: int = 0) -> Column:
    """struct(options map, letter): the answer and three distractors in an order given by the md5 of seed, key and text."""
    texts = F.slice(F.concat(F.array(answer), F.filter(distractors, lambda d: d.isNotNull() & (d != answer))), 1, 4)
    placed = F.array_sort(F.transform(texts, lambda t: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), t)).alias("h"), t.alias("t"))))
    letters = F.array(*map(F.lit, "ABCD"))
    options = F.map_from_entries(F.transform(placed, lambda p, i: F.struct(F.get(letters, i).alias("k"), p["t"].alias("v"))))
    return F.struct(options.alias("options"), F.get(letters, F.array_position(F.transform(placed, lambda p: p["t"]), answer).cast("int") - 1).alias("letter"))


def unroll_pairs(df: DataFrame, keep: list[str], turns: Column) -> DataFrame:
    """Turns (0, 1), (2, 3), ... as rows (keep, pair, question, answer); an odd last turn is left out."""
    n = F.floor(F.size(turns) / 2).cast("int")
    rows = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("pair"), F.get(turns, i * 2)["value"].alias("question"), F.get(turns, i * 2 + 1)["value"].alias("answer"))))
    return df.select(*keep, F.inline(rows))


def image_token_first(turns: Column, tag: str = "<image>", wrap: tuple[str, str] | None = None) -> Column:
    """The tag moves to the front of its turn, optionally wrapped; turns without it are unchanged."""
    shown = f"{wrap[0]}{tag}{wrap[1]}" if wrap else tag
    return F.transform(turns, lambda t: F.struct(t["from"].alias("from"), F.when(t["value"].contains(tag), F.concat(F.lit(shown + "\n"), F.trim(F.replace(t["value"], F.lit(tag), F.lit(""))))).otherwise(t["value"]).alias("value")))


def yes_no_split(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows, and those whose label is exactly yes or no."""
    return df, df.where(F.lower(F.trim(label)).isin("yes", "no"))
