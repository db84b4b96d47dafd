"""Text cut off by field limits or mid-transfer.

First, lengths: each value's length is recomputed as it would have been counted by different stores (characters, UTF-8
bytes, UTF-16 units, with entities escaped, as JSON with and without non-ASCII escapes, with CRLF line ends). All values
are grouped by each, per table and source, before any ending is looked at: lengths that hold far more different texts
than their neighbours are exposed. The same spike shows under several encodings and beside the true one (its echoes), so
every value votes for the exposed length that stands out most among its own, and lengths that keep no excess of votes
are dropped: of each limit the one encoding remains that explains it.

Then, endings: the end of every value is inspected for what must still come (the rest of a word or sentence, a closing
bracket or marker, a required section). What a transfer leaves behind after a cut (dots, a replacement character,
blanks) is taken off before. An exposed length at which endings are cut in excess too is a hidden limit, any other a
habit of the source's texts. An ending that reads as finished stays finished at any length, since complete values may
happen to have a limit's length. An ending that alone decides nothing (a short capitalised phrase without a full stop)
is a cut at a hidden limit; elsewhere the corpus settles it: it is finished if values that open with the same two words
mostly go without a full stop and others end in its last word too, and it is a cut otherwise, or if its opening is the
beginning of a far more frequent one. An ending that reads as finished only because labels, list entries, dashed tails
and short phrases need no full stop is reviewed too: it is a cut if its last word never ends anything but goes on within
such endings or is the beginning of far more frequent words, or at a hidden limit that holds far more such endings than
its neighbours (as many as there come by chance are complete).

No rule depends on a text's length: what is counted is words, and every scan goes on until it has its answer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import attach, broadcast_if_small, cut_lineage
from .mixing import source_key

#: Abbreviations with a full stop after which a sentence goes on.
ABBREVIATIONS = frozenset("e.g i.e approx incl max min vs esp fig figs dr mr mrs prof st ca cf resp excl al z.b bzw ggf inkl usw.u d.h p.ex env n° núm aprox pág dra sra".split())
#: Section markers of a structured reply, in order; the last one is required.
SECTIONS = ('"thought', '"action', '"value')
_SECTION = re.compile(r'"(thought|action|value)\W{0,4}"')
_VALUE = re.compile(r'"value[^\w\s"]*"')
_LEFT = re.compile(r"(?:\.{3,}|…|�|\[\.\.\.\]|\[…\]|[\s​‌‍﻿\xa0])+$")
_LEFT_ENDS = ("...", "…", "�", "...]", "…]")
_STOP = re.compile(r"(?:<\|?/?(?:stop|end|eos|s|im_end|endoftext|eot)\|?>\s*)+$", re.I)
_IMAGE = re.compile(r"<image>\s*")
_END = re.compile(r"[.!?。！？؟۔]$")
_CLOSERS = "\"'”’»)]}*_`>」』）】"
_LABEL = r"(?:final |closing )?(?:answer|decision|verdict|diagnosis|conclusion|confidence|votes?|signed|score|result|option|choice|status|réponse|antwort|respuesta)"
_MARK = re.compile(rf"(?:^|(?<=[\s*_(—-]))(?:\[{_LABEL}\]|{_LABEL}\s*:)[*_ ]*", re.I)
_LIST = re.compile(r"^\s*(?:[-*•·]|\d{1,2}[.)]|\(?[A-Za-z][.)])\s+\S")
_MARKER = re.compile(r"^\s*(?:[-*•·]|\d{1,2}[.)]|\(?[A-Za-z][.)])\s+")
_DASHED = re.compile(r"[.!?”\"')\]]\s+[—–-]\s+(\S[^.!?]*)$")
_ABBREVIATED = re.compile(r"(\S+)\.$")
_SENTENCE = re.compile(r"(?:[.!?。！？][\"'”’»)\]*]*(?:\s+|(?<=[。！？]))|\n+)(?=\S)")
_SENTENCE_END = re.compile(r"[.!?؟۔][\"'”’»)\]*]*(?=\s+\S)|[。！？](?=[\"'”’»)\]*」』）】]*\s*[^\s\"'”’»)\]*」』）】])")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*")
DONE, CUT, OPEN, EMPTY = "done", "cut", "open", "empty"
_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "（": "）", "「": "」", "【": "】"}
#: Words that a label's answer, a dashed tail or a phrase may have without a full stop, and a line of its own after another.
PHRASE_WORDS, LINE_WORDS = 8, 5
#: Words of a lead-in before a colon that an opening leaves out.
LEAD_IN = re.compile(r"\s*(?:\S+\s+){0,3}\S+:\s+")
_CLOSE = {v: k for k, v in _PAIRS.items()}
_BRACKETS = re.compile("[" + re.escape("".join(_PAIRS) + "".join(_PAIRS.values())) + "]")


def sections(text: str) -> list[str]:
    return [m.group(1) for m in _SECTION.finditer(text)]


def value_of(text: str) -> str | None:
    """The value section of a structured reply, the text itself if it has no sections, None if the value section is absent."""
    if '"' in text and any(s in text for s in SECTIONS) and (text.lstrip().startswith(SECTIONS) or _SECTION.search(text)):
        at = text.rfind(SECTIONS[-1])
        while at >= 0:
            if m := _VALUE.match(text, at):
                return text[m.end() :]
            at = text.rfind(SECTIONS[-1], 0, at)
        return None
    return text


def strip_left(text: str) -> tuple[str, bool]:
    """The text without what a transfer left at its end, and whether that was more than blanks."""
    t, dots = text, False
    while True:
        u = _STOP.sub("", t) if t.endswith((">", "> ", ">\n")) else t
        m = _LEFT.search(u, max(0, len(u) - 64)) if u.endswith(_LEFT_ENDS) or u and (u[-1].isspace() or not u[-1].isprintable()) else None
        if m:
            dots = dots or bool(m.group().strip(" \t\r\n\xa0​‌‍﻿"))
            u = u[: m.start()]
        if u == t:
            return t, dots
        t = u


def _open_bracket(text: str) -> bool:
    """Whether a text opens a bracket or quotation it does not close."""
    stack: list[str] = []
    for c in _BRACKETS.findall(text):
        if c in _PAIRS:
            stack.append(c)
        elif c in _CLOSE and stack and stack[-1] == _CLOSE[c]:
            stack.pop()
    return bool(stack)


_TAGS = re.compile(r"<[^<>]*>")
_LABELS = re.compile(rf"\[{_LABEL}\]|\[final\]|{_LABEL}\s*:", re.I)


#: What leaves a value blank: tags, labels and all that is no letter or digit, but for dots of a cut.
_NOTHING = re.compile(rf"(?:<[^<>]*>|\[{_LABEL}\]|\[final\]|{_LABEL}\s*:|(?!\.\.\.)(?:[^\w�…]|_))*+", re.I)


def nothing_in(value: str) -> bool:
    """Whether a value is blank but for invisible characters, quotes, tags and answer markers without an answer."""
    return _NOTHING.match(value).end() == len(value)


def opening(text: str) -> str:
    """The first two words in lower case with digits as 9, or the one word and a mark. A lead-in of up to four words before a colon is left out."""
    m = LEAD_IN.match(text) if ":" in text else None
    w = [re.sub(r"\d+", "9", x.group().lower()) for x in islice(_WORD.finditer(text, m.end() if m else 0), 2)]
    return " ".join(w) if len(w) > 1 else f"{w[0]} |" if w else "|"


def _window(text: str, ready: Callable[[str], bool], step: int = 128) -> str:
    """The shortest tail of text, of step times a power of two, that satisfies ready; else the whole text."""
    while step < len(text):
        tail = text[-step:]
        if ready(tail):
            return tail
        step *= 4
    return text


def inspect(text: str | None) -> tuple[str, str, str, str]:
    """(state, last word, opening, part) of a whole value: done, cut, empty, or open where the ending alone decides nothing.

    part is the label's answer, list entry, dashed tail or short phrase that a done or open value without a full stop ends in.
    """
    if text is None:
        return EMPTY, "", "", ""
    v = value_of(text)
    if v is None:
        return CUT, "", "", ""
    v = _bare(v)
    if nothing_in(v):
        return EMPTY, "", "", ""
    t, left = strip_left(v)
    state, part = _state(t, left, t[t.rfind("\n") + 1 :]) if t else (CUT, "")
    if "�" in v[len(t) :]:
        state, part = CUT, ""
    return state, _last_word(t), opening(t), part


def _bare(value: str) -> str:
    return _IMAGE.sub("", value) if "<image>" in value else value


def _last_word(t: str) -> str:
    """The last word of the last line."""
    line, step = t[t.rfind("\n") + 1 :], 48
    while True:
        words = _WORD.findall(line[-step:])
        if len(words) > 1 or step >= len(line):  # a second word shows that the last one is whole
            return words[-1].lower() if words else ""
        step *= 4


def _last_break(t: str) -> int:
    """Where the last sentence or line of t begins, 0 if it has only one."""
    at = 0
    for m in _SENTENCE.finditer(t, len(t) - len(_window(t, lambda x: _SENTENCE.search(x) is not None, 256))):
        at = m.end()
    return at


def _state(t: str, left: bool, line: str) -> tuple[str, str]:
    mark = None
    if "]" in line or ":" in line:
        for mark in _MARK.finditer(line):
            pass  # the last one counts
    answer = line[mark.end() :].strip(" *_") if mark else ""
    if mark and not answer or t.count("**") % 2 or _open_bracket(t):
        return CUT, ""
    if t[0] in "[{" and not left:
        try:
            json.loads(t)
            return DONE, ""
        except (ValueError, RecursionError):
            pass
    bare = t.rstrip(_CLOSERS)
    if _END.search(bare):
        token = _ABBREVIATED.search(bare, len(bare) - len(_window(bare, lambda x: len(x.split()) > 1, 32)))
        return CUT if token and token.group(1).lstrip("(\"'“[") in ABBREVIATIONS and token.start() else DONE, ""
    if not left:
        if mark:
            return (DONE, answer) if len(answer.split()) <= PHRASE_WORDS else (CUT, "")
        if _LIST.match(line) and "\n" in t:
            return DONE, _MARKER.sub("", line)
        if (m := _DASHED.search(line)) and len(m.group(1).split()) <= PHRASE_WORDS:
            return DONE, m.group(1)
    fragment = t[_last_break(t) :].strip()
    n = len(_WORD.findall(fragment))
    han = sum("㐀" <= c <= "鿿" for c in fragment)
    whole = fragment == t.strip()
    if left or han > PHRASE_WORDS or n > PHRASE_WORDS or t[-1] in ",;:-–—/&+=<(" and n > 0 or not whole and n > 0 and not _phrase_after(t, fragment):
        return CUT, ""
    return DONE if not any(c.isupper() for c in fragment[:1]) or len(fragment) == 1 else OPEN, fragment


def _phrase_after(text: str, fragment: str) -> bool:
    """A last line of its own after a line break may be a label or an entry; a fragment after a sentence may not."""
    at = text.rstrip().rfind(fragment)
    return at > 0 and text[at - 1] == "\n" and len(fragment.split()) <= LINE_WORDS


#: The tab under which model answers are looked at with the values, which have no such tab.
ANSWERS = "model_answer"


def all_values(cases: DataFrame, examples: DataFrame) -> DataFrame:
    """values() and all model answers, whose tab is ANSWERS: the corpus of terminal contexts."""
    a = cases.where("model_answer is not null and case_id is not null").select(F.lit(ANSWERS).alias("tab"), F.col("case_id").alias("rec_id"), F.lit(-1).cast("bigint").alias("msg_no"), F.col("source_dataset").alias("source"), F.col("model_answer").alias("text"))
    return values(cases, examples).unionByName(a)


def values(cases: DataFrame, examples: DataFrame, role: str = "Moderator") -> DataFrame:
    """(tab, rec_id, msg_no, source, text): every message content and every text of the role; null texts and ids are left out."""
    a = cases.select(F.lit("demo_case").alias("tab"), F.col("case_id").alias("rec_id"), F.lit(-1).cast("bigint").alias("msg_no"), "source_dataset", F.element_at("example_reasoning", role).alias("text"))
    b = examples.select(F.lit("data_example").alias("tab"), F.col("example_id").alias("rec_id"), "source_dataset", F.posexplode("messages").alias("no", "m"))
    b = b.select("tab", "rec_id", F.col("no").cast("bigint").alias("msg_no"), "source_dataset", F.col("m.content").alias("text"))
    return a.unionByName(b).where("text is not null and rec_id is not null").withColumnRenamed("source_dataset", "source")


#: The lengths a store may have counted.
VARIANTS = ("chars", "utf8", "utf16", "entities", "json", "json_ascii", "crlf")


def lengths(t: str) -> tuple[int, ...]:
    """A value's length by each of VARIANTS."""
    n, lines = len(t), t.count("\n")
    if t.isascii():
        utf8, wide, other = n, 0, 0
    else:
        utf8 = len(t.encode("utf-8", "surrogatepass"))
        wide = sum(c > "\uffff" for c in t)
        other = sum(c > "\x7f" for c in t)
    quotes = t.count('"')
    json_ = n + quotes + t.count("\\") + t.count("\t") + t.count("\r") + lines
    return n, utf8, n + wide, n + 4 * t.count("&") + 3 * (t.count("<") + t.count(">")) + 5 * (quotes + t.count("'")), json_, json_ + 5 * other + 6 * wide, n + lines


def length_columns(c: Column) -> Column:
    """lengths() as a built-in expression."""

    def count(of: str) -> Column:
        return F.length(c) - F.length(F.translate(c, of, ""))

    n, lines = F.length(c), count("\n")
    utf8 = F.octet_length(c)
    wide = F.length(F.regexp_replace(c, "[^\\x{10000}-\\x{10FFFF}]", ""))
    other = F.length(F.regexp_replace(c, "[\\x00-\\x7F]", ""))
    json_ = n + count('"') + count("\\") + count("\t") + count("\r") + lines
    return F.array(n, utf8, n + wide, n + 4 * count("&") + 3 * count("<>") + 5 * count("\"'"), json_, json_ + 5 * other + 6 * wide, n + lines)


#: A length stands out if at least LEAST texts have it, RATIO times as many as the mean of the lengths within REACH, and
#: more than chance gives at one of many lengths (a Poisson deviance of CHANCE).
LEAST, RATIO, REACH, CHANCE = 5, 3.0, 8, 12.0


def _deviance(n: Column, usual: Column) -> Column:
    return n * F.log(n / usual) - n + usual


def _stands_out(n: Column, usual: Column) -> Column:
    return (n >= LEAST) & (n >= RATIO * usual) & (_deviance(n, usual) >= CHANCE)


def _usual(n: str, w: Window) -> Column:
    """The mean of n at the lengths within REACH of this one, without it, and 0.1 at least."""
    return F.greatest((F.sum(n).over(w) - F.col(n)) / (2 * REACH), F.lit(0.1))


def _variant(no: Column) -> Column:
    return F.get(F.array(*map(F.lit, VARIANTS)), no)


def _of_source(x: DataFrame, lengths: DataFrame, *cols: str) -> DataFrame:
    """x with __near: the array of rows of `lengths` (tab, source, no and cols; source '' is the whole table) of its table and source.

    One row per table and source is joined, so that no value's lengths are exploded.
    """
    item = F.collect_list(F.struct("source", "no", *cols))
    own = lengths.where("source != ''").groupBy("tab", F.col("source").alias("source_key")).agg(item.alias("__own"))
    all_ = lengths.where("source = ''").groupBy("tab").agg(item.alias("__all"))
    x = x.join(broadcast_if_small(own), ["tab", "source_key"], "left").join(broadcast_if_small(all_), "tab", "left")
    empty = F.array().cast(dict(own.dtypes)["__own"])
    return x.withColumn("__near", F.concat(F.coalesce("__own", empty), F.coalesce("__all", empty))).drop("__own", "__all")


def exposed_lengths(looked: DataFrame) -> DataFrame:
    """(tab, source, variant, length, values, usual): lengths that stand out among all values, echoes dropped.

    From lengths alone: of (tab, source_key, h, lengths) equal texts (h) of a source count once. Every variant is grouped by
    table and source, and by table alone (source ''). Each text votes for the one of its standing-out lengths with the largest
    deviance (the plainer variant of equal ones, the source before the table); lengths whose votes still stand out remain. The
    tables have one row per distinct length.
    """
    texts = cut_lineage(looked.select("tab", "source_key", "h", "lengths").distinct())
    n = texts.select("tab", F.coalesce("source_key", F.lit("")).alias("source"), F.posexplode("lengths").alias("no", "length")).groupBy("tab", "source", "no", "length").agg(F.count("*").alias("values"))
    n = cut_lineage(n)
    n = n.where("source != ''").unionByName(n.groupBy("tab", "no", "length").agg(F.sum("values").alias("values")).withColumn("source", F.lit("")))
    w = Window.partitionBy("tab", "source", "no").orderBy("length").rangeBetween(-REACH, REACH)
    n = n.withColumn("usual", _usual("values", w)).where(_stands_out(F.col("values"), F.col("usual")))
    n = n.withColumn("deviance", F.round(_deviance(F.col("values"), F.col("usual")), 6))
    hits = _of_source(texts, n, "length", "usual", "deviance").where(F.size("__near") > 0)
    rank = F.transform(F.filter("__near", lambda c: F.get("lengths", c["no"]) == c["length"]), lambda c: F.struct(c["deviance"].alias("d"), (c["source"] != "").alias("own"), (-c["no"]).alias("plain"), (-c["length"]).alias("short"), c["source"].alias("source"), c["usual"].alias("usual")))
    votes = hits.select("tab", F.array_max(rank).alias("v")).where("v is not null").groupBy("tab", "v.source", (-F.col("v.plain")).alias("no"), (-F.col("v.short")).alias("length"), "v.usual").agg(F.count("*").alias("values"))
    votes = votes.where(_stands_out(F.col("values"), F.col("usual")))
    return votes.select("tab", "source", _variant(F.col("no")).alias("variant"), F.col("length").cast("int").alias("length"), "values", F.round("usual", 4).alias("usual"))


def _numbered(lengths: DataFrame) -> DataFrame:
    return lengths.withColumn("no", F.array_position(F.array(*map(F.lit, VARIANTS)), F.col("variant")).cast("int") - 1)


def hidden_limits(looked: DataFrame, exposed: DataFrame | None = None) -> DataFrame:
    """(tab, source, variant, length, values, usual, cuts, cuts_around, review): exposed lengths at which cut endings stand out too.

    Of value_rows. review: endings that are done without a full stop stand out as well. Values that come again count once.
    """
    exposed = _numbered(cut_lineage(exposed_lengths(looked) if exposed is None else exposed))
    x = looked.where((F.col("state") == CUT) | F.col("loose")).select("tab", "rec_id", "msg_no", "source_key", "lengths", "state", "loose")
    x = _of_source(x, exposed, "length").withColumn("__near", F.filter("__near", lambda c: F.abs(F.get("lengths", c["no"]) - c["length"]) <= REACH)).where(F.size("__near") > 0)
    x = x.drop("source_key").dropDuplicates(["tab", "rec_id", "msg_no"]).select("tab", "lengths", "state", "loose", F.inline("__near"))
    at = F.get("lengths", F.col("no")) == F.col("length")
    cut, bare = F.col("state") == CUT, F.col("loose")
    x = x.groupBy("tab", "source", "no", "length").agg(F.count_if(at & cut).alias("cuts"), F.count_if(~at & cut).alias("c"), F.count_if(at & bare).alias("bare"), F.count_if(~at & bare).alias("b"))
    around = {c: F.greatest(F.col(c) / (2 * REACH), F.lit(0.1)) for c in ("c", "b")}
    x = x.where(_stands_out(F.col("cuts"), around["c"])).withColumn("cuts_around", F.round(around["c"], 4)).withColumn("review", _stands_out(F.col("bare"), around["b"]))
    return exposed.join(x.drop("c", "b", "bare"), ["tab", "source", "no", "length"]).drop("no").select("tab", "source", "variant", "length", "values", "usual", "cuts", "cuts_around", "review")


LOOKED = "kind string, tab string, rec_id bigint, msg_no bigint, source string, source_key string, h bigint, defect string, state string, last string, first string, loose boolean, lengths array<int>, a bigint, b bigint, c bigint, d bigint"


def looked_at(vals: DataFrame, judge: Callable[..., str] | None = None) -> DataFrame:
    """One pass over all texts. kind 'value': the state of each value with its last word, opening and lengths. Kinds
    'last' and 'first': terminal contexts, counted per batch: how often the word `last` ends a finished sentence (a) or a
    value without a full stop that is not cut outright (b), how often the latter is done by its ending (c, part of a), and how often the word goes on
    within such an ending (d); how many values have the opening `first` (a) and end in a full stop (b).

    judge: gives the defect of a response from (text, what inspect says of it, prompt, first); vals then has prompt, first
    and pair, and only rows with pair are judged.
    """

    def look(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            model = Contexts()
            seen, sizes = [], []
            for t in pdf["text"]:
                seen.append(r := inspect(t))
                sizes.append(lengths(t) if t else (0,) * len(VARIANTS))
                model.add(t, r)
            out = pdf[["tab", "rec_id", "msg_no", "source", "source_key", "h"]].assign(kind="value", lengths=pd.Series(sizes, index=pdf.index, dtype=object), loose=[r[0] == DONE and r[3] != "" for r in seen], a=0, b=0, c=0, d=0)
            out["defect"] = None if judge is None else [judge(t, r, p, f) if is_pair else None for t, r, p, f, is_pair in zip(pdf["text"], seen, pdf["prompt"], pdf["first"], pdf["pair"])]
            out["state"], out["last"], out["first"] = ([r[k] for r in seen] for k in range(3))
            yield out[_COLS]
            yield model.rows().assign(tab=None, rec_id=None, msg_no=None, source=None, source_key=None, h=None, defect=None, state=None, loose=None, lengths=None)[_COLS]

    asked = [] if judge is None else ["prompt", "first", "pair"]
    return vals.select("tab", "rec_id", "msg_no", "source", source_key(F.col("source")).alias("source_key"), F.xxhash64("text").alias("h"), "text", *asked).mapInPandas(look, LOOKED)


_COLS = [c.split()[0] for c in LOOKED.split(", ")]


def sentence_ends(value: str) -> tuple[list[str], bool]:
    """Last words of the sentences that another one follows, and whether the value ends in a full stop."""
    stop = bool(_END.search(strip_left(value)[0].rstrip(_CLOSERS)))
    if "." not in value[:-1] and "!" not in value and "?" not in value and value.isascii():
        return [], stop
    ends = []
    for m in _SENTENCE_END.finditer(value):
        at, step = m.start(), 40
        while len(before := value[max(0, at - step) : at].split()) < 2 and step < at:
            step *= 4  # the last word is whole once another part stands before it
        if before and (w := before[-1] if before[-1].isalpha() else (_WORD.findall(before[-1]) or [""])[-1]):
            ends.append(w.lower())
    return ends, stop


class Contexts:
    """Terminal contexts of a batch of texts."""

    def __init__(self) -> None:
        self.last: dict[str, list[int]] = {}
        self.first: dict[str, list[int]] = {}

    def add(self, text: str | None, seen: tuple[str, str, str, str]) -> None:
        state, word, opens, part = seen
        if state == EMPTY or not text:
            return
        ends, stop = sentence_ends(value_of(text) or "")
        if state == DONE and word:
            ends.append(word)
        for w in ends:
            self.last.setdefault(w, [0, 0, 0, 0])[0] += 1
        c = self.first.setdefault(opens, [0, 0])
        c[0] += 1
        c[1] += stop
        if not stop and state != CUT:
            self.last.setdefault(word, [0, 0, 0, 0])[1] += 1
        if part:
            if state == DONE and word:
                self.last.setdefault(word, [0, 0, 0, 0])[2] += 1
            for w in _WORD.findall(part)[:-1]:
                self.last.setdefault(w.lower(), [0, 0, 0, 0])[3] += 1

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame([("last", w, None, *n) for w, n in self.last.items()] + [("first", None, w, *n, 0, 0) for w, n in self.first.items()], columns=["kind", "last", "first", "a", "b", "c", "d"])


def ending_model(looked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(last, n_last, n_bare, n_loose, n_inner) and (first, n_first, stops) over all values."""
    x = looked.where("kind != 'value'")
    last = x.where("kind = 'last'").groupBy("last").agg(F.sum("a").alias("n_last"), F.sum("b").alias("n_bare"), F.sum("c").alias("n_loose"), F.sum("d").alias("n_inner"))
    return last, x.where("kind = 'first'").groupBy("first").agg(F.sum("a").alias("n_first"), F.sum("b").alias("stops"))


VALUE = ["tab", "rec_id", "msg_no", "source", "source_key", "h", "defect", "state", "last", "first", "loose", "lengths"]


def value_rows(looked: DataFrame) -> DataFrame:
    """Every value that is not empty; re-delivered ones still come again."""
    return looked.where(f"kind = 'value' and state != '{EMPTY}'").select(*VALUE)


def verdicts(vals: DataFrame, mark_all: bool = False) -> DataFrame:
    """settled_values of a pass over vals."""
    return settled_values(cut_lineage(looked_at(vals)), mark_all)


def settled_values(looked: DataFrame, mark_all: bool = False) -> DataFrame:
    """(tab, rec_id, msg_no, source, defect, state, last, first, evidence) of every value that is not empty, from looked_at.

    `open` endings, and done ones without a full stop, are settled here. evidence: ending, limit or context, whichever
    decided; with mark_all, 'ending at limit' for values of a limit's length that their ending decides. Values that come
    again under the same key come again here. A null source has no limits of its own.
    """
    x = value_rows(looked)
    limits = cut_lineage(hidden_limits(x))  # a few rows a source
    unsure = F.col("loose") | (F.col("state") == OPEN)
    x_ = cut_lineage(with_limits(x.where(unsure), limits).drop("lengths", "h", "source_key"))
    keep = ["tab", "rec_id", "msg_no", "source", "defect", "state", "last", "first"]
    sure = x.where(~unsure)
    if mark_all:
        sure = with_limits(sure, limits).withColumn("evidence", F.when(F.col("at_limit"), "ending at limit").otherwise("ending"))
    else:
        sure = sure.withColumn("evidence", F.lit("ending"))
    return sure.select(*keep, "evidence").unionByName(settle(x_.select(*keep, "loose", "at_limit", "review"), ending_model(looked)).select(*keep, "evidence"))


def with_limits(x: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds at_limit: whether one of a value's lengths is a hidden limit of its source or of its table, and review of such a limit."""
    x = _of_source(x, _numbered(limits), "length", "review")
    hits = F.filter("__near", lambda c: F.get("lengths", c["no"]) == c["length"])
    return x.withColumn("at_limit", F.size(hits) > 0).withColumn("review", F.exists(hits, lambda c: c["review"])).drop("__near")


def evidence(v: DataFrame) -> DataFrame:
    """(tab, evidence, values, cut) of verdicts with mark_all: what decided how many."""
    return v.dropDuplicates(["tab", "rec_id", "msg_no"]).groupBy("tab", "evidence").agg(F.count("*").alias("values"), F.count_if(F.col("state") == CUT).alias("cut"))


def settle(x: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """States of open endings and of loose ones, done without a full stop (last, first, loose, at_limit, review), by the terminal contexts of all values.

    Decided once for each combination of what decides; a frequent one is brought back to its values by broadcast.
    """
    keys = ["last", "first", "loose", "at_limit", "review"]
    combos = cut_lineage(x.groupBy(*keys).count())
    return attach(x.drop("state"), settled(combos, model), keys, combos)


def settled(combos: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(last, first, loose, at_limit, review, state, evidence)."""
    last, first = model
    # openings that mostly go without a full stop, by their beginnings: a rare opening that is the beginning of a frequent
    # one is a cut of it
    frequent = first.where((F.col("n_first") >= 20) & (F.col("stops") * 2 < F.col("n_first"))).select(F.regexp_replace("first", r" \|$", "").alias("w"), "n_first")
    cut_of = frequent.where("length(w) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.col("w").substr(F.lit(1), i))).alias("begin"), "n_first").groupBy("begin").agg(F.max("n_first").alias("n_longer"))
    y = combos.join(last, "last", "left").join(first, "first", "left").withColumn("begin", F.regexp_replace("first", r" \|$", "")).join(cut_of, "begin", "left")
    n = F.coalesce("n_first", F.lit(0))
    bare = n - F.coalesce("stops", F.lit(0))  # the value itself is one of them
    known = (F.coalesce("n_last", F.lit(0)) > 0) | (F.coalesce("n_bare", F.lit(0)) > 2) & (F.coalesce("n_bare", F.lit(0)) * 20 >= n)
    fits = (bare * 2 > n) & known & ~(F.coalesce("n_longer", F.lit(0)) >= 20 * n)
    # a loose ending's last word, by longer words of the corpus it is the beginning of; `ended` are uses that no loose ending proves
    y = y.join(longer_words(y.where("loose").select("last"), last), "last", "left")
    count = {c: F.coalesce(c, F.lit(0)) for c in ("n_loose", "n_inner", "n_word")}
    ended = F.coalesce("n_last", F.lit(0)) - count["n_loose"]
    uses = F.coalesce("n_bare", F.lit(0)) + 20 * ended
    lost = (count["n_inner"] >= 5 * uses) | (count["n_word"] >= 20 * uses) | F.col("at_limit") & (ended == 0) & (count["n_loose"] <= 2)
    lost = lost & (F.col("last") != "") & ~F.col("last").rlike("[0-9]") | F.col("review")
    state = F.when(F.col("loose"), F.when(lost, CUT).otherwise(DONE)).when(fits & ~F.col("at_limit"), DONE).otherwise(CUT)
    by_limit = F.col("at_limit") & (~F.col("loose") | F.col("review") | lost)
    return y.select("last", "first", "loose", "at_limit", "review", state.alias("state"), F.when(by_limit, "limit").otherwise("context").alias("evidence"))


def longer_words(words: DataFrame, last: DataFrame) -> DataFrame:
    """(last, n_word): the count of the most frequent word that begins with `last` and goes on. Digits are no words."""
    n = F.col("n_last") + F.col("n_bare") + F.col("n_inner")
    known = last.where((n >= 20) & (F.length("last") > 1) & ~F.col("last").rlike("[0-9]")).select(F.col("last").alias("w"), n.alias("n"))
    begin = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.col("w").substr(F.lit(1), i)))
    return known.select(begin.alias("last"), "n").groupBy("last").agg(F.max("n").alias("n_word")).join(words.distinct(), "last", "left_semi")


def cut_values(v: DataFrame) -> DataFrame:
    """(tab, rec_id, msg_no) of cut values, each once."""
    return v.where(f"state = '{CUT}'").select("tab", "rec_id", "msg_no").distinct()


def cut_rates(v: DataFrame, source: Column | None = None) -> DataFrame:
    """(tab, source, values, cut, rate) over all values that are not empty; a null source is ''."""
    s = F.coalesce(source if source is not None else F.col("source"), F.lit(""))
    return v.select("tab", "rec_id", "msg_no", "state", s.alias("source")).dropDuplicates(["tab", "rec_id", "msg_no"]).groupBy("tab", "source").agg(F.count("*").alias("values"), F.count_if(F.col("state") == CUT).alias("cut")).withColumn("rate", F.round(F.col("cut") / F.col("values"), 6))
