"""Text normalisers, extractors and rewriters as Column functions (survey X1-X12, X18-X23, X26-X30, X32-X46).

All of them stay inside code generation; null input counts as empty unless a docstring says otherwise. Regular
expressions use (?U) where word characters outside ASCII matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def truthy(c: Column) -> Column:
    """Null for blank text: coalesce over these takes the first that says anything."""
    return F.when(F.length(F.trim(c)) > 0, c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_text(c: Column) -> Column:
    """X1 of text in NFKC (functions.unicode.with_nfkc): trimmed, lower case, one blank."""
    return squeeze(F.lower(text_or_empty(c)))


def norm_yes_no(c: Column) -> Column:
    """Yes or no from words (yes, no, true, false in this order) or a single y or n; else ''."""
    s = norm_text(c)
    word = lambda w: s.rlike(rf"(?U)\b{w}\b")
    return F.when(word("yes"), "yes").when(word("no"), "no").when(word("true"), "yes").when(word("false"), "no").when(s == "y", "yes").when(s == "n", "no").otherwise("")


def title_yes_no(c: Column) -> Column:
    """Yes or No for exactly these words, other text as it is."""
    s = F.lower(F.trim(text_or_empty(c)))
    return F.when(s == "yes", "Yes").when(s == "no", "No").otherwise(c)


def strip_explanations(c: Column) -> Column:
    """Without parentheses, up to the first of . ; : and up to the first word is or are."""
    s = F.trim(F.regexp_replace(norm_text(c), r"\([^)]*\)", ""))
    s = F.trim(F.split(s, r"[.;:\n\r]|\\n", 2)[0])
    s = F.trim(F.split(s, r"(?U)\bis\b|\bare\b", 2)[0])
    return squeeze(s)


def simple_tokens(c: Column) -> Column:
    """Words of a-z, 0-9 and -, longer ones without a plural s."""
    s = F.trim(F.regexp_replace(F.regexp_replace(norm_text(c), r"[^a-z0-9\s\-]", " "), r"\s+", " "))
    singular = lambda t: F.when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, 1, 99_999_999).substr(F.lit(1), F.length(t) - 1)).otherwise(t)
    return F.filter(F.transform(F.split(s, " "), singular), lambda t: t != "")


def token_subset(pred: Column, gold: Column, share: float = 0.6) -> Column:
    """At least `share` of the prediction's distinct tokens occur in the gold."""
    p, g = F.array_distinct(simple_tokens(pred)), simple_tokens(gold)
    common = F.size(F.array_intersect(p, g))
    return (common > 0) & (common / F.greatest(F.size(p), F.lit(1)) >= share)


def drop_punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, "")


def basic_norm(c: Column, ampersand: str = "and", slash: str | None = None) -> Column:
    """X7 of text in NFKC: lower case, & and / as words, ASCII punctuation deleted, one blank."""
    s = F.replace(F.lower(F.trim(text_or_empty(c))), F.lit("&"), F.lit(ampersand))
    if slash is not None:
        s = F.replace(s, F.lit("/"), F.lit(slash))
    return squeeze(drop_punctuation(s))


def replace_all(c: Column, table: dict[str, str]) -> Column:
    """Plain substring replacement in the table's order."""
    for k, v in table.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Whole-string lookup, the string itself where the table has none."""
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(m, c), c)


#: Terms and their canonical form, applied in this order as substrings.
FINDING_TERMS = {
    "picc line": "picc",
    "peripherally inserted central catheter": "picc",
    "endotracheal tube": "ett",
    "enteric tube": "ng tube",
    "nasogastric tube": "ng tube",
    "orogastric tube": "og tube",
    "cardiac pacemaker": "pacemaker",
    "cardiac pacer": "pacemaker",
    "pacer": "pacemaker",
    "wires": "wire",
    "leads": "wire",
    "elevation": "elevated",
    "opacities": "opacity",
    "effusions": "effusion",
    "abnormalities": "abnormality",
    "structures": "structure",
}
#: Phrases that say nothing about a finding.
FLUFF = ["present", "seen", "visible", "identified", "noted", "evidence of", "demonstrated", "observed", "cannot determine", "suspicious for", "consistent with", "suggestive of", "findings of"]
#: Words and phrases of a negative report.
NEGATIVE_WORDS, NEGATIVE_LETTERS = ["no", "none", "normal", "negative"], ["none", "non", "nothing", "normal"]
NEGATIVE_PHRASES = ["no acute", "no active", "no significant", "lungs are clear", "heart is normal"]


def finding_norm(c: Column, fluff: bool = False) -> Column:
    """Separators to blanks, canonical terms, letters and digits only; `fluff` drops the empty phrases too."""
    s = F.translate(F.trim(F.lower(text_or_empty(c))), "_-/", "   ")
    s = F.trim(F.regexp_replace(F.regexp_replace(replace_all(s, FINDING_TERMS), r"[^a-z0-9\s]", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(replace_all(s, dict.fromkeys(FLUFF, " ")), r"\s+", " ")) if fluff else s


def finding_terms(c: Column) -> Column:
    """Distinct terms between , ; . and the words and, or."""
    return terms_of(finding_norm(c, fluff=True))


def terms_of(s: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(s, r"\s*(?:,|;|\band\b|\bor\b|\.|\n)\s*"), lambda s: F.trim(s)), lambda x: x != ""))


def is_negative_finding(c: Column) -> Column:
    s = F.lower(text_or_empty(c))
    out = F.trim(s).isin(NEGATIVE_WORDS) | F.regexp_replace(s, "[^a-z]", "").isin(NEGATIVE_LETTERS)
    for p in NEGATIVE_PHRASES:
        out = out | s.contains(p)
    return out


def soft_match(gold: Column, pred: Column) -> Column:
    """Gold within pred, gold's words within pred's, two long shared words, or half of gold's words shared and long."""
    g, p = F.array_distinct(F.split(F.trim(gold), r"\s+")), F.array_distinct(F.split(F.trim(pred), r"\s+"))
    both = F.array_intersect(g, p)
    long_ = F.size(F.filter(both, lambda w: (F.length(w) > 2) & ~w.isin("and", "with", "the")))
    hit = pred.contains(gold) | (F.size(both) == F.size(g)) | (long_ >= 2) | (long_ / F.size(g) >= 0.5)
    return (F.length(F.trim(gold)) > 0) & (F.length(F.trim(pred)) > 0) & hit


#: Markers before a final answer, in the order they are tried.
ANSWER_MARKERS = [r"\[FINAL\]\s*(.+?)\s*$", r"\*\*Final Answer:?\*\*\s*(.+?)\s*$", r"Final Answer:\s*(.+?)\s*$", r"\[DECISION\]\s*(.+?)\s*$"]


def final_answer(c: Column) -> Column:
    """X11: text after the first 'Final Answer:', then after the first marker up to the first line end, else without one last full stop."""
    t = F.trim(text_or_empty(c))
    t = F.when(t.contains("Final Answer:"), F.trim(F.regexp_extract(t, r"(?s)Final Answer:(.*)$", 1))).otherwise(t)
    tries = [truthy(F.trim(F.regexp_extract(t, f"(?ims){p}", 1))) for p in ANSWER_MARKERS]
    return F.coalesce(*tries, F.when(t.endswith("."), F.regexp_replace(t, r"\.$", "")).otherwise(t))


def answer_after_think(c: Column) -> Column:
    """X11: what follows the last </think>, else the text."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"(?s)^.*</think>", ""))


def first_answer(final: Column, raw: Column) -> Column:
    """X11: the first usable of a given final answer (not 'unknown') and the marked answer of the raw text; else ''."""
    f = F.when(F.lower(F.trim(final)) != "unknown", truthy(F.trim(final)))
    return F.coalesce(f, truthy(F.trim(F.regexp_extract(text_or_empty(raw), r"(?im)\[FINAL\]\s*(.+?)\s*$", 1))), F.lit(""))


def think_block(c: Column) -> Column:
    """Content of the first think block, '' if none."""
    return F.trim(F.regexp_extract(text_or_empty(c), r"(?s)<think>(.*?)</think>", 1))


def strip_think(c: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), r"(?s)<think>.*?</think>\s*", ""))


def tag_think(c: Column, tag: Column) -> Column:
    """Puts a tag at the start of the first think block; text without one is unchanged."""
    at = F.locate("<think>", c)
    return F.when(at > 0, F.concat(F.substring_index(c, "<think>", 1), F.lit("<think>"), tag, c.substr(at + 7, F.length(c)))).otherwise(c)


#: Path shapes that may identify a person.
PERSON_PATH, MOUNT_PATH = r"(?i)p\d+/p\d+/s\d+/[a-z0-9-]+\.(?:jpg|png|jpeg|dcm)", r"/mnt/[^\s'\"{},]+"


def simulated_path(key: Column, extension: str = ".jpg") -> Column:
    """One of five path shapes, a function of the key's md5 instead of chance (equal keys give equal paths)."""
    h = F.md5(text_or_empty(key))
    num = lambda a, n, lo, size: (F.conv(F.substring(h, a, n), 16, 10).cast("bigint") % size + lo).cast("string")
    shapes = [
        F.concat(F.substring(h, 1, 8), F.lit(extension)),
        F.concat(F.lit("/mnt/data/"), F.substring(h, 1, 6), F.lit("/"), F.substring(h, 7, 8), F.lit(extension)),
        F.concat(F.lit("p"), num(1, 4, 10, 10), F.lit("/p"), num(5, 7, 10_000_000, 10_000_000), F.lit("/s"), num(12, 7, 50_000_000, 10_000_000), F.lit("/"), F.substring(h, 19, 14), F.lit(extension)),
        F.concat(F.lit("uploads/user_"), num(1, 6, 1, 999), F.lit("/chest_xray"), F.lit(extension)),
        F.concat(F.lit("data_v2/batch_"), num(1, 6, 0, 101), F.lit("/img-"), num(7, 6, 0, 1001), F.lit(extension)),
    ]
    return F.get(F.array(*shapes), (F.conv(F.substring(h, 32, 1), 16, 10).cast("int") % 5))


def anonymise_paths(c: Column, path: Column) -> Column:
    """Both path shapes replaced by the given path, which is taken literally."""
    mark = "\x00"
    s = F.regexp_replace(F.regexp_replace(c, PERSON_PATH, mark), MOUNT_PATH, mark)
    return F.replace(s, F.lit(mark), path)


def format_thought(c: Column) -> Column:
    """Five shapes of reasoning before an answer to '<think>reasoning</think>\\nanswer'; other text as it is.

    A leading line 'thought' or 'Thought:' without an answer marker takes the last line as the answer.
    """
    t = text_or_empty(c)
    strip = lambda c: F.trim(c, F.lit(" \t\r\n"))
    wrap = lambda a, b: F.concat(F.lit("<think>"), strip(a), F.lit("</think>\n"), strip(b))
    both = lambda s, p: wrap(F.regexp_extract(s, p, 1), F.regexp_extract(s, p, 2))
    stray = strip(F.regexp_extract(t, r"(?s)^[Tt]hought\s*\n(.+)", 1))
    last_line = r"(?s)^(.*)\n([^\n]*)$"
    split_last = lambda s, empty: F.when(s.rlike(last_line), both(s, last_line)).otherwise(empty)
    marked = r"(?is)Thought:\s*(.+?)(?:Final\s+)?Answer:\s*(.+)"
    plain = strip(F.regexp_extract(t, r"(?s)^Thought:\s*(.+)", 1))
    bare = F.regexp_replace(t, r"\*{2,}", "")
    analysis = r"(?is)Key\s*Knowledge:?\s*(.+?)Total\s*Analysis:?\s*(.+)"
    return (
        F.when(t.contains("<think>"), t)
        .when(t.rlike(r"(?s)^[Tt]hought\s*\n.+"), split_last(stray, F.concat(F.lit("<think>"), stray, F.lit("</think>\n"))))
        .when(t.rlike(marked), both(t, marked))
        .when(t.rlike(r"(?s)^Thought:\s*.+\n"), split_last(plain, t))
        .when(bare.rlike(analysis), both(bare, analysis))
        .otherwise(t)
    )


def difficulty_of(c: Column) -> Column:
    """The first level named (basic, intermediate, advanced), else ''."""
    return F.lower(F.regexp_extract(text_or_empty(c), r"(?i)\b(basic|intermediate|advanced)\b", 1))


def concise_answer(c: Column, options: Column | None = None) -> Column:
    """Answers of up to ten words as they are; else the last '(X)' with its option's text, or with what follows it where
    the options (map letter -> text) have no such letter; else yes, no or maybe; else the text."""
    t = F.trim(text_or_empty(c))
    letters = F.regexp_extract_all(t, F.lit(r"(\([A-J]\)[^\n()]{0,80})"), 1)
    last = F.element_at(letters, -1)
    said = F.trim(last)
    if options is not None:
        letter = F.substring(last, 2, 1)
        text = F.element_at(options, letter)
        said = F.when(truthy(text).isNotNull(), F.concat(F.lit("("), letter, F.lit(") "), text)).otherwise(said)
    word = F.lower(F.regexp_extract(t, r"(?i)\b(yes|no|maybe)\b", 1))
    return F.when(F.size(F.split(t, r"\s+")) <= 10, t).when(F.size(letters) > 0, said).when(word != "", word).otherwise(t)


def answer_of(c: Column) -> Column:
    """The first line after the first </think> that says anything, else after the first 'Answer:', else the whole text."""
    t = text_or_empty(c)

    def line(pattern: str) -> Column:
        rest = F.regexp_replace(F.regexp_extract(t, pattern, 1), r"^\s+|\s+$", "")
        return F.trim(F.substring_index(rest, "\n", 1))

    return F.coalesce(truthy(line(r"(?s)</think>\s*(.+)")), F.when(t.rlike(r"(?is)\bAnswer:\s*.+"), line(r"(?is)\bAnswer:\s*(.+)")), t)


def best_option(answer: Column, options: Column) -> Column:
    """The letter of the option (map letter -> text) an answer means: an option contained in it scores twice its
    length (four times in its last 200 characters), one with 60 % of its words in it that share; best above 5 or null. Ties: first letter."""
    a = norm_text(answer)
    tail = F.substring(a, -200, 200)
    scored = F.transform(
        F.map_entries(options),
        lambda e: F.struct(
            F.when(tail.contains(norm_text(e["value"])), 4 * F.length(e["value"]))
            .when(a.contains(norm_text(e["value"])), 2 * F.length(e["value"]))
            .otherwise(F.when(F.size(F.array_intersect(simple_tokens(e["value"]), simple_tokens(a))) >= 0.6 * F.size(F.array_distinct(simple_tokens(e["value"]))), F.length(e["value"])).otherwise(0))
            .alias("s"),
            e["key"].alias("k"),
        ),
    )
    best = F.array_sort(scored, lambda x, y: F.when(x["s"] > y["s"], -1).when(x["s"] < y["s"], 1).when(x["k"] < y["k"], -1).otherwise(1))
    return F.when(F.get(best, F.lit(0))["s"] > 5, F.get(best, F.lit(0))["k"])


def cut_at(c: Column, marker: str) -> Column:
    """Text before the first marker."""
    return F.trim(F.substring_index(text_or_empty(c), marker, 1))


def tagged_section(c: Column, tag: str, least: int = 20) -> Column:
    """Text within [TAG]...[/TAG]; else from the tag to the next tag if longer than `least`; else ''."""
    t = text_or_empty(c)
    closed = F.trim(F.regexp_extract(t, rf"(?is)\[{tag}\](.*?)\[/{tag}\]", 1))
    open_ = F.trim(F.regexp_extract(t, rf"(?is)\[{tag}\](.*?)(?=\[/?[A-Z_ ]+\]|$)", 1))
    return F.coalesce(truthy(closed), F.when(F.length(open_) > least, open_), F.lit(""))


def hierarchy_edges(c: Column) -> Column:
    """X27: 'a > b > c' lists to structs (parent, child), blanks trimmed."""
    names = F.filter(F.transform(F.split(text_or_empty(c), ">"), lambda s: F.trim(s)), lambda x: x != "")
    n = F.size(names)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.get(names, i - 1).alias("parent"), F.get(names, i).alias("child")))).otherwise(F.array().cast("array<struct<parent:string,child:string>>"))


def list_items(c: Column) -> Column:
    """Items of '[a, b]' or of text split at , ; or line ends, without quotes, blanks dropped."""
    s = F.regexp_replace(F.trim(text_or_empty(c)), r"^\[|\]$", "")
    return F.filter(F.transform(F.split(s, r"[,;\n]"), lambda x: F.trim(F.regexp_replace(x, r"^[\s'\"]+|[\s'\"]+$", ""))), lambda x: x != "")


def points(c: Column, width: Column, height: Column) -> Column:
    """x="…" y="…" percentages to pixels; pairs with a part over 100 are left out."""
    xs = F.regexp_extract_all(text_or_empty(c), F.lit(r'x\d*="\s*([0-9]+(?:\.[0-9]+)?)"\s+y\d*="\s*[0-9]+(?:\.[0-9]+)?"'), 1)
    ys = F.regexp_extract_all(text_or_empty(c), F.lit(r'x\d*="\s*[0-9]+(?:\.[0-9]+)?"\s+y\d*="\s*([0-9]+(?:\.[0-9]+)?)"'), 1)
    both = F.filter(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda p: (p["x"].cast("double") <= 100) & (p["y"].cast("double") <= 100))
    return F.transform(both, lambda p: F.struct((p["x"].cast("double") / 100 * width).alias("x"), (p["y"].cast("double") / 100 * height).alias("y")))


def to_grid(v: Column, size: Column) -> Column:
    """Pixel to the 0-999 grid."""
    return F.least(F.lit(999), F.floor(v / size * 1000)).cast("int")


def from_grid(v: Column, size: Column) -> Column:
    return v / 1000 * size


def pad_box(box: Column, width: Column, height: Column, share: float = 0.1) -> Column:
    """A box [x1, y1, x2, y2] grown by a share of its sides on each side, within the image."""
    w, h = box[2] - box[0], box[3] - box[1]
    return F.array(F.greatest(F.lit(0.0), box[0] - share * w), F.greatest(F.lit(0.0), box[1] - share * h), F.least(width.cast("double"), box[2] + share * w), F.least(height.cast("double"), box[3] + share * h))


#: Number words and articles of the normaliser for short visual answers.
NUMBER_WORDS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ["a", "an", "the"]


def short_answer_norm(c: Column) -> Column:
    """Lower case, punctuation dropped (not between digits), number words to digits, articles dropped."""
    s = F.lower(F.translate(F.trim(text_or_empty(c)), "\n\t", "  "))
    s = F.regexp_replace(s, r"(?<!\d)[.,](?!\d)|[;/\[\]\"{}()=+\\_\-<>@`?!:]", " ")
    words = F.filter(F.split(F.trim(s), r"\s+"), lambda w: (w != "") & ~w.isin(ARTICLES))
    return F.array_join(F.transform(words, lambda w: lookup(w, NUMBER_WORDS)), " ")


def truncate_sentence(c: Column, limit: int = 400) -> Column:
    """Longer text is cut at the limit, back to the last full stop if that lies past half, and marked ' ...'."""
    head = F.substring(c, 1, limit)
    dot = F.length(head) - F.locate(".", F.reverse(head)) + 1
    has = head.contains(".") & (dot > limit / 2)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.when(has, head.substr(F.lit(1), dot)).otherwise(head), F.lit(" ...")))


def demographics(age: Column, gender: Column) -> Column:
    """X36: '63-year-old male'; an unknown part is left out."""
    g = F.when(F.upper(gender) == "M", "male").when(F.upper(gender) == "F", "female")
    return F.concat_ws(" ", F.when(age.isNotNull(), F.concat(age.cast("string"), F.lit("-year-old"))), g)


def options_text(options: Column) -> Column:
    """X39: '(A) text' lines of a map, by letter."""
    e = F.array_sort(F.map_entries(options), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    return F.array_join(F.transform(e, lambda x: F.concat(F.lit("("), x["key"], F.lit(") "), text_or_empty(x["value"]))), "\n")


def resolve_image(ref: Column, images: Column) -> Column:
    """img_original, img_last or img_round_N to an image; an unknown round falls back to the last image, then the first."""
    n = F.regexp_extract(text_or_empty(ref), r"^img_round_(\d+)$", 1)
    last = F.get(images, F.size(images) - 1)
    pick = F.when(ref == "img_original", F.get(images, F.lit(0))).when(n != "", F.get(images, n.try_cast("int"))).otherwise(last)
    return F.coalesce(pick, last, F.get(images, F.lit(0)))


def core_parameter(args: Column) -> Column:
    """The first usable of param, ans, answer and text of a map."""
    return F.coalesce(*(truthy(F.element_at(args, k)) for k in ("param", "ans", "answer", "text")))


def fill_placeholders(c: Column, values: Column, mark: str = "<box>") -> Column:
    """The n-th mark replaced by the n-th value; marks without a value become ''."""
    parts = F.split(text_or_empty(c), mark.replace("[", r"\[").replace("]", r"\]"))
    return F.concat(F.get(parts, F.lit(0)), F.when(F.size(parts) > 1, F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda p, i: F.concat(F.coalesce(F.get(values, i), F.lit("")), p)), "")).otherwise(""))


def last_call(c: Column) -> Column:
    """Struct (name, args) of the last name(args) in the text; null if none."""
    names = F.regexp_extract_all(text_or_empty(c), F.lit(r"(\w+)\(([^()]*)\)"), 1)
    args = F.regexp_extract_all(text_or_empty(c), F.lit(r"(\w+)\(([^()]*)\)"), 2)
    return F.when(F.size(names) > 0, F.struct(F.element_at(names, -1).alias("name"), F.element_at(args, -1).alias("args")))


def drop_tags(c: Column) -> Column:
    """Special tags <|…|>, <image> and [INST] marks dropped, blanks collapsed."""
    return squeeze(F.regexp_replace(text_or_empty(c), r"<\|[^|]*\|>|<image>|\[/?INST\]", " "))


def key_values(c: Column) -> Column:
    """X46: 'k=v,k=v' to a map; parts without = map to null."""
    return F.str_to_map(text_or_empty(c), F.lit(","), F.lit("="))


def next_prompt(observation: Column, mode: Column, original: Column) -> Column:
    """The next round's prompt: the observation's text by mode, the original prompt where the tool gave nothing."""
    seen = truthy(F.trim(text_or_empty(observation)))
    shown = F.when(mode == "observation", F.concat(F.lit("OBSERVATION:\n"), seen)).when(mode == "image", F.concat(F.lit("<image>\n"), seen)).otherwise(seen)
    return F.when(seen.isNull(), text_or_empty(original)).otherwise(F.concat(shown, F.lit("\n\n"), text_or_empty(original)))
