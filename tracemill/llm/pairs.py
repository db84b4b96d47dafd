"""Broken prompt and response pairs: empty, truncated, refused, copied from the prompt, or in another language.

Copies: the response is compressed once alone and once with its prompt as a zstandard dictionary; what the dictionary
saves says how much of the response is the prompt again. Candidates are confirmed word by word: the response holds
nearly all words of the question in order and little else but repetitions and a short lead-in. Languages are told by
function-word dictionaries, refusals by a dictionary of phrases in several languages, and truncation by the endings and
terminal contexts of the module cutoff.

A pair has one defect, by precedence: empty, refusal, copy, other_language, truncated. Of a response with sections the
value is judged; an absent value section means truncated, a blank one empty.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cutoff
from .overlap import lcs_at_least

#: Function words by language. Words of several languages count for each of them by their share.
FUNCTION_WORDS = {
    "en": "the a an of and or is are was were be been has have had with without in on at to from for by that this which who whose what how does do did not no yes it its there any as than while although after before during because between near than more less should would could about",
    "fr": "le la les un une des du de et ou est sont était étaient a ont avec sans dans sur à au aux pour par que qui ce cette ces quel quelle quels ne pas non oui il elle on se son sa ses plus moins après avant pendant depuis car entre près chez y montre mesure dont où ils elles été être jours semaines mois heures ans doit peut faut puis rien",
    "de": "der die das ein eine einer eines einem einen des dem den und oder ist sind war waren hat haben mit ohne in im an am auf zu zum zur von vom für bei dass dies diese dieser welche welcher nicht kein keine ja nein es er sie ich sich mehr weniger nach vor während seit denn weil zwischen als wird wurde werden auch aus über unter am wahrscheinlichsten tagen wochen monaten stunden jahre soll sollte muss kann erneut",
    "es": "el la los las un una unos unas de del y o es son era fue han ha con sin en sobre a al para por que quien este esta estos cuál qué no sí hay se su sus más menos después antes durante desde porque entre cerca lo le muestra mide como está ser dentro días semanas meses horas años conviene debe puede sin donde dónde cuál hacia desde",
    "pt": "o a os as um uma uns umas de do da dos das e ou é são era foi têm tem com sem em no na nos nas sobre ao à para por que quem este esta qual não sim há se seu sua mais menos depois antes durante desde pois entre perto mostra mede como está ser nem sinais dias semanas meses horas anos deve pode dentro onde",
}
_WORDS = re.compile(r"[^\W\d_]+")
_ELISION = re.compile(r"\b(?:[dlnscj]|qu)['’](?=[^\W\d_])", re.I)
_HAN = re.compile("[㐀-鿿]")
_BY_IDEOGRAPH = re.compile("[㐀-鿿]|[^㐀-鿿]+")
_LANGS = {}
for _l, _ws in FUNCTION_WORDS.items():
    for _w in set(_ws.split()):
        _LANGS.setdefault(_w, []).append(_l)

#: Phrases that decline to answer.
_REFUSALS = [
    r"\b(?:i|we)\s+(?:am\s+|are\s+)?(?:can ?not|can['’]?t|could not|won['’]?t|will not|must decline to|have to decline to|decline to|refuse to|unable to|not able to|not allowed to|not permitted to|may not)\s+(?:\w+\s+){0,2}?(?:help|assist|answer|comment|provide|give|discuss|respond|reply|comply|interpret|offer|share|advise|do that|make|fulfil|continue with)",
    r"\bi['’]m\s+(?:unable|not able|not allowed|not permitted)\s+to\b",
    r"\bi['’]m sorry,? (?:but )?(?:i )?(?:can|won|am|cannot)",
    r"\b(?:do not|don['’]?t) feel (?:comfortable|able|qualified)\b|\bprefer not to (?:answer|say|comment|discuss)\b",
    r"\bas an? (?:ai|artificial|large|language|assistant without)\b",
    r"\b(?:request|question|answer|query|prompt)\b[^.;]{0,30}\b(?:is|was|has been|been)?\s*(?:blocked|refused|denied|rejected)\b",
    r"\bfalls? outside what\b|\boutside (?:my|the|our) (?:scope|remit|competence)\b",
    r"\bagainst (?:the |our |my )?(?:\w+ )?polic(?:y|ies)\b|\b(?:not (?:permitted|allowed)|prohibited|forbidden)\b[^.]{0,30}\b(?:polic(?:y|ies)|guidelines|rules)\b",
    r"^\W*(?:declined|refused)\b\s*[:.—-]|\bno (?:answer|response|reply) (?:will|can|could|is|was|has|generated|given|may)\b",
    r"\b(?:answering|responding|that|this|it)\b[^.]{0,40}\bwould not be appropriate\b|\bnot something (?:the model|i|we) (?:is|am|are) (?:allowed|able|permitted)\b",
    r"\bje (?:dois|préfère) (?:décliner|ne pas répondre)|\b(?:pas en mesure|pas autorisée?|dans l['’]impossibilité) de (?:répondre|vous|fournir|commenter)",
    r"\b(?:muss|möchte) (?:die |diese |ihre )?(?:antwort|anfrage|frage)?\s*(?:leider )?ablehnen|\bnicht (?:in der lage|befugt|berechtigt)\b[^.]{0,60}\bzu (?:beantworten|antworten|helfen|geben)",
    r"\b(?:no estoy|não estou) (?:autorizad[oa]|en condiciones|em condições|capacitad[oa])\b|\b(?:debo|tengo que) (?:negarme|rechazar|declinar)|\b(?:tenho que|devo) recusar",
    r"(?:很?抱歉|对不起)[^。]*(?:无法|不能)",
    r"\bne (?:peux|puis|pouvons|saurais)\s+(?:pas\s+|malheureusement\s+)*(?:vous\s+|y\s+)?(?:répondre|aider|donner|fournir|commenter|interpréter)|\b(?:refuse|refusons) de répondre",
    r"\b(?:kann|darf|können|möchte|werde)\b[^.]{0,80}\bnicht\s+(?:beantworten|helfen|geben|kommentieren|antworten|beurteilen|weiterhelfen)",
    r"\bno (?:puedo|podemos|debo)\s+(?:responder|ayudar|dar|ofrecer|comentar|contestar|proporcionar|interpretar)",
    r"\bnão (?:posso|podemos|devo)\s+(?:responder|ajudar|dar|oferecer|comentar|fornecer|interpretar)",
    r"(?:无法|不能|不可以|不便|拒绝)(?:回答|提供|协助|帮助|讨论|评论)",
]
REFUSAL = re.compile("|".join(f"(?:{r})" for r in _REFUSALS), re.I)
#: Every phrase above has one of these; texts without any need no closer look.
_CUES = "sorry|can't|can’t|cannot|can not|could not|won't|won’t|will not|must decline|have to decline|decline|refuse|unable|not able|not allowed|not permitted|may not|as a ai|as an ai|as a art|as an art|as a la|as an la|as a assis|as an assis|blocked|denied|rejected|outside|polic|prohibited|forbidden|no answer|no response|no reply|appropriate|allowed|permitted|comfortable|qualified|feel able|prefer not|décliner|préfère|en mesure|autoris|impossibilité|ablehnen|in der lage|befugt|berechtigt|autoriza|condiciones|condições|capacita|negarme|rechazar|declinar|recusar|抱歉|对不起|peux|puis|pouvons|saurais|refus|kann|darf|können|möchte|werde|puedo|podemos|debo|posso|devo|无法|不能|不可以|不便|拒绝".split("|")
#: A lead-in before a copy may have so many words, and a share CHANGED of the response's words may be foreign besides.
LEAD_WORDS, CHANGED = 10, 0.1
#: Of the question's words a copy keeps 17 of 20; the prompt saves it this share of the prompt's own size at least.
AGREE, SAVED = (17, 20), 0.35


@lru_cache(50_000)
def language(text: str | None, least: float = 2.0) -> str | None:
    """en, fr, de, es, pt or zh by function words; None if too few of them, or if two languages are as likely."""
    if not text:
        return None
    low = text.lower()
    words = _WORDS.findall(low)
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for ls in filter(None, map(_LANGS.get, words)):
        for lang in ls:
            score[lang] += 1 if len(ls) == 1 else 0.6
    if not text.isascii():
        han = len(_HAN.findall(text))
        if han >= 4 and han * 2 > sum(map(len, words)) - han:
            return "zh"
        for c, lang in (("ß", "de"), ("ñ", "es"), ("¿", "es"), ("ã", "pt"), ("õ", "pt"), ("œ", "fr"), ("ê", "fr")):
            if c in low:
                score[lang] += 0.7
    if "’" in low or "'" in low:
        score["fr"] += 0.7 * len(_ELISION.findall(text))
    (best, a), (_, b) = sorted(score.items(), key=lambda x: -x[1])[:2]
    return best if a >= least and a > 1.25 * b else None


def is_refusal(text: str) -> bool:
    return next(_cues().iter(text.lower()), None) is not None and REFUSAL.search(text) is not None


@lru_cache(None)
def _cues() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for c in _CUES:
        a.add_word(c, 1)
    a.make_automaton()
    return a


def strip_markup(value: str) -> str:
    """The words of a value: without tags, stop marks, answer labels and what a transfer left behind."""
    v, _ = cutoff.strip_left(value)
    if "<" in v:
        v = cutoff._TAGS.sub(" ", v)
    if "]" in v or ":" in v:
        v = cutoff._LABELS.sub(" ", v)
    return v.strip()


def compressed(data: bytes, dictionary: bytes | None = None) -> int:
    """Compressed size beyond that of nothing. Dictionaries have eight bytes at least, so shorter ones are padded."""
    d = zstandard.ZstdCompressionDict(dictionary.rjust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return len(zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(data)) - FRAME


#: Bytes of a frame with one empty block.
FRAME = len(zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False).compress(b""))


def saved(response: str, prompt: str) -> float:
    """How much the prompt as a dictionary saves of the response's compressed size, relative to the prompt's own."""
    data, p = response.encode("utf-8", "replace"), prompt.encode("utf-8", "replace")
    return (compressed(data) - compressed(data, p)) / max(1, compressed(p))


def _starts(p: str) -> list[int]:
    """Where what may count as the question begins: the whole prompt, its last paragraph, what follows its last colon."""
    out = {0, p.rfind("\n") + 1}
    if (at := p.rfind(": ")) >= 0:
        out.add(at + 2)
    return sorted(out)


def _plain(prompt: str) -> str:
    return cutoff._bare(prompt).strip()


def questions(prompt: str) -> list[str]:
    """What may count as the question, the whole prompt first."""
    p = _plain(prompt)
    return [x for k in _starts(p) if (x := p[k:]).strip()]


def question_words(prompt: str) -> list[list[str]]:
    """Words of questions(prompt); each part of the prompt is taken apart once."""
    p = _plain(prompt)
    at = _starts(p)
    out: list[list[str]] = []
    tail: list[str] = []
    for a, z in zip(at[::-1], [len(p), *at[:0:-1]]):
        tail = words(p[a:z]) + tail
        out.append(tail)
    return out[::-1]


def words(text: str) -> list[str]:
    """Words in lower case; each ideograph is one."""
    out = cutoff._WORD.findall(text.lower())
    if not text.isascii() and _HAN.search(text):
        out = [x for w in out for x in _BY_IDEOGRAPH.findall(w)]
    return out


def is_copy(response: str, prompt: str) -> bool:
    """Whether the response is the question again: it holds AGREE of its words in order, the prompt as a dictionary
    saves enough of its compressed size, and words foreign to the question are a short lead-in and a few changed ones. A
    question of one word is no copy in an answer."""
    low, r = response.lower(), None
    for p in question_words(prompt):
        if len(p) < 2:
            continue
        need = -(-len(p) * AGREE[0] // AGREE[1])
        spare = len(p) - need
        for w in p:  # a word that is nowhere in the response is not in the common part
            if w not in low:
                spare -= 1
                if spare < 0:
                    break
        if spare < 0:
            continue
        if r is None:
            r = words(response)
            have = set(r)
        if len(r) < need or sum(w in have for w in p) < need:  # no common subsequence can be longer
            continue
        vocab = set(p)
        strange = sum(w not in vocab for w in r)
        if strange > min(LEAD_WORDS, 2 + len(p)) + CHANGED * len(r):
            continue
        if saved(" ".join(r), " ".join(p)) >= SAVED and lcs_at_least(p, r, need):
            return True
    return False


def pairs_and_values(cases: DataFrame, examples: DataFrame) -> DataFrame:
    """cutoff.all_values with the pairs among them: adds prompt, first and pair. Null texts are kept where they are responses."""
    blank = [F.lit(None).cast("string").alias("prompt"), F.lit(None).cast("string").alias("first"), F.lit(False).alias("pair")]
    moderator = cutoff.values(cases, examples.where("false")).select("*", *blank)
    x = examples.where("example_id is not null").select(F.lit("data_example").alias("tab"), F.col("example_id").alias("rec_id"), F.col("source_dataset").alias("source"), F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"].alias("first"), "messages", F.posexplode("messages").alias("no", "m"))
    pair = F.coalesce((F.col("m.role") == "assistant") & (F.col("no") > 0), F.lit(False))
    x = x.select("tab", "rec_id", F.col("no").cast("bigint").alias("msg_no"), "source", F.col("m.content").alias("text"), F.when(pair, F.get("messages", F.col("no") - 1)["content"]).alias("prompt"), F.when(pair, F.col("first")).alias("first"), pair.alias("pair"))
    a = cases.where("case_id is not null").select(F.lit(cutoff.ANSWERS).alias("tab"), F.col("case_id").alias("rec_id"), F.lit(-1).cast("bigint").alias("msg_no"), F.col("source_dataset").alias("source"), F.col("model_answer").alias("text"), F.col("question").alias("prompt"), F.col("question").alias("first"), F.lit(True).alias("pair"))
    return moderator.unionByName(x).unionByName(a).where("text is not null or pair")


def judge(response: str | None, prompt: str | None, first: str | None) -> str:
    """The defect of a response, or ''. Truncation by an open or loose ending is settled later."""
    return defect_of(response, cutoff.inspect(response), prompt, first)


def defect_of(response: str | None, seen: tuple[str, ...], prompt: str | None, first: str | None) -> str:
    """The same, given what cutoff.inspect says of the response."""
    if seen[0] == cutoff.EMPTY:
        return "empty"
    v = cutoff.value_of(response)
    if v is None:
        return "truncated"
    text = strip_markup(v)
    if is_refusal(text):
        return "refusal"
    if prompt and is_copy(text, prompt):
        return "copy"
    mine = language(text)
    if mine:
        asked = next((x for q in (*(questions(prompt)[::-1] if prompt else ()), first) if (x := language(q, 2.5))), None)
        if asked and asked != mine:
            return "other_language"
    return "truncated" if seen[0] == cutoff.CUT else ""


def defects(vals: DataFrame) -> DataFrame:
    """(tab, rec_id, msg_no, defect) of vals (pairs_and_values): defective pairs, each once.

    Every text is looked at once, for its defect and for the endings of the whole corpus, by which endings that a response
    alone does not decide are settled, so that a text is as cut here as by cutoff.verdicts.
    """
    looked = cutoff.cut_lineage(cutoff.looked_at(vals, defect_of))
    now = looked.where("kind = 'value' and defect != ''").select("tab", "rec_id", "msg_no", "defect")
    late = cutoff.settled_values(looked).where(f"defect = '' and state = '{cutoff.CUT}'").select("tab", "rec_id", "msg_no", F.lit("truncated").alias("defect"))
    return now.unionByName(late).distinct().withColumn("tab", F.when(F.col("tab") == cutoff.ANSWERS, "demo_case").otherwise(F.col("tab")))
