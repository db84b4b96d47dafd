"""Garbled text from wrong character encodings, treated as substitution ciphers.

A text decoded with the wrong code page replaces letters outside ASCII by others: UTF-8 and double-byte text turns each
letter into a unit of two or more characters, text of a single-byte page each letter into one other character. Which unit
stands for which letter is a substitution cipher whose key is unknown and may differ between and within sources.

One pass over the texts cuts each into plain characters, units and single characters outside ASCII, and counts:

1. Bigrams of plain characters of the whole corpus, folded to an alphabet of fixed size, and units with both neighbours per
   source. Both are counted per batch before the shuffle; only alphabet-sized tables result.
2. What each text has: its units, and its single characters in order with their neighbours.

Expectation-maximization then learns the key of each source from its table of units, in one task per source whose size the
alphabet bounds, not the rows. A unit's hypotheses are that it is genuine text; every letter that some single- or
double-byte encoding makes of it (all encodings the interpreter knows, by rule); and, for units inside words, every letter
of the corpus, page or no page, at a price. The E step weighs them by the bigrams with the unit's neighbours, their weight
so far and their page's weight in the source; the M step re-estimates both weights. The most probable letter is the key.

Single characters may be genuine in one text and swapped in the next, so no key per source can tell. A text's characters
are scored in order under every pair of single-byte pages by how much likelier their neighbours make the swapped letters;
the stretch with the largest sum is the text's evidence, the share of texts that a pair explains in the source is its
weight (re-estimated once), and a text is swapped if evidence and weight together favour it.

Units are mapped by translate(); texts in which a key changes something are the affected ones. A replacement character
marks an affected text whose original is lost.
"""

from __future__ import annotations

import encodings.aliases
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach, broadcast_if_small, cut_lineage


#: Pages that are tried first where several make a unit; the others count only for letters of common alphabets.
COMMON = ("cp1252", "latin_1", "cp1250", "cp1251", "cp1254", "cp1257", "iso8859_2", "iso8859_15", "koi8_r", "cp437", "cp850", "cp866", "mac_roman")


def _ascii_pages() -> tuple[str, ...]:
    """Every single-byte code page the interpreter knows that has ASCII in its lower half, one of each table, the commonest first."""
    seen, out = set(), []
    for name in (*COMMON, *sorted(set(encodings.aliases.aliases.values()))):
        try:
            if len(bytes((0x8E, 0xA1)).decode(name, "replace")) < 2 or len(bytes((0xE0, 0x61)).decode(name, "replace")) < 2:
                continue  # a byte of several
            high = tuple(bytes((b,)).decode(name, "replace") for b in range(128, 256))
            if bytes(range(32, 127)).decode(name) != "".join(map(chr, range(32, 127))) or any(len(c) != 1 for c in high) or sum(c == "\ufffd" for c in high) > 64:
                continue
        except (LookupError, UnicodeError, ValueError):
            continue
        if high not in seen:
            seen.add(high)
            out.append(name)
    return tuple(out)


#: Code pages a text may have been decoded with.
PAGES = _ascii_pages()
#: Double-byte encodings whose bytes may have been read with one of WESTERN.
DOUBLE, WESTERN = ("gb18030", "big5", "shift_jis", "euc_jp", "cp949"), ("cp1252", "latin_1")
#: Single-byte pages that texts are written in, to which a swapped byte may really belong.
TRUE_PAGES = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "koi8_r", "cp437", "cp850", "mac_roman")
LOST = "�"
#: Marks the units of a double-byte run, whose readings are those of pairs only.
DOUBLED = "\x01"
SEP = "\x00"
#: Probability of a letter that no plain text has, and of one that is in no common alphabet, for every two characters it would stand for.
FLOOR, EXOTIC = 1e-7, 1e-20
#: Price of a letter without a page in log probability, and the evidence per occurrence and the different neighbours it takes.
FREE_PRICE, FREE_GAIN, FREE_CONTEXTS = 9.0, 1.5, 4
#: Evidence in log probability that a stretch of swapped single characters takes beyond its pair's weight in the source.
SWAP_EVIDENCE = 12.0
#: What a character that a pair of pages cannot have made counts against it.
IMPOSSIBLE = -20.0


@lru_cache(None)
def to_byte(page: str) -> dict[str, int]:
    """Characters to bytes of a code page; bytes it leaves undefined stand for the control character of that number."""
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def _letter(data: bytes, codec: str = "utf-8") -> str | None:
    try:
        s = data.decode(codec)
    except UnicodeDecodeError:
        return None
    return s if len(s) == 1 else None


def _length(lead: int) -> int:
    return 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0


@lru_cache(200_000)
def once(unit: str) -> tuple[tuple[str, str], ...]:
    """(page, letter) for each page that makes this unit of one letter's UTF-8 bytes."""
    out = []
    for p in PAGES:
        table = to_byte(p)
        if all(c in table for c in unit) and (x := _letter(bytes(table[c] for c in unit))) and ord(x) >= 0x80 and (p in COMMON or _ordinary(x)):
            out.append((p, x))
    return tuple(out)


@lru_cache(100_000)
def _first(text: str) -> int:
    """Length of the longest single-letter unit at the start of text that a common page makes, else any page; 0 if none."""
    best = 0
    for k, p in enumerate(PAGES):
        if k == len(COMMON) and best:
            break
        table = to_byte(p)
        b = table.get(text[0])
        n = _length(b) if b is not None else 0
        if n > best and len(text) >= n and all(0x80 <= table.get(c, 0) <= 0xBF for c in text[1:n]) and (x := _letter(bytes(table[c] for c in text[:n]))) and (k < len(COMMON) or _ordinary(x)):
            best = n
    return best


@lru_cache(100_000)
def _twice(window: str) -> int:
    """Length of a unit at the start of window that is a unit of units, 0 if none: the second letters must form a unit again."""
    chars: list[int] = []
    at = 0
    while at < len(window) and len(chars) < 4:
        n = _first(window[at : at + 4])
        if not n:
            break
        chars.append(n)
        at += n
    for k in range(len(chars), 1, -1):
        if hypotheses_twice(window[: sum(chars[:k])], tuple(chars[:k])):
            return sum(chars[:k])
    return 0


@lru_cache(100_000)
def hypotheses_twice(unit: str, cuts: tuple[int, ...]) -> tuple[tuple[str, str], ...]:
    out, at, parts = [], 0, []
    for n in cuts:
        parts.append(unit[at : at + n])
        at += n
    for p in PAGES:
        inner = ""
        for u in parts:
            x = dict(once(u)).get(p)
            if x is None:
                break
            inner += x
        else:
            again = once(inner)
            out += [(f"{p}+{q}", y) for q, y in again]
            if again:  # or these are just letters side by side
                out.append((p, inner))
    return tuple(dict.fromkeys(out))


def _one_page(run: str) -> bool:
    """Whether one common page makes the whole run out of UTF-8."""
    for p in COMMON:
        t = to_byte(p)
        if all(c in t for c in run):
            try:
                bytes(t[c] for c in run).decode("utf-8")
                return True
            except UnicodeDecodeError:
                pass
    return False


def _double_run(run: str) -> bool:
    """Whether a run of characters could be double-byte text read with a western page: even, of four or more, all valid pairs."""
    if len(run) < 4 or len(run) % 2:
        return False
    return any(all(c in to_byte(w) for c in run) and all(_letter(bytes((to_byte(w)[run[i]], to_byte(w)[run[i + 1]])), d) for i in range(0, len(run), 2)) for w in WESTERN for d in DOUBLE)


@lru_cache(100_000)
def _pair(unit: str) -> tuple[tuple[str, str], ...]:
    out = []
    for w in WESTERN:
        t = to_byte(w)
        if all(c in t for c in unit):
            for d in DOUBLE:
                if x := _letter(bytes(t[c] for c in unit), d):
                    out.append((f"{w}<{d}", x))
    return tuple(out)


def _is_latin(c: str) -> bool:
    return c.isalpha() and (c < "ɐ")


#: Signs of running text that pages place beside letters.
TYPOGRAPHIC = "’‘“”„‚–—…«»‹›°€"


@lru_cache(10_000)
def _swapped(c: str) -> tuple[tuple[str, str], ...]:
    """A single foreign character inside a word: letters of another page with the same byte."""
    out = {}
    for p in PAGES:
        b = to_byte(p).get(c)
        if b is not None:
            for q in TRUE_PAGES:
                x = _letter(bytes((b,)), q)
                if x and x != c and (_is_latin(x) or x in TYPOGRAPHIC):
                    out.setdefault(x, f"{p}<{q}")
    return tuple((k, x) for x, k in out.items())


@lru_cache(200_000)
def hypotheses(unit: str) -> tuple[tuple[str, str], ...]:
    """(key, letter) for all readings of a unit by some page; the genuine one and those without a page are not among them."""
    if unit.endswith(DOUBLED):
        return _pair(unit[:-1])
    if len(unit) == 1:
        return _swapped(unit)
    out = list(once(unit))
    cuts, at = [], 0
    while at < len(unit) and (n := _first(unit[at : at + 4])):
        cuts.append(n)
        at += n
    if at == len(unit) and len(cuts) > 1:
        out += hypotheses_twice(unit, tuple(cuts))
    return tuple(dict.fromkeys(out))


_RUN = re.compile("[^\x00-\x7f]+")
_IGNORED = "­·’‘'´`ʼ"


@lru_cache(100_000)
def parse(run: str, inside: bool) -> tuple[tuple[int, int, str], ...]:
    """Units of a run of characters outside ASCII, as (start, end, unit); inside: ASCII letters stand on both sides."""
    k, found = 0, []
    while k < len(run):
        m = (_twice(run[k : k + 16]) if k + 1 < len(run) else 0) or _first(run[k : k + 4])
        if m:
            found.append((k, k + m, run[k : k + m]))
            k += m
            continue
        if run[k] == LOST:
            found.append((k, k + 1, LOST))
        k += 1
    if not _one_page(run) and _double_run(run):
        found = [(k, k + 2, run[k : k + 2] + DOUBLED) for k in range(0, len(run), 2)]
    # inside a word, a foreign run of up to four characters that no encoding explains may still stand for a letter
    if inside and not found and len(run) <= 4 and not all(_is_latin(c) or c in _IGNORED for c in run) and all(c < "\u0590" or "\u2000" <= c < "\u2e80" for c in run):
        found = [(0, len(run), run)]
    return tuple(found)


def segments(text: str) -> list[tuple[int, int, str]]:
    """Start, end and unit of each candidate, in order. ASCII is never part of one."""
    return cut(text)[0]


def cut(text: str) -> tuple[list[tuple[int, int, str]], list[int]]:
    """The units of a text, and the places of its single characters outside ASCII that are in no longer unit and no ideographs."""
    units: list[tuple[int, int, str]] = []
    singles: list[int] = []
    if text.isascii():
        return units, singles
    for m in _RUN.finditer(text):
        i, j = m.span()
        run = m.group()
        found = parse(run, 0 < i and j < len(text) and text[i - 1].isalpha() and text[j].isalpha())
        units += [(i + a, i + b, u) for a, b, u in found]
        at = 0
        for a, b, u in (*found, (len(run), 0, "")):
            if len(u) == 1 and u != LOST:
                continue  # a unit of one character is a single one, too
            singles += [i + k for k in range(at, a) if "\x7f" < run[k] < "\u2e80"]
            at = b
    return units, singles


def fold(c: str) -> str:
    """The alphabet of bigrams: characters below U+2E80 as they are, one for all ideographs and syllables, one for all else."""
    return c if c < "\u2e80" else "\u4e00" if c < "\ufb00" else "\ue000"


RAW = "kind string, source string, unit string, a string, c string, n bigint, doc_id bigint, units array<string>, singles array<string>"


def _one_pass(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """kind b: bigrams of plain characters (a, c) and characters (a, null); u: units with source and neighbours; both per
    batch; d: a text's units and its single characters with their neighbours, as strings of three."""
    for pdf in it:
        units: Counter = Counter()
        docs = []
        plain: list[str] = []
        for doc, src, text in zip(pdf["doc_id"], pdf["source"], pdf["text"]):
            seg, singles = cut(text)
            if not seg and not singles:
                plain.append(text)
                continue
            at, parts, taken = 0, [], set()
            for a, b, u in seg:
                taken.update(range(a, b))
                parts.append(text[at:a])
                at = b
            parts.append(text[at:])
            plain.append(SEP.join(parts))
            near = lambda i: SEP if not 0 <= i < len(text) or i in taken else fold(text[i])  # noqa: E731, B023
            for a, b, u in seg:
                units[src, u, near(a - 1), near(b)] += 1
            # beside another character outside ASCII there is no evidence
            ascii_ = lambda i: text[i] if 0 <= i < len(text) and text[i] < "\x80" else SEP  # noqa: E731, B023
            docs.append((doc, src, sorted({u for _, _, u in seg}), [ascii_(i - 1) + text[i] + ascii_(i + 1) for i in singles]))
        codes = np.frombuffer(SEP.join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, n = np.unique(codes, return_counts=True)
        rows = [("b", None, None, chr(c), None, k, None, None, None) for c, k in zip(chars.tolist(), n.tolist()) if c]
        low = np.where(codes < 0x2E80, codes, np.where(codes < 0xFB00, 0x4E00, 0xE000)).astype(np.uint64)
        pairs, n = np.unique(low[:-1] << np.uint64(32) | low[1:], return_counts=True)
        rows += [("b", None, None, chr(c >> 32), chr(c & 0xFFFFFFFF), k, None, None, None) for c, k in zip(pairs.tolist(), n.tolist()) if c >> 32 and c & 0xFFFFFFFF]
        rows += [("u", s, u, a, c, n, None, None, None) for (s, u, a, c), n in units.items()]
        rows += [("d", s, None, None, None, None, d, us, ss) for d, s, us, ss in docs]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")])
        yield out.astype({"n": "Int64", "doc_id": "Int64"})


@lru_cache(None)
def _ordinary(letter: str) -> bool:
    """Whether some common alphabet has the letter."""
    for codec in ("cp1252", "cp1250", "cp1251", "cp1253", "gb2312", "big5"):
        try:
            letter.encode(codec)
            return True
        except UnicodeEncodeError:
            pass
    return False


class Language:
    """Character statistics of the plain text: probabilities of characters, and how much likelier one is after another than anywhere.

    Of fixed size: characters are those of Unicode, bigrams those of the folded alphabet.
    """

    def __init__(self, rows: list[tuple[str, str | None, int]]) -> None:
        self.n: dict[str, int] = {a: n for a, c, n in rows if c is None}
        self.total = max(1, sum(self.n.values()))
        self.pair = {(a, c): n for a, c, n in rows if c is not None}
        self.left: dict[str, int] = defaultdict(int)
        self.right: dict[str, int] = defaultdict(int)
        for (a, c), n in self.pair.items():
            self.left[a] += n
            self.right[c] += n
        self.pairs = max(1, sum(self.pair.values()))
        self.letters = [c for c, n in self.n.items() if c > "\x7f" and _is_latin(c) and n >= 1e-6 * self.total]

    def p(self, c: str) -> float:
        return self.n.get(c, 0) / self.total

    def link(self, a: str, c: str) -> float:
        """log P(c | a) / P(c), with a pull of four counts to P(c); none at an edge, the least for a letter no plain text has."""
        if a == SEP or c == SEP:
            return 0.0
        a, c = fold(a), fold(c)
        if a not in self.left or c not in self.right:
            return -6.0
        p = self.right[c] / self.pairs + FLOOR
        return max(-6.0, math.log((self.pair.get((a, c), 0) + 4 * p) / (self.left[a] + 4) / p))


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame, Language]:
    """One pass over (doc_id, source, text): (what each text has, units with their neighbours per source, the language)."""
    raw = cut_lineage(docs.mapInPandas(_one_pass, RAW))
    big = raw.where("kind = 'b'").groupBy("a", "c").agg(F.sum("n").alias("n"))
    language = Language([tuple(r) for r in big.collect()])  # an alphabet-sized table, whatever the number of texts
    units = raw.where("kind = 'u'").groupBy("source", "unit", "a", "c").agg(F.sum("n").alias("n"))
    return raw.where("kind = 'd'").select("doc_id", "source", "units", "singles"), units, language


KEY = "source string, unit string, letter string, key string, weight double, count bigint"


def em(rows: pd.DataFrame, language: Language, rounds: int = 4) -> list[tuple[str, str, str, float, int]]:
    """(unit, letter, key, weight, count) of one source's units, from (unit, a, c, n)."""
    units = []
    for unit, g in rows.groupby("unit", sort=True):
        genuine = unit.removesuffix(DOUBLED)
        reads: dict[str, tuple[str, float]] = {}
        for key, x in (("lost", LOST),) if unit == LOST else (("", genuine), *hypotheses(unit)):
            # an exotic letter takes far more evidence than an ordinary one, the more characters it stands for
            floor = FLOOR if key in ("", "lost") or _ordinary(x[-1]) or x[-1] > "\uffff" or "\u2000" <= x[-1] < "\u2800" else EXOTIC ** (len(genuine) / 2)
            reads.setdefault(x, (key, sum(math.log(language.p(c) + floor) for c in x)))
        near, n = list(zip(g["a"], g["c"])), g["n"].to_numpy(float)

        def links(x: str) -> np.ndarray:
            return np.array([language.link(a, x[0]) + language.link(x[-1], c) for a, c in near])

        letters = [(x, k, own, links(x)) for x, (k, own) in reads.items()]
        inside = sum(m for (a, c), m in zip(near, n) if a.isalpha() and c.isalpha() and a < "\x80" and c < "\x80")
        if unit != LOST and not unit.endswith(DOUBLED) and len(near) >= FREE_CONTEXTS and inside * 2 > n.sum():
            for x in language.letters:
                if x not in reads and float((ls := links(x)) @ n) >= FREE_GAIN * n.sum():
                    letters.append((x, "free", math.log(language.p(x) + FLOOR) - FREE_PRICE, ls))
        score = np.stack([own + ls for _, _, own, ls in letters])
        units.append((unit, [x for x, *_ in letters], [k for _, k, *_ in letters], n, score))
    theta = [np.full(len(u[1]), 0.0) for u in units]
    weight: dict[str, float] = {}
    mass: list[np.ndarray] = []
    for r in range(rounds):
        mass, by_key = [], defaultdict(float)
        for (_, _, keys, n, score), t in zip(units, theta):
            s = score if r == 0 else score + (np.log(t + 1e-6) + np.log(np.array([weight[k] for k in keys]) + 1e-6))[:, None]
            e = np.exp(np.maximum(-500.0, s - s.max(axis=0)))
            m = (e / e.sum(axis=0)) @ n
            mass.append(m)
            for k, v in zip(keys, m.tolist()):
                by_key[k] += v
        total = sum(by_key.values()) or 1.0
        theta = [m / m.sum() for m in mass]
        weight = {k: v / total for k, v in by_key.items()}
    out = []
    for (unit, letters, keys, n, _), t in zip(units, theta):
        i = min(range(len(letters)), key=lambda i: (-t[i], -weight[keys[i]], keys[i], letters[i]))  # noqa: B023
        out.append((unit, letters[i], keys[i], float(t[i]), int(n.sum())))
    return out


def learn_units(units: DataFrame, language: Language, rounds: int = 4) -> DataFrame:
    """(source, unit, letter, key, weight, count): the key of each source; key is empty where the unit is genuine text.

    A source's table has one row per unit and pair of folded neighbours, however many texts there are.
    """
    shared = units.sparkSession.sparkContext.broadcast(language)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in em(pdf, shared.value, rounds)], columns=[c.split()[0] for c in KEY.split(", ")])

    return units.groupBy("source").applyInPandas(run, KEY)


def learn(docs: DataFrame, rounds: int = 4) -> DataFrame:
    """The learned units of (doc_id, source, text)."""
    _, units, language = counted(docs)
    return learn_units(units, language, rounds)


class Swaps:
    """Pairs of single-byte pages (decoded with, written in) and what each makes of a character, for one language."""

    def __init__(self, language: Language) -> None:
        self.language = language
        self.maps: list[tuple[str, dict[str, str]]] = []
        seen = set()
        for p in PAGES:
            for q in TRUE_PAGES:
                m = {c: x for c, b in to_byte(p).items() if (x := _letter(bytes((b,)), q)) and x.isprintable() and language.p(x) > 0}
                swap = tuple(sorted((c, x) for c, x in m.items() if c != x))
                if swap and swap not in seen:
                    seen.add(swap)
                    self.maps.append((f"{p}<{q}", m))
        self.known: dict[str, np.ndarray] = {}

    def gains(self, context: str) -> np.ndarray:
        """By pair of pages, how much likelier the neighbours make the swapped letter than the character itself."""
        g = self.known.get(context)
        if g is None:
            if len(self.known) > 50_000:
                self.known.clear()
            a, c, z = context
            lang = self.language

            @lru_cache(None)
            def score(x: str) -> float:
                return math.log(lang.p(x) + FLOOR) + lang.link(a, x) + lang.link(x, z)

            own = score(c)
            g = self.known[context] = np.array([IMPOSSIBLE if (x := m.get(c)) is None else 0.0 if x == c else score(x) - own for _, m in self.maps])
        return g

    def best(self, contexts: list[str]) -> tuple[str, float, int, int] | None:
        """(pair, evidence, first, last): the pair and the stretch of characters with the largest sum, if it is enough; the whole text if half of that is left over all of it."""
        x = np.cumsum(np.stack([np.zeros(len(self.maps)), *(self.gains(c) for c in contexts)]), axis=0)
        low = np.minimum.accumulate(x, axis=0)
        sums = (x[1:] - low[:-1]).max(axis=0)
        k = int(sums.argmax())
        if sums[k] < SWAP_EVIDENCE:
            return None
        if x[-1, k] >= max(SWAP_EVIDENCE, 0.5 * sums[k]):
            return self.maps[k][0], float(sums[k]), 0, len(contexts) - 1
        last = int((x[1:, k] - low[:-1, k]).argmax())
        return self.maps[k][0], float(sums[k]), int(x[: last + 1, k].argmin()), last


def swapped_texts(texts: DataFrame, language: Language) -> DataFrame:
    """(doc_id, key, first, last): texts with a stretch of single characters of another page, by evidence and the pair's weight in the source."""
    shared = texts.sparkSession.sparkContext.broadcast(language)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        swaps = Swaps(shared.value)
        for pdf in it:
            rows = [(d, s, *b) for d, s, ss in zip(pdf["doc_id"], pdf["source"], pdf["singles"]) if len(ss) and (b := swaps.best(list(ss)))]
            yield pd.DataFrame(rows, columns=["doc_id", "source", "key", "evidence", "first", "last"])

    x = cut_lineage(texts.where("size(singles) > 0").select("doc_id", "source", "singles").mapInPandas(run, "doc_id bigint, source string, key string, evidence double, first int, last int"))
    n = texts.groupBy("source").agg(F.count("*").alias("texts"))
    w = x.groupBy("source", "key").agg(F.count("*").alias("k")).join(n, "source").select("source", "key", F.log(F.col("k") / F.col("texts")).alias("log_weight"))
    return x.join(broadcast_if_small(w), ["source", "key"]).where(F.col("evidence") + F.col("log_weight") > 0).select("doc_id", "key", "first", "last")


def prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text): null texts and ids are left out, a null source is the source ''."""
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), "text")


def affected(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, unit, letter, key) of units that the learned key changes, and swapped_texts, of prepared texts."""
    texts, units, language = counted(d)
    key = cut_lineage(learn_units(units, language).where("key != ''"))
    x = texts.where("size(units) > 0").select("doc_id", "source", F.explode("units").alias("unit"))
    keys = ["source", "unit"]
    return attach(x, key.select(*keys, "letter", "key"), keys, key.select(*keys, "count")).select("doc_id", "unit", "letter", "key"), swapped_texts(texts, language)


def garbled(docs: DataFrame) -> DataFrame:
    """(doc_id, units, lost): documents in which the learned key changes a unit, single characters are swapped or a character was lost. Repeated rows count once."""
    units, swaps = affected(prepared(docs))
    x = units.select("doc_id", "unit", (F.col("key") == "lost").cast("int").alias("lost")).unionByName(swaps.select("doc_id", F.col("key").alias("unit"), F.lit(0).alias("lost")))
    return x.groupBy("doc_id").agg(F.count_distinct("unit").alias("units"), F.max("lost").alias("lost"))


def restore(docs: DataFrame) -> DataFrame:
    """(doc_id, restored, complete): affected documents with their original text; complete is false where characters were lost.

    A document's distinct units come back to its text as one map, which translate() applies, and the pair of pages of its
    swapped stretch.
    """
    d = prepared(docs).dropDuplicates(["doc_id"])
    units, swaps = affected(d)
    per = units.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("unit", "letter"))).alias("map"))

    def apply(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for doc, text, m, key, first, last in zip(pdf["doc_id"], pdf["text"], pdf["map"], pdf["key"], pdf["first"], pdf["last"]):
                if key:
                    text = unswap(text, key, int(first), int(last))
                fixed = decipher(text, dict(m)) if m is not None and len(m) else text
                out.append((doc, fixed, LOST not in fixed))
            yield pd.DataFrame(out, columns=["doc_id", "restored", "complete"])

    x = d.join(per.join(swaps, "doc_id", "full_outer"), "doc_id").select("doc_id", "text", "map", "key", "first", "last")
    return x.mapInPandas(apply, "doc_id bigint, restored string, complete boolean")


def unswap(text: str, key: str, first: int, last: int) -> str:
    """The text with its first to last single character as the pair of pages has them."""
    p, q = key.split("<")
    table = to_byte(p)
    chars = list(text)
    for i in cut(text)[1][first : last + 1]:
        if (b := table.get(chars[i])) is not None:
            chars[i] = _letter(bytes((b,)), q) or chars[i]
    return "".join(chars)


def decipher(text: str, mapping: dict[str, str]) -> str:
    """Units become private-use characters, which translate() turns into letters."""
    code = {u: chr(0xF0000 + i) for i, u in enumerate(sorted(mapping))}
    parts, at = [], 0
    for a, b, u in segments(text):
        if u in code:
            parts += [text[at:a], code[u]]
            at = b
    return ("".join(parts) + text[at:]).translate({ord(code[u]): x for u, x in mapping.items()})
