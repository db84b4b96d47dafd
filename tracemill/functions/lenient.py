"""Lenient JSON and call parsing as vectorised functions (survey X1 NFKC, X13-X17, X24, X25, X34, X38, F14, F24).

These decide row membership by a writer's dialect (NaN, last duplicate key, single quotes, tuples), which the built-in
JSON functions do not follow; each is one Arrow pass. Null and unparsable input gives null or an empty collection.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)
_CALL_TAG = re.compile(r"<tool_call>\s*(.*?)\s*</tool_call>", re.S)
_ACTIONS = re.compile(r"['\"]?actions['\"]?\s*:\s*(?=\[)")
_BLOB_KEYS = ("base64", "image", "image_data", "img", "bytes")
CALLS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())]))


def balanced(s: str, at: int, opener: str = "{", closer: str = "}") -> int:
    """End of the balanced span that begins at `at`, strings respected; -1 if it never closes."""
    depth, quoted, skip = 0, False, False
    for i in range(at, len(s)):
        c = s[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c == opener:
            depth += 1
        elif c == closer:
            depth -= 1
            if not depth:
                return i + 1
    return -1


def loads(s: str):
    """JSON, else a Python literal, else None."""
    try:
        return json.loads(s)
    except (ValueError, RecursionError):
        try:
            return ast.literal_eval(s)
        except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
            return None


def last_object(s: str | None) -> str | None:
    """The outermost balanced object that ends at the last closing brace."""
    if not s or (end := s.rfind("}")) < 0:
        return None
    depth = 0
    for i in range(end, -1, -1):
        depth += (s[i] == "}") - (s[i] == "{")
        if not depth:
            return s[i : end + 1]
    return None


def first_object(s: str | None) -> str | None:
    """The first object that parses, inside a fenced block if there is one."""
    if not s:
        return None
    for text in (*_FENCE.findall(s), s):
        at = text.find("{")
        while at >= 0:
            end = balanced(text, at)
            if end > 0:
                try:
                    json.loads(text[at:end])
                    return text[at:end]
                except ValueError:
                    pass
            at = text.find("{", at + 1)
    return None


def _as_calls(v) -> list[tuple[str, str]]:
    out = []
    for x in v if isinstance(v, (list, tuple)) else [v]:
        if isinstance(x, dict):
            name = x.get("name") or x.get("API_name")
            args = x.get("arguments", x.get("API_params", {}))
            if name:
                out.append((str(name), args if isinstance(args, str) else json.dumps(args, ensure_ascii=False, sort_keys=True)))
    return out


def tool_calls(s: str | None) -> list[tuple[str, str]]:
    """Calls in tags, else the list after `actions:`, else the whole text as an object or list."""
    if not s:
        return []
    tagged = [c for t in _CALL_TAG.findall(s) for c in _as_calls(loads(t))]
    if tagged:
        return tagged
    m = _ACTIONS.search(s)
    if m and (end := balanced(s, m.end(), "[", "]")) > 0 and (got := _as_calls(loads(s[m.end() : end]))):
        return got
    return _as_calls(loads(s.strip()))


def repair_call(s: str | None) -> str | None:
    """Closes an open think block, drops code fences, and wraps several JSON lines into one array."""
    if s is None:
        return None
    t = s
    if t.count("<think>") > t.count("</think>"):
        at = t.find("{", t.rfind("<think>"))
        t = t + "</think>" if at < 0 else t[:at].rstrip() + "</think>\n" + t[at:]
    t = re.sub(r"```(?:json)?\s*|\s*```", "", t)
    head, sep, body = t.rpartition("</think>")
    lines = [x.strip().rstrip(",") for x in body.strip().splitlines() if x.strip()]
    if len(lines) > 1 and all(isinstance(loads(x), dict) for x in lines):
        body = "\n[" + ", ".join(lines) + "]"
    return head + sep + (body if sep else body.strip())


def clean_observation(s: str | None) -> str | None:
    """The first part of a (result, metadata) pair, else text before the last ', {'."""
    if s is None:
        return None
    t = s.strip()
    if t.startswith("("):
        v = loads(t)
        if isinstance(v, tuple) and v:
            return v[0] if isinstance(v[0], str) else json.dumps(v[0], ensure_ascii=False)
        if ", {" in t:
            return t[1 : t.rfind(", {")].strip().strip("'\"")
    return t


def valid_call(s: str | None) -> bool:
    """what follows the think block parses to one or more objects that all have name and arguments."""
    if s is None:
        return False
    t = re.sub(r"<think>.*?</think>", "", s, flags=re.S).strip()
    try:
        v = json.loads(t)
    except (ValueError, RecursionError):
        return False
    xs = v if isinstance(v, list) else [v]
    return bool(xs) and all(isinstance(x, dict) and "name" in x and "arguments" in x for x in xs)


def signature(name: str | None, args: str | None) -> str:
    """Name::arguments as JSON with sorted keys; arguments that do not parse stay as text."""
    v = loads(args) if args else {}
    return f"{name or ''}::{json.dumps(v, sort_keys=True, ensure_ascii=False) if v is not None else args}"


def bad_schema(s: str | None) -> bool:
    """at any depth an array type whose items is an empty object."""

    def walk(v) -> bool:
        if isinstance(v, dict):
            return v.get("type") == "array" and v.get("items") == {} or any(map(walk, v.values()))
        return isinstance(v, list) and any(map(walk, v))

    return walk(loads(s)) if s else False


def redact(s: str | None) -> str | None:
    """Values of image and base64 keys become '<redacted>' at any depth; text that does not parse is unchanged."""

    def walk(v):
        if isinstance(v, dict):
            return {k: "<redacted>" if any(b in k.lower() for b in _BLOB_KEYS) and isinstance(x, str) else walk(x) for k, x in v.items()}
        return [walk(x) for x in v] if isinstance(v, list) else v

    if s is None:
        return None
    try:
        return json.dumps(walk(json.loads(s)), ensure_ascii=False)
    except (ValueError, RecursionError):
        return s


def sections(s: str | None, headers: tuple[str, ...]) -> dict[str, str]:
    """Text under each known header ('Header:' at a line start, any case) up to the next one; a later duplicate wins."""
    if not s:
        return {}
    pat = re.compile(r"(?im)^\s*(" + "|".join(map(re.escape, sorted(headers, key=len, reverse=True))) + r")\s*:")
    marks = list(pat.finditer(s))
    return {m.group(1).lower(): s[m.end() : n.start() if n else len(s)].strip() for m, n in zip(marks, [*marks[1:], None])}


def exam_lines(s: str | None) -> dict[str, str]:
    """X25: 'Header: rest' lines to entries, other lines to 'General'; a later duplicate wins."""
    out: dict[str, str] = {}
    for line in (s or "").splitlines():
        if not line.strip():
            continue
        m = re.match(r"\s*([A-Za-z][A-Za-z /-]{0,30}):\s*(.*)$", line)
        if m and m.group(2).strip():
            out[m.group(1).strip()] = m.group(2).strip()
        elif not m:
            out["General"] = f"{out['General']} {line.strip()}" if "General" in out else line.strip()
    return out


def _udf(f: Callable, kind: T.DataType, *cols: Column) -> Column:
    @F.pandas_udf(kind)
    def run(*xs: pd.Series) -> pd.Series:
        return pd.Series([f(*(None if v is None or isinstance(v, float) else v for v in r)) for r in zip(*xs)])

    return run(*cols)


def last_object_col(c: Column) -> Column:
    return _udf(last_object, T.StringType(), c)


def first_object_col(c: Column) -> Column:
    return _udf(first_object, T.StringType(), c)


def tool_calls_col(c: Column) -> Column:
    return _udf(lambda s: [{"name": a, "arguments": b} for a, b in tool_calls(s)], CALLS, c)


def repair_call_col(c: Column) -> Column:
    return _udf(repair_call, T.StringType(), c)


def clean_observation_col(c: Column) -> Column:
    return _udf(clean_observation, T.StringType(), c)


def valid_call_col(c: Column) -> Column:
    return _udf(valid_call, T.BooleanType(), c)


def signature_col(name: Column, args: Column) -> Column:
    return _udf(signature, T.StringType(), name, args)


def bad_schema_col(c: Column) -> Column:
    return _udf(bad_schema, T.BooleanType(), c)


def redact_col(c: Column) -> Column:
    return _udf(redact, T.StringType(), c)


def sections_col(c: Column, headers: tuple[str, ...]) -> Column:
    return _udf(lambda s: sections(s, headers), T.MapType(T.StringType(), T.StringType()), c)


def exam_lines_col(c: Column) -> Column:
    return _udf(exam_lines, T.MapType(T.StringType(), T.StringType()), c)
