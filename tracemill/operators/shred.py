"""Nested records as related flat tables, with Merkle identities.

Every child of a nested record (array element, map entry, element of a serialised JSON value) becomes a bridge row that
names its parent record, the node it stands under and its own place (array position or map key). Each subtree is
canonicalised and hashed bottom-up: a scalar by its type and value, a struct by its fields' names and hashes, a collection
by its children's hashes with their keys or ordinals, a record by its collections. Collections, inner maps and records have
identities and rows of their own, whose body holds the hashes of what they are made of. Equal subtrees therefore share one
hash and are stored once in the objects table, however often they occur; the bridge keeps every occurrence.

Arrays and maps are taken apart by built-in expressions in one pass per row, without a shuffle; only text that begins like
serialised JSON goes through a vectorised Python function, since its depth is unbounded and its dialect is the writer's.

Defined cases: null elements and map entries with a null value are no children, but later elements keep their position.
Null and empty collections have no children and no row. Rows that come again with the same key count once; rows with a null
key are left out. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEYS = ("level", "node", "key1", "key2", "parent_hash", "hash", "kind", "body")
ROWS = T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in _KEYS]))
#: Levels of bridge rows. Children are what a flat table holds; the others are what lies between them and the record.
RECORD, COLLECTION, INNER, CHILD = "record", "collection", "inner", "child"
#: Kinds of values by the type's tag in the hash, so that the text 5 and the number 5 differ.
TAGS = {"string": "s", "integer": "i", "number": "d", "boolean": "b", "array": "[", "object": "{", "null": "n"}


@dataclass(frozen=True)
class Node:
    """A collection of a record. kind: array, map, map2 (a map of maps) or json (a serialised value, see json_children)."""

    name: str
    path: str
    kind: str


def _hash(c: Column) -> Column:
    return F.sha2(c, 256)


def _type(df: DataFrame, path: str) -> T.DataType:
    """The type of a collection's values."""
    kind = df.select(F.col(path)).schema[0].dataType
    while hasattr(kind, "elementType") or hasattr(kind, "valueType"):
        kind = getattr(kind, "elementType", None) or kind.valueType
    return kind


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.StructType):
        return "object"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, T.MapType):
        return "object"
    return "integer" if isinstance(t, T.IntegralType) else "boolean" if isinstance(t, T.BooleanType) else "number" if isinstance(t, T.NumericType) else "string"


def merkle(c: Column, t: T.DataType) -> Column:
    """The hash of a value, bottom-up. Null is a value of its own; objects and maps are taken in the order of their keys."""
    if isinstance(t, T.StructType):
        parts = [F.concat(F.lit(f.name + "\x1f"), merkle(c[f.name], f.dataType)) for f in sorted(t.fields, key=lambda f: f.name)]
        h = F.concat(F.lit("{"), F.concat_ws("\x1e", *parts))
    elif isinstance(t, T.ArrayType):
        h = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: merkle(x, t.elementType)), "\x1e"))
    elif isinstance(t, T.MapType):
        h = F.concat(F.lit("{"), F.array_join(F.transform(_entries(c), lambda e: F.concat_ws("\x1f", e["key"].cast("string"), merkle(e["value"], t.valueType))), "\x1e"))
    else:
        h = F.concat(F.lit(TAGS[kind_of(t)] + ":"), c.cast("string"))
    return _hash(F.coalesce(h, F.lit("n:")))


def _entries(m: Column) -> Column:
    """Entries of a map ordered by key, so that equal maps hash alike whatever their order."""
    return F.array_sort(F.map_entries(m), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def _leaf(key1: Column, key2: Column, value: Column, t: T.DataType) -> Column:
    body = F.to_json(value) if isinstance(t, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")
    return F.struct(key1.alias("key1"), key2.alias("key2"), merkle(value, t).alias("hash"), body.alias("body"))


def _row(level: str, node: str, key1: Column, key2: Column, parent: Column, hash_: Column, kind: str, body: Column) -> Column:
    cells = (F.lit(level), F.lit(node), key1, key2, parent, hash_, F.lit(kind), body)
    return F.struct(*(c.cast("string").alias(k) for k, c in zip(_KEYS, cells)))


def _made_of(parts: Column, key: str, array: bool) -> Column:
    """The body of a collection: its children's keys and hashes, one a line."""
    return F.concat(F.lit("[" if array else "{"), F.array_join(F.transform(parts, lambda x: F.concat_ws("\x1f", x[key], x["hash"])), "\x1e"))


def children(df: DataFrame, node: Node) -> tuple[Column, Column]:
    """(rows of a record's collection, its children and what lies between, but for the collection's own; its (hash, kind, body), null if it is empty)."""
    c, name, no = F.col(node.path), node.name, F.lit("")
    empty = F.array().cast(ROWS)
    if node.kind == "json":
        t = F.trim(c, F.lit(" \t\r\n"))
        looks = F.coalesce(t.rlike("^\\s*[\\[{]"), F.lit(False))
        prose = F.when(~looks & c.rlike("\\S"), F.array(F.struct(F.lit("0").alias("key1"), no.alias("key2"), merkle(c, T.StringType()).alias("hash"), c.alias("body"))))
        own = _made_of(prose, "key1", True)
        rows = F.transform(prose, lambda x: _row(CHILD, name, x["key1"], no, _hash(own), x["hash"], "string", x["body"]))
        parsed = json_rows(F.lit(name), F.when(looks, c))
        top = F.get(F.filter(parsed, lambda r: r["level"] == COLLECTION), F.lit(0))
        inner = F.filter(parsed, lambda r: r["level"] != COLLECTION)
        return F.coalesce(rows.cast(ROWS), inner.cast(ROWS), empty), F.coalesce(F.when(prose.isNotNull(), F.struct(_hash(own).alias("hash"), F.lit("array").alias("kind"), own.alias("body"))), F.when(top.isNotNull(), F.struct(top["hash"].alias("hash"), top["kind"].alias("kind"), top["body"].alias("body"))))
    t, kind = _type(df, node.path), kind_of(_type(df, node.path))
    if node.kind == "array":
        placed = F.filter(F.transform(c, lambda x, i: F.struct(x.alias("x"), i.cast("string").alias("i"))), lambda s: s["x"].isNotNull())
        leaves, body_kind = F.transform(placed, lambda s: _leaf(s["i"], no, s["x"], t)), "array"
    elif node.kind == "map":
        leaves, body_kind = F.transform(_entries(F.map_filter(c, lambda k, v: v.isNotNull())), lambda e: _leaf(e["key"].cast("string"), no, e["value"], t)), "object"
    elif node.kind == "map2":
        outer = F.filter(_entries(F.map_filter(c, lambda k, v: v.isNotNull())), lambda e: F.exists(F.map_values(e["value"]), lambda v: v.isNotNull()))
        inner = F.transform(outer, lambda e: F.struct(e["key"].cast("string").alias("key1"), F.transform(_entries(F.map_filter(e["value"], lambda k, v: v.isNotNull())), lambda i: _leaf(e["key"].cast("string"), i["key"].cast("string"), i["value"], t)).alias("leaves")))
        inner = F.transform(inner, lambda g: F.struct(g["key1"].alias("key1"), g["leaves"].alias("leaves"), _made_of(g["leaves"], "key2", False).alias("body")))
        inner = F.transform(inner, lambda g: F.struct(g["key1"].alias("key1"), g["leaves"].alias("leaves"), g["body"].alias("body"), _hash(g["body"]).alias("hash")))
        own = _made_of(inner, "key1", False)
        rows = F.flatten(F.transform(inner, lambda g: F.concat(F.array(_row(INNER, name, g["key1"], no, _hash(own), g["hash"], "object", g["body"])), F.transform(g["leaves"], lambda x: _row(CHILD, name, x["key1"], x["key2"], g["hash"], x["hash"], kind, x["body"])))))
        return F.coalesce(rows.cast(ROWS), empty), F.when(F.size(inner) > 0, F.struct(_hash(own).alias("hash"), F.lit("object").alias("kind"), own.alias("body")))
    else:
        raise ValueError(f"unknown kind of node: {node.kind}")
    own = _made_of(leaves, "key1", body_kind == "array")
    rows = F.transform(leaves, lambda x: _row(CHILD, name, x["key1"], x["key2"], _hash(own), x["hash"], kind, x["body"]))
    return F.coalesce(rows.cast(ROWS), empty), F.when(F.size(leaves) > 0, F.struct(_hash(own).alias("hash"), F.lit(body_kind).alias("kind"), own.alias("body")))


def canonical_json(v) -> tuple[str, str, str]:
    """(hash, kind, body) of a parsed value. An object's hash is made of its sorted keys and its values' hashes, an array's of its elements' hashes."""
    if isinstance(v, dict):
        parts = [(k, *canonical_json(v[k])) for k in sorted(v)]
        return _sha("{" + "\x1e".join(f"{k}\x1f{h}" for k, h, _, _ in parts)), "object", json.dumps(v, ensure_ascii=False, sort_keys=True)
    if isinstance(v, list):
        return _sha("[" + "\x1e".join(canonical_json(x)[0] for x in v)), "array", json.dumps(v, ensure_ascii=False, sort_keys=True)
    if v is None:
        return _sha("n:"), "null", "null"
    kind = "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string"
    body = v if kind == "string" else json.dumps(v)
    return _sha(f"{TAGS[kind]}:{body}"), kind, body


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def history_items(text: str | None) -> list:
    """The items of a history: prose is one item; a JSON array gives its elements; a JSON object those of `episodes`.

    Text that does not parse as an array or object is prose, as are bracketed remarks before prose. Blank text has none.
    """
    if text is None or not text.strip():
        return []
    s = text.strip()
    if s[0] in "[{":
        try:
            v = json.loads(s)
        except (ValueError, RecursionError):
            return [text]
        if isinstance(v, list):
            return v
        if isinstance(v, dict):
            e = v.get("episodes")
            return e if isinstance(e, list) else []
    return [text]


def _placed(items: list) -> list[tuple[str, object, tuple[str, str, str]]]:
    return [(str(i), x, canonical_json(x)) for i, x in enumerate(items) if x is not None]


def _list_body(placed: list) -> str:
    return "[" + "\x1e".join(f"{i}\x1f{c[0]}" for i, _, c in placed)


def history_rows(name: str, text: str | None) -> list[tuple]:
    """Rows of a serialised history: the list itself, its items, and the lists of an item's findings with their elements."""
    items = _placed(history_items(text))
    if not items:
        return []
    own = _list_body(items)
    root = _sha(own)
    out = [(COLLECTION, name, "", "", None, root, "array", own)]
    for i, x, c in items:
        out.append((CHILD, name, i, "", root, *c))
        found = _placed(x["findings"]) if isinstance(x, dict) and isinstance(x.get("findings"), list) else []
        if found:
            body = _list_body(found)
            inner = _sha(body)
            out.append((INNER, f"{name}.findings", i, "", c[0], inner, "array", body))
            out += [(CHILD, f"{name}.findings", i, k, inner, *f) for k, _, f in found]
    return out


@F.pandas_udf(ROWS)
def json_rows(name: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [dict(zip(_KEYS, r)) for r in history_rows(n, t)] for n, t in zip(name, text)])


def bridge(df: DataFrame, tab: str, key: str, nodes: list[Node], between: bool = False) -> DataFrame:
    """(tab, parent_id, level, node, key1, key2, parent_hash, hash, kind, body): one row per child of every record.

    between: also a row per record (level record), per collection that is not empty (its parent is the record) and per inner
    map or list (its parent is the collection or the item). Every parent_hash is then the hash of a row.
    """
    leaf = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__id"), *(F.col(n.path).alias(f"__{i}") for i, n in enumerate(nodes))).dropDuplicates(["__id"])
    made = [children(leaf, Node(n.name, f"__{i}", n.kind)) for i, n in enumerate(nodes)]
    leaf = leaf.select("__id", *(r.alias(f"__r{i}") for i, (r, _) in enumerate(made)), *([o.alias(f"__o{i}") for i, (_, o) in enumerate(made)] if between else []))
    all_ = F.concat(*(F.col(f"__r{i}") for i in range(len(nodes))))
    if between:
        no = F.lit("")
        own = [F.when(F.col(f"__o{i}").isNotNull(), F.struct(F.lit(n.name).alias("node"), *(F.col(f"__o{i}")[k].alias(k) for k in ("hash", "kind", "body")))) for i, n in enumerate(nodes)]
        parts = F.filter(F.array(*own), lambda x: x.isNotNull())
        leaf = leaf.withColumn("__parts", parts).withColumn("__body", _made_of(F.col("__parts"), "node", False)).withColumn("__hash", _hash("__body"))
        record = F.array(_row(RECORD, "", no, no, F.lit(None), F.col("__hash"), "object", F.col("__body")))
        middle = F.transform("__parts", lambda x: F.struct(*(v.cast("string").alias(k) for k, v in zip(_KEYS, (F.lit(COLLECTION), x["node"], no, no, F.col("__hash"), x["hash"], x["kind"], x["body"])))))
        all_ = F.concat(record.cast(ROWS), middle.cast(ROWS), all_)
    else:
        all_ = F.filter(all_, lambda r: r["level"] == CHILD)
    return leaf.select(F.lit(tab).alias("tab"), F.col("__id").cast("bigint").alias("parent_id"), F.inline(all_))


CASE_NODES = [Node("roles", "agent_structure.roles", "array"), Node("tools_called", "tools_called", "array"), Node("example_reasoning", "example_reasoning", "map")]
SCENARIO_NODES = [
    Node("secondary_symptoms", "osce_examination.patient_actor.symptoms.secondary_symptoms", "array"),
    Node("physical_examination_findings", "osce_examination.physical_examination_findings", "map"),
    Node("chexpert_labels", "osce_examination.chexpert_labels", "map"),
    Node("test_results", "osce_examination.test_results", "map2"),
    Node("history", "osce_examination.patient_actor.history", "json"),
]


def shred(cases: DataFrame, scenarios: DataFrame, between: bool = False) -> DataFrame:
    """The bridge of both tables."""
    return bridge(cases, "demo_case", "case_id", CASE_NODES, between).unionByName(bridge(scenarios, "demo_scenario", "scenario_id", SCENARIO_NODES, between))


def links(b: DataFrame) -> DataFrame:
    """(tab, parent_id, level, node, key1, key2, parent_hash, hash): every occurrence of every subtree."""
    return b.select("tab", "parent_id", "level", "node", "key1", "key2", "parent_hash", "hash")


def objects(b: DataFrame) -> DataFrame:
    """(hash, kind, body, occurrences): every distinct subtree once. Counted per partition before the shuffle."""
    return b.groupBy("hash").agg(F.min("kind").alias("kind"), F.min("body").alias("body"), F.count("*").alias("occurrences"))


def sharing(b: DataFrame) -> DataFrame:
    """(tab, level, node, occurrences, objects): how often subtrees of a node occur and how many different ones there are."""
    return b.groupBy("tab", "level", "node", "hash").agg(F.count("*").alias("n")).groupBy("tab", "level", "node").agg(F.sum("n").alias("occurrences"), F.count("*").alias("objects"))
