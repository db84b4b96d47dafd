"""Byte-level BPE as a lazily determinised finite-state transducer.

The merges are compiled into a trie over token bytes. While bytes are read, the transducer keeps every boundary from
which a longer token could still arise, each with the token before it. Of the tokens that end at a byte exactly one
continues the BPE segmentation of the prefix: the one that fits behind the token before it. So the set of live boundaries
is a deterministic state, and each transition puts out the token that ends the segmentation up to its byte. States and
transitions are built the first time they are met and kept. Tokens are final as soon as no earlier boundary is live, which
is after at most the longest token's length of lookahead; they are then read off backwards. Results equal repeated
lowest-rank merging.

Two tokens fit if no merge crosses their border. The pieces at the border over time are the right spine of the first
token's merge tree and the left spine of the second's; a crossing merge takes place if its rank comes while both its
pieces stand, so both spines are walked down by falling rank, without merging anything.

Text is first split by the vocabulary's pattern; each piece is run through the transducer once and its output kept.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the split pattern that belongs to the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries kept per worker before a memo is emptied; bounds memory, never results.
MAX_PIECES, MAX_TRANSITIONS = 150_000, 300_000


def tokenizer_dir(spark: SparkSession | None = None) -> str:
    """Folder of the vocabulary files: spark conf tracemill.tokenizers, env TRACEMILL_TOKENIZERS, else the installed package."""
    own = spark.conf.get("spark.tracemill.tokenizers", None) if spark is not None else None
    own = own or os.environ.get("TRACEMILL_TOKENIZERS")
    if own:
        return own
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The rank file's lines are base64(token) and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Memo(dict):
    """Outputs by piece, computed when missing. Long pieces are not kept, and all are dropped when there are too many."""

    def __init__(self, compute) -> None:
        self.compute = compute

    def __missing__(self, piece: str):
        out = self.compute(piece)
        if len(piece) <= 64:
            if len(self) > MAX_PIECES:
                self.clear()
            self[piece] = out
        return out


class Transducer:
    """Encoder and decoder for one vocabulary. Special-token strings are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.by_id = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.edge: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        nodes = 1
        for tok, i in ranks.items():
            at = 0
            for b in tok:
                key = at << 8 | b
                nxt = self.edge.get(key)
                if nxt is None:
                    nxt = self.edge[key] = nodes
                    nodes += 1
                at = nxt
            self.ends[at] = i
        self.has_child = {k >> 8 for k in self.edge}
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = Memo(lambda p: array("i", self.run(p.encode("utf-8", "replace"))).tobytes())
        self.sizes = Memo(lambda p: len(self.run(p.encode("utf-8", "replace"))))
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1),)
        self.state_of = {start: 0}
        self.states = [start]
        self.step: dict[int, tuple[int, int]] = {}

    def merge(self, data: bytes, below: float = float("inf")) -> list[bytes]:
        """Lowest-rank merging, the definition, of merges ranked lower than `below`."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two pieces of a token's last merge."""
        h = self.halves.get(token)
        if h is None:
            h = self.halves[token] = tuple(self.merge(token, self.ranks[token]))
        return h

    def _fit(self, a: int, b: int) -> bool:
        """Whether BPE leaves a boundary between the tokens a and b."""
        ok = self.fits.get((a, b))
        if ok is None:
            if len(self.fits) > MAX_TRANSITIONS:
                self.fits.clear()
            ok = self.fits[a, b] = self._no_crossing(self.by_id[a], self.by_id[b])
        return ok

    def _no_crossing(self, x: bytes, y: bytes) -> bool:
        ranks = self.ranks
        # x stands until a merge of rank x_until takes it, y until y_until; of equal merges the left one comes first
        x_until = y_until = float("inf")
        while True:
            r = ranks.get(x + y)
            if r is not None and r < x_until and r <= y_until:
                return False
            rx, ry = ranks[x] if len(x) > 1 else -1, ranks[y] if len(y) > 1 else -1
            if rx > ry:
                x, x_until = self._halves(x)[1], rx
            elif ry >= 0:
                y, y_until = self._halves(y)[0], ry
            else:
                return True

    def _build(self, sid: int, byte: int) -> tuple[int, int]:
        """Determinise one transition: the next state and the last token up to this byte. A state has, per live boundary, its trie node and the token before it."""
        edge, ends, has_child = self.edge, self.ends, self.has_child
        kept, found = [], -1
        for node, before in self.states[sid]:
            nxt = edge.get(node << 8 | byte)
            if nxt is None:
                continue
            if found < 0 and (tok := ends.get(nxt)) is not None and (before < 0 or self._fit(before, tok)):
                found = tok
            if nxt in has_child:
                kept.append((nxt, before))
        kept.append((0, found))
        state = tuple(kept)
        nid = self.state_of.get(state)
        if nid is None:
            nid = self.state_of[state] = len(self.states)
            self.states.append(state)
        return nid, found

    def run(self, data: bytes) -> tuple[int, ...]:
        if len(self.step) > MAX_TRANSITIONS:
            self._reset()
        sid, last, step = 0, [], self.step
        for b in data:
            key = sid << 8 | b
            t = step.get(key)
            if t is None:
                t = step[key] = self._build(sid, b)
            sid, found = t
            last.append(found)
        out, at, size = [], len(last), self.size
        while at:
            tok = last[at - 1]
            out.append(tok)
            at -= size[tok]
        return tuple(out[::-1])

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text; the empty list for an empty or null text. Lone surrogates become '?'."""
        return array("i", self.packed(text)).tolist()

    def packed(self, text: str | None) -> bytes:
        """The ids as 32-bit integers in the machine's order."""
        return b"".join(map(self.pieces.__getitem__, self.split(text))) if text else b""

    def count(self, text: str | None) -> int:
        """Tokens of the whole text, without their ids."""
        return sum(map(self.sizes.__getitem__, self.split(text))) if text else 0

    def decode(self, ids: list[int] | None) -> str:
        """Streaming decode of whole id lists."""
        d = Utf8Stream()
        return "".join(d.feed(self.by_id[i]) for i in ids or ()) + d.close()


class Utf8Stream:
    """Incremental UTF-8 state machine: bytes in any cut, characters out. A malformed sequence gives U+FFFD and is resumed at the byte that broke it."""

    def __init__(self) -> None:
        self.need, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.low, self.high = 0x80, 0xBF
                    self.code = self.code << 6 | b & 0x3F
                    self.need -= 1
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                self.need, self.low, self.high = 0, 0x80, 0xBF
                out.append("�")
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left, self.need, self.low, self.high = self.need, 0, 0x80, 0xBF
        return "�" if left else ""


_made: dict[tuple[str, int], Transducer] = {}


class Vocabulary:
    """A handle that tasks can hold: the rank file's bytes travel once as a broadcast (under 1 MB, a fixed file), the transducer is made once per worker."""

    def __init__(self, spark: SparkSession, name: str = "byte_bpe_50k", folder: str | None = None) -> None:
        with open(os.path.join(folder or tokenizer_dir(spark), f"{name}.tiktoken"), "rb") as f:
            data = f.read()
        self.name, self.size = name, len(data)
        self.data = spark.sparkContext.broadcast(data)

    def get(self) -> Transducer:
        key = (self.name, self.size)
        if key not in _made:
            _made[key] = Transducer(load_ranks(self.data.value))
        return _made[key]


def encode_documents(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each whole text. Empty and null texts give the empty list; a null id is kept; repeated rows give repeated rows; other columns are not read."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = pa.string() if dict(src.dtypes)["doc_id"] == "string" else pa.int64()
    if id_type == pa.int64():
        src = src.withColumn("doc_id", F.col("doc_id").cast("bigint"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = vocab.get().packed
        for b in it:
            parts = [packed(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, np.int64)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return src.mapInArrow(batches, f"doc_id {dict(src.dtypes)['doc_id']}, ids array<int>")


def token_counts(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, loss_tokens): sizes only. Every token of a plain text bears loss. A null text has no tokens."""
    x = _counted(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.lit(True).alias("bears")), vocab)
    return x.select("doc_id", "tokens", F.col("tokens").alias("loss_tokens"))


def conversation_counts(examples: DataFrame, vocab: Vocabulary, reply: str = "assistant") -> DataFrame:
    """(doc_id, tokens, loss_tokens) of each example: tokens of all messages, and of the replies, which alone bear loss.

    Null contents have no tokens; an example without messages has none; re-delivered examples count once; null ids are left out.
    """
    x = examples.where("example_id is not null").select("example_id", "messages").dropDuplicates(["example_id"])
    m = x.select(F.col("example_id").cast("bigint").alias("doc_id"), F.explode_outer("messages").alias("m"))
    m = _counted(m.select("doc_id", F.col("m.content").alias("text"), F.coalesce(F.col("m.role") == reply, F.lit(False)).alias("bears")), vocab)
    return m.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("bears"), F.col("tokens")).otherwise(0)).alias("loss_tokens"))


def _counted(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(doc_id, text, bears) with the text's tokens in its place."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = vocab.get().count
        for b in it:
            n = pa.array([count(t) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, b.column(2)], names=["doc_id", "tokens", "bears"])

    return texts.mapInArrow(batches, "doc_id bigint, tokens bigint, bears boolean")


def decode_documents(encoded: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(doc_id, text) from (doc_id, ids) by the streaming decoder; a null list gives the empty text."""
    src = encoded.select("doc_id", "ids")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = vocab.get().decode
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([dec(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return src.mapInArrow(batches, f"doc_id {dict(src.dtypes)['doc_id']}, text string")

