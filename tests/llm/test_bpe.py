"""The transducer against lowest-rank merging and the public library; exact round trips; defined cases."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import bpe

FOLDER = bpe.tokenizer_dir()


@pytest.fixture(scope="module")
def tr():
    path = os.path.join(FOLDER, "byte_bpe_50k.tiktoken")
    if not os.path.exists(path):
        pytest.skip("vocabulary files are not here")
    return bpe.Transducer(bpe.load_ranks(open(path, "rb").read()))


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


TEXT = st.text(alphabet=st.one_of(st.sampled_from("abcdeinorst ABC012'.,\n\t-ingtion"), st.characters(codec="utf-8")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_equals_the_public_encoder_and_decodes_back(text):
    path = os.path.join(FOLDER, "byte_bpe_50k.tiktoken")
    if not os.path.exists(path):
        pytest.skip("vocabulary files are not here")
    t = _cached()
    ids = t.encode(text)
    assert t.decode(ids) == text
    assert ids == [t.ranks[x] for p in t.split(text) for x in t.merge(p.encode())]
    assert t.count(text) == len(ids)


@settings(max_examples=500, deadline=None)
@given(st.integers(0, 50_255), st.integers(0, 50_255))
def test_tokens_fit_exactly_if_merging_them_gives_them_back(a, b):
    t = _cached()
    for x, y in ((a, b), (a, a), (b % 700, a), (a, b % 700), (a % 300, b % 300)):
        assert t._fit(x, y) == (t.merge(t.by_id[x] + t.by_id[y]) == [t.by_id[x], t.by_id[y]])


_T = []


def _cached():
    if not _T:
        _T.append(bpe.Transducer(bpe.load_ranks(open(os.path.join(FOLDER, "byte_bpe_50k.tiktoken"), "rb").read())))
    return _T[0]


def test_public(tr, public):
    for s in ("", "Hello world", "<|endoftext|> as text", "  two  blanks ", "naïve café — ½ µg", "专家组认为", "a" * 500, "🧪🩺‍", "don't I'll they've"):
        assert tr.encode(s) == public.encode(s, add_special_tokens=False).ids


def test_memos_may_be_emptied(tr, monkeypatch):
    want = tr.encode("some ordinary words and bisulfantamide")
    monkeypatch.setattr(bpe, "MAX_TRANSITIONS", 3)
    monkeypatch.setattr(bpe, "MAX_PIECES", 2)
    small = bpe.Transducer(tr.ranks)
    assert small.encode("some ordinary words and bisulfantamide") == want


def test_utf8_stream_in_any_cut():
    data = "aé中🧪".encode()
    for cut in range(len(data) + 1):
        s = bpe.Utf8Stream()
        assert s.feed(data[:cut]) + s.feed(data[cut:]) + s.close() == "aé中🧪"
    s = bpe.Utf8Stream()
    assert s.feed(b"\xc3(\xff\xe4\xb8") + s.close() == "�(��"


def test_documents(spark, tr):
    long_ = "word " * 40_000
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "hi there", 9), (3, "hi there", 9), (None, "x", 9), (4, long_, 9)], "doc_id long, text string, ids int")
    v = bpe.Vocabulary(spark)
    got = [(r["doc_id"], r["ids"]) for r in bpe.encode_documents(df, v).collect()]
    assert [x for x in got if x[0] == 1] == [(1, [])] and [x for x in got if x[0] == 2] == [(2, [])]
    assert [x for x in got if x[0] == 3] == [(3, tr.encode("hi there"))] * 2
    assert dict(got)[4] == tr.encode(long_)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(bpe.encode_documents(df, v), v).collect()}
    assert back[1] == "" and back[3] == "hi there" and back[4] == long_
    assert bpe.encode_documents(df.where("false"), v).count() == 0


def test_counts(spark, tr):
    v = bpe.Vocabulary(spark)
    rows = [(1, [("user", "hi there"), ("assistant", "hello you"), ("assistant", None)]), (1, [("user", "hi there"), ("assistant", "hello you"), ("assistant", None)]), (2, None), (3, []), (None, [("user", "x")]), (4, [(None, "one two three")])]
    ex = spark.createDataFrame(rows, "example_id long, messages array<struct<role:string,content:string>>")
    got = {r["doc_id"]: (r["tokens"], r["loss_tokens"]) for r in bpe.conversation_counts(ex, v).collect()}
    assert got == {1: (len(tr.encode("hi there")) + len(tr.encode("hello you")), len(tr.encode("hello you"))), 2: (0, 0), 3: (0, 0), 4: (3, 0)}
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hi there")], "doc_id long, text string")
    assert {tuple(r) for r in bpe.token_counts(df, v).collect()} == {(1, 0, 0), (2, 0, 0), (3, 2, 2)}
