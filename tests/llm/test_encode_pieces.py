"""Encoding against an installed tokenizer; pieces: limits, overlap, round trip."""

import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm.bpe import PATTERN, TOKENIZER_DIR, VOCABULARY, PrefixEncoder, load_vocabulary
from newsloom.llm.encode import encode_corpus
from newsloom.llm.pieces import Splitter, parse, split_oversized

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZER_DIR), reason="tokenizer files absent")
_encoder = None


def encoder():
    global _encoder
    if _encoder is None:
        _encoder = PrefixEncoder(load_vocabulary())
    return _encoder


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(f"{TOKENIZER_DIR}/{VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", " ", "\n\n", "Hello world", "a<|endoftext|>b", "x" * 5000, "Ünïcödé 中文字符 🙂🙃", "tab\tand\r\nlines  with   blanks ", "it's we'll I'd 12345 ... --- ###",
    " no-break space​", "😀" * 300, "supercalifragilisticexpialidocious" * 20,
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids(reference, text):
    assert encoder().encode(text) == reference.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abethinrsog '\n.1é😀", max_size=80))
def test_same_ids_on_any_text(text):
    import tiktoken

    ranks = {t: i for i, t in enumerate(load_vocabulary().tokens)}
    own = test_same_ids_on_any_text.__dict__.setdefault("t", tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
    text = text.encode("utf-8", "ignore").decode()
    assert encoder().encode(text) == own.encode_ordinary(text)


def test_corpus(spark):
    df = spark.createDataFrame([(1, "Hello world", 9), (2, "", 9), (3, None, 9), (1, "Hello world", 9), (None, "a", 9)], "doc_id long, text string, ids int")
    got = sorted(((r["doc_id"], r["ids"]) for r in encode_corpus(df).collect()), key=repr)
    assert got == sorted([(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, []), (None, [64])], key=repr)
    assert encode_corpus(df.limit(0)).count() == 0


LONG = [
    "\n\n".join(f"## Part {i}\n\n" + " ".join(f"Sentence number {j} of part {i} says little." for j in range(30)) for i in range(6)),
    "- item one\n" * 400,
    "| a | b |\n" * 500,
    "word " * 3000,
    "q8z" * 3000,
    "😀" * 1500,
    "Section 1. Title\n" + "Some long sentence without any end " * 200 + "\n\n> quote\n" + "é" * 4000,
    " " * 6000 + "x",
    "\n" * 5000,
]


@pytest.mark.parametrize("text", LONG)
@pytest.mark.parametrize(("limit", "overlap"), [(512, 64), (100, 0), (60, 20)])
def test_pieces(text, limit, overlap):
    out = Splitter(encoder(), limit, overlap).split(text)
    if len(encoder().encode(text)) <= limit:
        assert out == []
        return
    assert "".join(text[own:end] for _, own, end, _ in out) == text
    for start, own, end, n in out:
        assert start <= own < end and n == len(encoder().encode(text[start:end])) <= limit
    for before, after in zip(out, out[1:]):
        assert before[0] <= after[0] <= after[1] == before[2]
        assert len(encoder().encode(text[after[0] : after[1]])) <= overlap


def test_cuts_at_paragraphs():
    text = "\n\n".join(" ".join(f"Sentence {i} {j} goes on for a while here." for j in range(20)) for i in range(8))
    out = Splitter(encoder()).split(text)
    assert all(text[own - 2 : own] == "\n\n" for _, own, _, _ in out[1:])


def test_tree_nests_headings():
    root = parse("# A\ntext\n## B\nmore\n# C\nend")
    assert [len(n.children) for n in root.children] == [3, 2] and root.children[0].end == root.children[1].start


def test_small_texts_and_nulls(spark):
    df = spark.createDataFrame([(1, "short"), (2, None), (3, ""), (4, "word " * 2000), (4, "word " * 2000)], "doc_id long, text string")
    got = split_oversized(df).collect()
    assert {r["doc_id"] for r in got} == {4} and len({r["piece_no"] for r in got}) * 2 == len(got)
    assert split_oversized(df.limit(0)).count() == 0


def test_overlap_must_fit():
    with pytest.raises(ValueError):
        Splitter(encoder(), 64, 64)
