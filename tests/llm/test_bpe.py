import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from paperlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
OURS = bpe.ByteBpe(open(PATH, "rb").read())


def check(text):
    wanted = THEIRS.encode(text, add_special_tokens=False).ids
    ids = OURS.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == wanted
    assert OURS.decode(ids) == THEIRS.decode(wanted, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "", " ", "a" * 5_000, "ab<|endoftext|>cd <|endoftext|>", "一二x" * 3_000, " \t\n  '", "౜ ꟎ 're 123²",
    "\x00\x1c\x1f\x85", "don't I'Ll", "\U00010941\U0001f600",
])
def test_special_texts(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é'sdt\n\t  日本ñ<|>endoftext12²½౜\U00010941 ſ"), max_size=200))
def test_random_texts(text):
    check(text)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abcdeé es"), min_size=1, max_size=200))
def test_both_merges_agree(word):
    parts = [OURS.first[b] for b in word.encode()]
    assert OURS.merge(list(parts)) == OURS.merge_long(list(parts))


def test_documents_round_trip(documents, texts):
    found = bpe.decode(bpe.encode(documents, PATH), PATH).collect()
    assert {r["doc_id"]: r["decoded"] for r in found} == texts
    for r in found[:40]:
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == THEIRS.encode(r["text"], add_special_tokens=False).ids


def test_edges(edges, none):
    found = bpe.round_trip(edges, PATH).collect()
    assert len(found) == edges.count()
    assert all(r["n_tokens"] * 4 == len(r["token_ids"]) for r in found)
    assert [r["decoded"] for r in found if r["doc_id"] in (1, 2)] == ["", ""]
    assert bpe.encode(none, PATH).count() == 0
    assert set(bpe.encode(edges, PATH).columns) == set(edges.columns)
