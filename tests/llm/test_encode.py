import os
import sys

import pytest

pytest.importorskip("tiktoken")
from tagloom.llm import encode as E  # noqa: E402

if not os.path.exists(E.VOCAB):
    pytest.skip("no vocabulary", allow_module_level=True)

TEXTS = ["", "x", "a  b\n\n\n c\t\td", "don't we'll I'm 'S", "ünïcödé 日本語 тест ½ Ⅷ ² 123abc", "a\u0301 \u00a0 \u2003x\x1cy\x85z", " " * 700 + "end", "word" * 400, "😀👨‍👩‍👧 <|endoftext|>", "\r\n\r\n  if (x) {\r\n", "a\n\n" * 300, "tab\t\t\n   \n x " * 90]


def whole(text):
    return E._encoder(E.VOCAB)[0].encode_ordinary(text)


@pytest.mark.parametrize("text", TEXTS)
def test_segments_give_the_ids_of_the_whole(text):
    assert E.encode_text(text) == whole(text) and E.count_tokens(text) == len(whole(text)) and E.decode_ids(whole(text)) == text


def test_random_texts():
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.sampled_from(list("ab Z9'st_-.\n\t\r\u00a0é日½\u0301😀\x1c")), max_size=80))
    def go(text):
        assert E.encode_text(text) == whole(text)

    go()


@pytest.mark.parametrize(("chunk", "overlap"), [(4096, 512), (60, 20), (7, 3), (20, 1)])
def test_chunks(spark, chunk, overlap):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None, *(t * 5 for t in TEXTS)])]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in E.encode(d, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: whole(t or "") for i, t, _ in rows}


def test_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in E.decode(E.encode(d)).collect()} == {1: "a b", 2: "", 3: ""}
    assert E.encode(d.limit(0)).count() == 0
    assert {r.doc_id: r.tokens for r in E.token_counts(d, ["doc_id"]).collect()} == {1: 2, 2: 0, 3: 0}


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(E, "CACHE_ENTRIES", 5)
    s = E._Segments(lambda x: [len(x)])
    for i in range(50):
        assert s[f"w{i}"]
    assert len(s) <= 5 and s["x" * 100] == [100] and "x" * 100 not in s


assert sys
