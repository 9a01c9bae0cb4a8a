import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.llm import encode as e

os.environ["TOKENIZERS_PARALLELISM"] = "false"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{e.TOKENIZERS}/byte_bpe_50k.json"), reason="no tokenizer files")
PIECES = []


def whole(texts):
    t = e.load(e.TOKENIZERS, "byte_bpe_50k")
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def ours(texts):
    if not PIECES:
        PIECES.append(e.Pieces(e.TOKENIZERS, "byte_bpe_50k"))
    ids, counts = e.encode_arrays(texts, PIECES[0])
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


TEXTS = ["'s 's it's I'll'd 'save ''s x 's\n's 'l 'r'", "\n\n a  b\t c \r\n", "  ", "a ", "'", "don't", "'re", "é́ ñ​ x ", "<|endoftext|> a", "\x1c\x1d a\x85b", "٣٤ Ⅷ ²", "日本語 テスト", "🙂🙂 👍🏽", "x　　y", " 'll", "'ll", "a'", "1's", "''ll", "x" * 5000, "a b " * 3000]


def test_same_as_the_library_on_whole_texts():
    assert ours(TEXTS) == whole(TEXTS)
    assert ours(["", "a", ""]) == [[], whole(["a"])[0], []]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'stremvl d 1\n\t .,é日🙂  _-"), max_size=30), min_size=1, max_size=5))
def test_random_texts(texts):
    assert ours(texts) == whole(texts)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    assert e.decode_ids(ours([text])[0]) == text


def test_frames(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", "x")], "k long, text string, ids string")
    got = sorted((r.k, list(r.ids)) for r in e.encode(df, "k", "text").collect())
    assert got == [(1, whole(["a b"])[0])] * 2 + [(2, []), (3, [])]
    assert sorted((r.k, r.n_tokens) for r in e.token_counts(df, "k", "text").collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert {r.k: r.text for r in e.decode(e.encode(df, "k", "text"), "k", "ids").collect()} == {1: "a b", 2: "", 3: ""}
    assert e.encode(df.limit(0), "k", "text").count() == 0


def test_offsets_are_those_of_the_library(spark):
    t = e.load(e.TOKENIZERS, "byte_bpe_50k")
    texts = [x for x in TEXTS if x] + ["", "naïve — 日本 🙂🙂x"]
    got = {r.k: r for r in e.encode_with_offsets(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k", "text").collect()}
    for k, text in enumerate(texts):
        r = got[k]
        assert list(r.ids) == ours([text])[0] and len(r.starts) == len(r.ends) == len(r.ids)
        for i, a, b in zip(r.ids, r.starts, r.ends):
            shown = e.decode_ids([i])
            assert 0 <= a < b <= len(text) and ("\ufffd" in shown or shown == text[a:b])
        assert all(a2 in (b1, b1 - 1) for b1, a2 in zip(r.ends, r.starts[1:])) and (not text or (r.starts[0], r.ends[-1]) == (0, len(text)))
    assert t.encode("a b", add_special_tokens=False).offsets[0] == (0, 1)


def test_ids_beyond_the_vocabulary_show():
    good = ours(["ab"])[0]
    assert e.decode_ids([10**6, *good, -1]) == "\ufffdab\ufffd" and e.decode_ids([]) == ""
