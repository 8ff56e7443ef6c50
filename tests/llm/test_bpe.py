import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pulsegrid.llm.bpe_codec import Codec, bpe_decode, bpe_encode, encode_word
from pulsegrid.llm.queries import op5_token_counts, op9_bpe_codec
from pulsegrid.llm.token_counts import Counter, count_word, merged_ids, token_counts
from pulsegrid.llm.vocabulary import Vocabulary
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCAB = Vocabulary.parse(open(PATH, "rb").read())
ODD = ["", " ", "  a", "a  ", "\n\n x\t y ", "don't we'LL I'm", "é ü　 x", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "<|endoftext", "\U0001f600" * 9, "\0\x1c\x85", "1234 5,6", "x" * 5000, "ab" * 3000, "!!??" * 700]


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check(text)


def check(text):
    codec, ids = Codec(VOCAB), library(text)
    packed = codec.encode_text(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert codec.decode(packed) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert Counter(VOCAB).count(text) == len(ids)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80))
def test_heap_and_array_agree(word):
    ids = encode_word(word, VOCAB)
    assert ids == merged_ids(word, VOCAB) and count_word(word, VOCAB) == len(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_decoding_any_ids(ids):
    assert Codec(VOCAB).decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_a_small_memory_changes_nothing(monkeypatch):
    from pulsegrid.llm import vocabulary

    monkeypatch.setattr(vocabulary, "MEMORY_WORDS", 3)
    codec, text = Codec(VOCAB), "one two three four five one two six " * 5
    assert np.frombuffer(codec.encode_text(text), "<u4").tolist() == library(text)


def test_queries_against_the_library(spark):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    counts, coded = op5_token_counts(spark, DATA).collect(), op9_bpe_codec(spark, DATA).collect()
    assert len(counts) == len(coded) == len(texts)
    ids = {d: library(t) for d, t in texts.items()}
    for r in counts:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), len(ids[r.doc_id]), len(ids[r.doc_id]) > 512)
    for r in coded:
        mine = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(mine), hashlib.sha256(np.array(mine, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(mine, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "the same", 5), (3, "the same", 5), (4, "w " * 200_000, None)], "doc_id long, text string, n_tokens int")
    counted = token_counts(df, PATH)
    assert counted.columns == ["doc_id", "text", "n_tokens"]
    assert sorted(r.n_tokens for r in counted.collect()) == sorted([0, 0, *[len(library("the same"))] * 2, len(library("w " * 200_000))])
    back = bpe_decode(bpe_encode(df, PATH, decoded_col="again"), PATH, out_col="text2").collect()
    assert all(r.text2 == (r.text or "") == r.again and r.n_tokens * 4 == len(r.ids) for r in back)
    assert token_counts(df.limit(0), PATH).count() == 0 and bpe_encode(df.limit(0), PATH).count() == 0
