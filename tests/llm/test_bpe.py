import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from classmeter.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def coder(ranks):
    return bpe.Coder(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed: bytes) -> list[int]:
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab '\n\tzééü")), max_size=200))
def test_ids_are_the_library_s(coder, library, text):
    packed = coder.encode([text])[0]
    assert ids(packed) == library.encode_ordinary(text)
    assert coder.decode([packed])[0] == text.encode()


@pytest.mark.parametrize("text", ["aaaaab" * 300, "the" * 500, "-" * 700, " " * 900 + "x", "ab" * 40, "<|endoftext|>", "é" * 260])
def test_long_pieces(coder, library, text):
    packed = coder.encode([text])[0]
    assert ids(packed) == library.encode_ordinary(text)
    assert coder.decode([packed])[0] == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdeth ing", min_size=1, max_size=60))
def test_a_heap_contracts_like_the_query(coder, ranks, text):
    whole = bpe.contract_long(text.encode(), ranks)
    coder.known.clear(), coder.new.clear()
    known = ids(coder.ids_of({text})[text])
    assert known == whole or known == [ranks.get(text.encode())]


def test_segments_do_not_change_the_ids(ranks, library):
    small = bpe.Coder(ranks, public_tokenizers.PATTERN, chunk=40)
    text = "It's  a text\n\n with   many  words, 123 numbers and   wide   gaps.  " * 9
    texts = [text, "", None, text[:77], "word" * 30]
    packed = small.encode(texts)
    assert [ids(p) for p in packed] == [library.encode_ordinary(t or "") for t in texts]
    assert small.decode(packed) == [(t or "").encode() for t in texts]


def test_columns(spark, edge_docs, no_docs, library):
    coder = bpe.ByteBpe(spark, PATH, public_tokenizers.PATTERN)
    for docs in (edge_docs, no_docs):
        out = docs.withColumn("ids", coder.encode(F.col("text"))).withColumn("back", coder.decode(F.col("ids")))
        both = coder.round_trip(F.col("text"))
        assert out.where(both["ids"] != F.col("ids")).count() == out.where(both["decoded"] != F.col("back")).count() == 0
        rows = out.select("text", "ids", "back", bpe.count(F.col("ids")).alias("n")).collect()
        assert len(rows) == docs.count()
        for r in rows:
            expected = library.encode_ordinary(r.text or "")
            assert ids(bytes(r.ids)) == expected and r.n == len(expected)
            assert bytes(r.back).decode() == (r.text or "")
    none = spark.createDataFrame([(None,)], "ids binary").select(coder.decode(F.col("ids")).alias("back"))
    assert bytes(none.first().back) == b""
