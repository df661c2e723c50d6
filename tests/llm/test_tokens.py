import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as s

from sheaf.llm import tokens

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TRIE = tokens.encoder("byte_bpe_50k", tokens.FOLDER)


def ids(text):
    ws = tokens.words(text)
    assert "".join(ws) == text
    distinct = sorted({w.encode() for w in ws})
    known = dict(zip(distinct, TRIE.encode_all(distinct)))
    return [i for w in ws for i in known[w.encode()]]


@settings(max_examples=300, deadline=None)
@given(s.text(alphabet=s.one_of(s.characters(max_codepoint=0x24F), s.sampled_from("é漢字かなتا🙂🏽\u200b\u00a0\u3000 \n\t'")), max_size=80))
def test_ids_equal_the_reference_library(reference, text):
    assert ids(text) == reference.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(s.text(max_size=60))
def test_round_trip(reference, text):
    text = text.encode("utf-8", "ignore").decode()
    assert reference.decode(ids(text)) == text


def test_special_looking_text_is_ordinary(spark):
    df = spark.createDataFrame([(1, "<|endoftext|>"), (2, None), (3, "")], "doc_id long, text string")
    out = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert 50256 not in out[1] and len(out[1]) > 1 and out[2] == [] and out[3] == []


def test_a_small_memory_changes_no_ids(reference):
    import pyarrow as pa

    texts = [f"word{i} and wört{i % 7} 漢字{i}" * 3 for i in range(4100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    tokens._known.cache_clear()
    out = [x for b in tokens._encode("byte_bpe_50k", tokens.FOLDER, 100)(iter([batch])) for x in b.column(1).to_pylist()]
    assert out == [reference.encode_ordinary(t) for t in texts]
    known = tokens._known("byte_bpe_50k", tokens.FOLDER)
    assert known.trie.pairs and len(known.number) < 4000
