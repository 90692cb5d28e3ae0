import hashlib

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import bpe
from loomspan.llm.common import Scratch

PATH, PATTERN = bpe.default_vocabulary()
RANKS = bpe.read_ranks(PATH)
CODEC = bpe.Codec(RANKS, PATTERN)
TRUTH = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return list(memoryview(CODEC.encode(text)).cast("I"))


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text("abtheinrgo' \n\t|$äéñ漢0123") | st.from_regex(r"(th|in|er|on){1,40}", fullmatch=True))
def test_encode_as_tiktoken_and_back(text):
    text = text.encode("utf-8", "replace").decode()
    packed = CODEC.encode(text)
    assert list(memoryview(packed).cast("I")) == TRUTH.encode_ordinary(text)
    assert "".join(CODEC.decode_stream(memoryview(packed).cast("I"))) == text
    assert "".join(CODEC.decode_stream(ids(text))) == text


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_machine_equals_whole_decoding(data, step):
    machine = bpe.Utf8()
    parts = [machine.push(data[i : i + step]) for i in range(0, len(data), step)]
    assert "".join(parts) + machine.push(b"", last=True) == data.decode("utf-8", "replace")


def test_checksum_comes_from_the_stream(monkeypatch):
    text = "the naïve 漢字 🙂 end"
    monkeypatch.setattr(bpe.Codec, "decode", None, raising=False)
    assert CODEC.decoded_sha256(CODEC.encode(text)) == hashlib.sha256(text.encode()).hexdigest()


def test_few_states_give_the_same_ids():
    small = bpe.Transducer(RANKS, max_states=5)
    for word in ("tokenization", "internationalisation" * 5, "ththththththin", "ß" * 9):
        assert small.encode(word.encode()) == [RANKS[x] for x in small.merge(word.encode())]


def test_states_are_live_boundaries_with_the_token_before(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    pieces = {piece.encode() for text in texts for piece in CODEC.find(text or "")}
    begins = {token[:i] for token in RANKS for i in range(len(token))}
    transducer, wanted = bpe.Transducer(RANKS), set()
    for prefix in {piece[:i] for piece in pieces for i in range(len(piece) + 1)}:
        live = [i for i in range(len(prefix) + 1) if prefix[i:] in begins]
        wanted.add(tuple((prefix[:i] and TRUTH._encode_single_piece(prefix[:i])[-1], prefix[i:]) for i in live))
    for piece in pieces:
        transducer.encode(piece)
    assert len(transducer.states) == len(wanted)


def test_frequent_pieces_stay_when_there_are_too_many(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PIECES", 8)
    codec, met = bpe.Codec(RANKS, PATTERN), []
    encode = codec.transducer.encode
    monkeypatch.setattr(codec.transducer, "encode", lambda piece: met.append(piece) or encode(piece))
    text = "".join(f" the {word}" for word in "abcdefghijklmnopqrstuvwxyz")
    assert list(memoryview(codec.encode(text)).cast("I")) == TRUTH.encode_ordinary(text)
    assert met.count(b" the") == 1 and len(codec.pieces) + len(codec.pieces.older) <= 8


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "the end", None), (4, "in " * 30000, "y"), (4, "in " * 30000, "y")], "doc_id long, text string, ids string")
    rows = bpe.encode_documents(docs, PATH, PATTERN, Scratch(spark, "t")).collect()
    assert sorted(r.n_tokens for r in rows)[:2] == [0, 0] and len(rows) == 5
    for r in rows:
        text = {1: "", 2: "", None: "the end", 4: "in " * 30000}[r.doc_id]
        assert r.ids == TRUTH.encode_ordinary(text) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), PATH, PATTERN, Scratch(spark, "t")).count() == 0


def test_query(spark, sf):
    got = {r.doc_id: r for r in bpe.op10_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = TRUTH.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in want)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


if __name__ == "__main__":
    pytest.main([__file__])
