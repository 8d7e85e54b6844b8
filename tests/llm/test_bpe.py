import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from siltstone.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(PATH)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Codec(bpe.serialise_model(ranks), public_tokenizers.PATTERN), own


def test_same_ids_and_exact_round_trip(both):
    codec, own = both
    rng = random.Random(5)
    parts = [" ", "\n", "\t", "a", "é", "ß", "'s", "'LL", "12", "!!", "\x1c", "\x85", "\xa0", "漢字", "😀", "the", "ing", "\r\n", "▁", "<unk>", "\x00", "Ġ"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert codec.encode(text) == own.encode_ordinary(text)
        assert codec.decode(codec.encode(text)).decode() == text
    assert codec.encode("x" * 20_000) == own.encode_ordinary("x" * 20_000)


def test_every_bmp_character(both):
    codec, own = both
    for cp in [*range(0, 0xD800, 3), *range(0xE000, 0x10000, 3)]:
        text = f"a{chr(cp)} {chr(cp)}{chr(cp)}1 x"
        assert codec.encode(text) == own.encode_ordinary(text), hex(cp)


def test_a_gap_in_the_ranks_keeps_ids():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 301}
    codec = bpe.Codec(bpe.serialise_model(ranks), public_tokenizers.PATTERN)
    assert codec.encode("abcab") == [301, 300] and codec.encode("é") == [195, 169]


def test_query(spark, sf001, both):
    codec, own = both
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edges(spark, edge_docs, no_docs):
    rows = bpe.encode_decode(edge_docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == edge_docs.count()
    assert {r.doc_id: r.n_tokens for r in rows}[1] == 0 == {r.doc_id: r.n_tokens for r in rows}[2]
    assert bpe.encode_decode(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(edge_docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((r.doc_id or 0, r.text or "") for r in edge_docs.collect())
