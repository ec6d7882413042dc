import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from spanrules.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def voc():
    return byte_bpe.vocabulary(RANKS)


def odd_texts():
    rng = random.Random(2)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x370, 0x400), 0x1680, 0x2000, 0x2028, 0x3000, 0x4E2D, 0x1F600]]
    out = ["", "   ", "\n\n a\n", "don't we'll I'M <|endoftext|>", "a" * 3000, "é" * 500, "\x00\x01", "٣٤ ½ ²"]
    out += ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    return out


def test_perfect_hash_is_minimal_and_exact(voc):
    assert sorted(voc["ids"]) == sorted(RANKS.values())
    assert all(byte_bpe.whole_token(k, voc) == i for k, i in RANKS.items())
    assert byte_bpe.whole_token(b"no such token at all", voc) is None
    assert byte_bpe.whole_token(b"x", byte_bpe.vocabulary({})) is None


def test_merges_match_the_reference_library(reference, voc):
    import regex

    pieces, cut = byte_bpe._Pieces(voc), regex.compile(public_tokenizers.PATTERN).findall
    texts = odd_texts()
    for text, ids in zip(texts, byte_bpe.encode_texts(texts, pieces, cut)):
        assert ids.tolist() == reference.encode_ordinary(text), repr(text)
        assert byte_bpe.decode_ids(ids, voc) == text.encode()


def test_heap_merges_equal_a_scan_for_the_lowest_rank():
    rng = random.Random(4)
    for _ in range(300):
        piece = bytes(rng.choice(b"aabcdehlnorst \xc3\xa9") for _ in range(rng.randrange(1, 24)))
        parts = [bytes([b]) for b in piece]
        while True:
            ranked = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert byte_bpe.merge(piece, RANKS) == [RANKS[p] for p in parts]


def test_digests(spark, reference):
    rows = [(i, t, i, "x") for i, t in enumerate([None, *odd_texts(), "same", "same"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    got = {r["doc_id"]: r for r in byte_bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_then_decode_frames(spark, reference):
    docs = spark.createDataFrame([(1, "Hello wörld"), (2, None)], "doc_id long, text string")
    ids = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert dict((r["doc_id"], r["ids"]) for r in ids.collect()) == {1: reference.encode_ordinary("Hello wörld"), 2: []}
    back = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(ids, PATH).collect()}
    assert back == {1: "Hello wörld".encode(), 2: b""}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.digests(docs, PATH, public_tokenizers.PATTERN).count() == 0
