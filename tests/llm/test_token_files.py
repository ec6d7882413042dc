import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanrules.llm import token_files
from spanrules.llm.token_files import EliasFano, TokenFile

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def brute(rows):
    """(id, start, n, crc) of ``rows`` in the order given, by the library on whole texts."""
    out, start = [], 0
    for i, text in rows:
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect())


@pytest.mark.parametrize("values", [
    [], [0], [0, 0, 0], [7], [1 << 40], [0, 1 << 63], list(range(3000)), [5] * 2000 + [1 << 33] * 1500,
    list(np.cumsum(np.random.default_rng(1).integers(0, 5000, 5000)).tolist()),
    list(np.cumsum(np.random.default_rng(2).geometric(0.001, 1500)).tolist())])
def test_elias_fano(values):
    code = EliasFano.of(values)
    head, raw = code.parts()
    again = EliasFano.read(head, b"".join(raw))
    assert again.values().tolist() == values
    assert [again.select(i) for i in range(0, len(values), 7)] == values[::7]
    if len(values) > 1000:  # low bits, at most three bits of the unary part, and the samples
        assert sum(head["sizes"]) * 8 <= len(values) * (head["l"] + 3) + 64 + 32 * (len(values) // token_files.SAMPLE + 1)
    with pytest.raises(IndexError):
        again.select(len(values))


def test_must_ascend():
    with pytest.raises(ValueError):
        EliasFano.of([2, 1])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert got(token_files.round_trip(docs, PATH)) == sorted(brute(rows))


ODD = ["", None, " \t\n", "it's the Dog's. don't, we'LL 'em!? a.b,c ...,,", "x" * 5000 + " " + "y, " * 3000,
       "É́ ẽ ΣΑΣ ΣΑΣ. ΟΔΟΣ, ﬁ Ⅷ ² 12,345.67", " no break　wide​zero\u0085nel\x1cfs\x1fus",
       "á ́b İstanbul straße ẞ DŽ 日本語。한국어", "<|endoftext|> a<|startoftext|>b <|endoftext|>.", "A. B, c' D'S 's 'S's.",
       "emoji 👩‍👩‍👧 ok,", "tab\tline\r\nend\x0b\x0c.", "a'll. b!s c?'re, 1. 2, a1. é."]


def test_odd_texts(spark, tmp_path):
    data = [(i - 5, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in data], "doc_id long, text string, id string, part int")
    assert got(token_files.round_trip(docs, PATH)) == sorted(brute(data))
    out = str(tmp_path / "tokens")
    files = token_files.write(docs, PATH, out).collect()
    whole = token_files.documents(spark, out).orderBy("doc_id").collect()
    assert [r["ids"] for r in whole] == [[*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2] for _, t in data]
    # random access by select
    for f in files:
        file = TokenFile(f"{out}/{f['file']}")
        ids = file.doc_ids()
        for i in range(len(file)):
            a, b = file.bounds(i)
            assert file.ids(a, b).tolist() == whole[ids[i] + 5]["ids"]
        file.close()


def test_ties_nulls_and_many_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 20_000)
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta,", "gamma.", "δέλτα", "x1"]
    data = [(int(i), " ".join(rng.choice(words, rng.integers(0, 40)))) for i in rng.permutation(900)]
    data += [(7, "same id"), (7, None), (7, "same id"), *[(None, "no id")] * 400]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    rows = token_files.round_trip(docs, PATH).collect()
    assert len(rows) == len(data)
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted((i for i, _ in data), key=lambda i: (i is not None, i))
    want = sorted((str(i), n, c) for i, _, n, c in brute(data))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in rows) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.round_trip(docs, PATH).count() == 0


def test_other_file_is_refused(spark, tmp_path):
    path = tmp_path / "x.tok"
    path.write_bytes(b"0" * 100)
    with pytest.raises(ValueError):
        TokenFile(str(path))
