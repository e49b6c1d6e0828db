import hashlib

import public_tokenizers
import pytest
import tiktoken

from quillspark.llm import bpe

RANKS = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
TEXTS = ["", "Hello world, it's 2024!", "naïve  \n\n façade\t\x1c \x85 x y", "a" * 5000, "日本語テキスト 🎉🎉", "'S 'll don't  ", "\x00\x1f  z", "ab \r\n cd", "x y " * 3, "Straße ١٢٣ ½²"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_hash_is_minimal_and_perfect():
    v = bpe.Vocabulary.build(RANKS)
    assert len(v.ranks) == len(RANKS) and v.ends[-1] == sum(map(len, RANKS)) and all(v.rank(k) == r for k, r in RANKS.items())
    assert v.rank(b"not a token at all") is None
    assert bpe.Vocabulary.build({}).rank(b"a") is None


def test_long_texts_are_cut_without_effect(monkeypatch, reference):
    monkeypatch.setattr(bpe, "PIECE", 50)
    import regex

    text = " ".join(TEXTS) * 5
    memory = bpe._Memory(bpe.Vocabulary.build(RANKS))
    assert bpe.tokens(text, regex.compile(public_tokenizers.PATTERN), memory).tolist() == reference.encode_ordinary(text)


def test_round_trip(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None, TEXTS[1]])] + [(None, "null id", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect() == []


def test_other_patterns_are_never_cut(monkeypatch):
    """A pattern that spans blanks between letters, on a text longer than a piece."""
    import regex

    monkeypatch.setattr(bpe, "PIECE", 20)
    pattern = r"(?:\p{L}+ ?)+|."
    text = "many words in one match " * 9
    plain = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    assert bpe.tokens(text, regex.compile(pattern), bpe._Memory(bpe.Vocabulary.build(RANKS))).tolist() == plain.encode_ordinary(text)


def test_remembered_tables_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    memory = bpe._Memory(bpe.Vocabulary.build(RANKS))
    for i in range(500):
        memory[f"qzx{i}jk"]
    assert len(memory) <= 50 and len(memory.of_parts) <= 50
