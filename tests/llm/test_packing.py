"""Packed pieces against ids of `tokenizers`."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import bpe, packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def checked(got, want, capacity=1024):
    """got: rows; want: lists of ids by doc_id (each row of its own). Returns the padded tokens."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    assert docs.keys() == want.keys()
    for doc, copies in want.items():
        ids, rows = copies[0], sorted(docs[doc], key=lambda r: r["start"])
        starts = [s for r in rows for s in range(r["start"], r["start"] + r["length"])]
        assert starts == sorted([*range(len(ids))] * len(copies)) if len(copies) == 1 else sorted(starts) == sorted([*range(len(ids))] * len(copies))
        for r in rows:
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert (r["doc_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(piece.tobytes())) and r["length"] > 0
    padded = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded


def test_vocabulary_of_the_file(tokenizer):
    assert packing.vocabulary(PATH) == bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_ids_are_those_of_the_library(tokenizer):
    import tiktoken

    own = tiktoken.Encoding("o", pat_str=public_tokenizers.PATTERN, mergeable_ranks=packing.vocabulary(PATH), special_tokens={})
    r = random.Random(1)
    odd = [9, 10, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x2028, 0x200B, 0x3000, 0xFEFF]
    for _ in range(3000):
        text = "".join(chr(r.choice([r.randrange(32, 127), r.choice(odd), r.randrange(0x80, 0x3000), r.randrange(0x3000, 0xD7FF), r.randrange(0x10000, 0x1FFFF)])) for _ in range(12))
        assert own.encode_ordinary(text) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("capacity", "slack"), [(1024, 8), (1024, 0), (16, 2), (1, 0)])
def test_parts_fill_their_class(capacity, slack):
    parts = packing.parts_of(capacity, slack)
    assert [sum(p) for p in parts] == [*range(capacity)]
    assert all(capacity - capacity // x * x <= slack for p in parts for x in p)


def test_sequences_lack_the_slack_at_most():
    r = random.Random(2)
    lengths = [r.choice([1, 2, 3, 512, 513, 700, 1023, 1024, 1025, 4096, 5000, r.randrange(1, 3000)]) for _ in range(3000)]
    packer = packing.Packer()
    rows = [x for i, n in enumerate(lengths) for x in packer.add(i, np.arange(n, dtype="<u4"))]
    held = sum(len(ids) for pieces in packer.open.values() for _, _, ids in pieces)
    rows += packer.rest()
    names = [f.split()[0] for f in packing.OUT.split(", ")]
    padded = checked([dict(zip(names, x, strict=True)) for x in rows], {i: [list(range(n))] for i, n in enumerate(lengths)})
    assert padded <= 8 * (packer.sequences - held // 1024) and padded < 0.005 * sum(lengths)
    # a class's sequences have a fixed number of documents
    full = defaultdict(list)
    for x in rows:
        full[x[5]].append(x[2])
    fixed = [s for s in full.values() if 1024 // max(s) == 1024 // min(s)]
    assert sum(len(s) == 1024 // s[0] for s in fixed) > 0.9 * len(full)


def test_rows(spark, tokenizer, monkeypatch):
    r = random.Random(3)
    texts = [None, "", " ", "x", "<|endoftext|> and more", "a" * 3000, "naïve  \n\n 日本語 🎉", "same text", "same text"]
    texts += [" ".join(r.choice(["the", "dragon", "ünï", "42", "x_y"]) for _ in range(r.randrange(1, 2500))) for _ in range(40)]
    rows = [(i, t, 5, "s", 1) for i, t in enumerate(texts)] + [(7, "same text", 1, "s", 1), (None, "no id", 2, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, ids string, length int").repartition(3)
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[i].append(ids_of(tokenizer, t))
    assert checked(packing.pack(docs, PATH).collect(), want) < 0.01 * sum(len(x) for c in want.values() for x in c)
    assert packing.pack(docs.limit(0), PATH).collect() == []
    # long texts are cut into pieces without effect on ids; a small capacity
    from quillspark.llm import bpe

    monkeypatch.setattr(bpe, "PIECE", 100)
    checked(packing.pack(docs, PATH, capacity=64, slack=2).collect(), want, 64)


def test_query(spark, tokenizer):
    data = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: [ids_of(tokenizer, r["text"])] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.op11_packing(spark, data).collect()
    assert checked(got, texts) < 0.005 * sum(len(x[0]) for x in texts.values())
