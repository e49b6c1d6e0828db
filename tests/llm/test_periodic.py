"""Runs against a search at every lag, and the cases the docstring defines."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quillspark.llm import periodic_runs


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(w)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(found), *four, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def sequences(r, count):
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a
    for i in range(count):
        n = r.randrange(160)
        unit = [r.randrange(1000) for _ in range(r.randrange(1, 40))]
        nested = [r.randrange(4) for _ in range(r.randrange(1, 5))] * r.randrange(1, 6) + [9]
        yield [[r.randrange(2) for _ in range(n)], [r.randrange(3) for _ in range(n)], ([7] * 5 + unit * 9)[:n], [1] * n, b[:n], (nested * 9)[:n] + [7] + nested * 3, [r.randrange(10**5) for _ in range(n)]][i % 7]


def test_runs_match_every_lag():
    """Several texts searched together, among them random, nested, Fibonacci and constant ones."""
    texts = list(sequences(random.Random(2), 420))
    for i in range(0, len(texts), 30):
        rows = [(None, np.array(w, np.int64), [str(x).encode() for x in range(10**5)]) for w in texts[i : i + 30]]
        assert [r[1:] for r in periodic_runs.searched(rows)] == [plain_row(None, " ".join(map(str, w)))[1:] for w in texts[i : i + 30]]


def test_transform_is_exact():
    for prime, generator in periodic_runs.PRIMES:
        x = np.array([[(i * i + 5) ** 3 % prime for i in range(16)], [prime - 1] * 16], np.uint64)
        y = periodic_runs.transform(x, prime, generator)
        root = pow(generator, (prime - 1) // 16, prime)
        assert y[0].tolist() == [sum(int(v) * pow(root, i * k, prime) for i, v in enumerate(x[0])) % prime for k in range(16)]
        assert (periodic_runs.transform(y, prime, generator, inverse=True) == x * np.uint64(16) % np.uint64(prime)).all()


def test_sums_beyond_a_prime_are_no_occurrences():
    """Blocks whose squared differences sum to a multiple of the first prime."""
    prime = periodic_runs.PRIMES[0][0]
    a, b = next((a, int((prime - a * a) ** 0.5)) for a in range(1, 40000) if a * a < prime and int((prime - a * a) ** 0.5) ** 2 == prime - a * a)
    words = np.array([0, 0, a, b, 10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3, 10**6 + 4, 10**6 + 5], np.uint64)
    assert periodic_runs._zeros(words, np.array([0]), 2, 1, 6, *periodic_runs.PRIMES[0])[0].any()
    assert len(periodic_runs.occurrences(words, np.array([0]), 2, 1, 6, 10**6 + 5)[0]) == 0


def test_long_texts_are_whole(monkeypatch):
    """A text of several pieces, with a run over half of it, one text a chunk."""
    monkeypatch.setattr(periodic_runs, "PIECE", 1000)
    r = random.Random(4)
    unit = [r.randrange(10**4) for _ in range(3000)]
    text = " ".join(map(str, [*(r.randrange(10**4) for _ in range(5000)), *unit, *unit, *unit[:700], 10**5]))
    words, names = periodic_runs.numbered(text.encode())
    assert [names[i].decode() for i in words] == text.split()
    assert next(periodic_runs.searched([(None, words, names)]))[1:6] == (1, 5000, 6700, 3000, 2233)
    # one word only, for which every distance of every scale is an occurrence
    ones = np.zeros(60_000, np.int64)
    assert next(periodic_runs.searched([(None, ones, [b"w"])]))[1:6] == (1, 0, 60_000, 1, 60_000_000)


@pytest.mark.parametrize("chunk", [1 << 19, 300])
def test_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(periodic_runs, "CHUNK_BYTES", chunk)
    r = random.Random(3)
    texts = [None, "", " \n\t ", "one", "a b " * 20, "a b " * 20, "x " * 11, "x " * 12, "ünï x \x85 ünï", "w" * 5000, " ".join(str(i) for i in range(400))]
    texts += [" ".join(map(str, w)) for w in sequences(r, 60)]
    rows = [(i, t, "en", 1, "k") for i, t in enumerate(texts)]
    rows += [rows[4], (None, "a b " * 20, None, 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string, n_runs int, words string").repartition(3)
    order = lambda rows: sorted(rows, key=repr)
    assert order(map(tuple, periodic_runs.find(docs).collect())) == order(plain_row(i, t) for i, t, *_ in rows)
    assert periodic_runs.find(docs.limit(0)).collect() == []


def test_query_matches_every_lag(spark):
    from quillspark.llm import queries

    data = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.op13_periodic_runs(spark, data).collect()
    assert len(got) == len(texts)
    short = [r for r in got if len(texts[r["doc_id"]] or "") < 8000]
    assert len(short) > 150 and all(tuple(r) == plain_row(r["doc_id"], texts[r["doc_id"]]) for r in short)
    assert any(r["n_runs"] for r in short)
