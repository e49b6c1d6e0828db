"""The pipeline against plain versions of its stages, and its odd inputs."""

import hashlib
import random
import warnings

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import bpe, mixing, quality_classifier

from .test_operators import split

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture_rows(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    rows, passage = [], " ".join(word() for _ in range(60))
    for i in range(70):
        text = " ".join(word() for _ in range(r.randint(1, 120)))
        if i % 5 == 0:
            text += " " + passage + " " + " ".join(word() for _ in range(40))
        if i % 7 == 3:
            text = "### $$$ " * r.randint(5, 40)
        rows.append([i, text, r.choice(["en", "fr", None]), r.choice(["a", "b", "c", None]), len(text)])
    for i in range(70, 90):
        text = rows[i - 60][1]
        if i % 2:
            w = text.split(" ")
            w[len(w) // 2] = word()
            text = " ".join(w)
        rows.append([i, text, "en", "a", len(text)])
    return [tuple(x) for x in [*rows, (90, None, "en", "a", 0), (91, "", None, None, 0), (92, "x", "fr", "b", 1)]]


def near_copies(rows, k=5):
    sets = {}
    for i, t, *_ in rows:
        w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    up = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((up[a], up[b]))
                up = {i: x if c == y else c for i, c in up.items()}
    return [x for x in rows if up[x[0]] == x[0]]


def without_passages(rows):
    seen, out = {}, []
    for i, t, lang, source, n in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if seen.setdefault(b[j : j + 50], i) < i:
                gone[j : j + 50] = True
        if not gone.any():
            out.append((i, t, lang, source, n))
            continue
        kept, at = "", 0
        for c in t:
            size = len(c.encode())
            if not gone[at : at + size].all():
                kept += c
            at += size
        if kept:
            out.append((i, kept, lang, source, len(kept)))
    return out


def test_run_matches_plain_stages(spark, tmp_path):
    rows = fixture_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(not (t or "").startswith("###")), 0) for i, t, *_ in rows if i % 2], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

        model = quality_classifier.train(df, labels)
        scores = model.predict(np.concatenate([quality_classifier.statistics(pa.array([t], pa.string())) for _, t, *_ in rows]))
        kept = [x for x, s in zip(rows, scores, strict=True) if s >= 0.3]
        assert 0 < len(kept) < len(rows)
        single = near_copies(kept)
        assert len(single) < len(kept)
        rest = without_passages(single)
        assert sum(len(x[1] or "") for x in rest) < sum(len(x[1] or "") for x in single)

        topics = mixing.learn_topics(spark.createDataFrame(rest, SCHEMA))
        topic = topics.nearest(pa.array([x[1] for x in rest], pa.string()))[1]
        tokens = np.array([-(-len((x[1] or "").encode()) // 4) for x in rest], float)
        cell = [(x[3], x[2], int(t)) for x, t in zip(rest, topic, strict=True)]
        names = sorted(set(cell), key=str)
        n = np.bincount([names.index(c) for c in cell], tokens)
        index, target = [], []
        for k in range(3):
            own = np.unique([str(c[k]) for c in names], return_inverse=True)[1].ravel()
            most = np.bincount(own, n)
            share = most**0.7 / (most**0.7).sum()
            low, high = 0.0, 1e6
            for _ in range(200):
                middle = (low + high) / 2
                low, high = (middle, high) if np.minimum(most, middle * share).sum() < 0.8 * n.sum() else (low, middle)
            index.append(own)
            target.append(np.minimum(most, high * share))
        weight, _ = mixing.rake(n, index, target)
        probability = {c: 1.0 if m == 0 else min(1.0, w) for c, w, m in zip(names, weight, n, strict=True)}
    ids = spark.createDataFrame([(x[0],) for x in rest], "doc_id long")
    draw = {r[0]: r[1] for r in ids.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)).collect()}
    want = {x[0]: x[1] or "" for x, c in zip(rest, cell, strict=True) if draw[x[0]] < probability[c]}
    close = {x[0] for x, c in zip(rest, cell, strict=True) if abs(draw[x[0]] - probability[c]) < 1e-4}
    assert set(got) - close == set(want) - close and len(want) > 10
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i in set(got) & set(want):
        tokens = plain.encode_ordinary(want[i])
        assert got[i]["n_tokens"] == len(tokens) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(want[i].encode()).hexdigest()


CLASHES = "score kept row document spans tokens topic weight probability cell s l t met v c key bucket a b g n ids decoded n_removed n_bytes rest quality h x y id".split()


@pytest.mark.filterwarnings("ignore")
def test_columns_of_any_name_and_odd_rows_pass(spark, tmp_path):
    """Columns named like inner ones, nulls in all columns, equal rows, a long text; then an empty table."""
    rows = [x for x in fixture_rows() if x[0] % 3 == 0] + [(None, "no id at all, but quite some words here", None, None, None)] * 2 + [(200, None, None, None, None)] * 2 + [(201, "long text. " * 30000, "en", "a", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)), F.struct(F.lit(1).alias("p q"), F.lit(None).cast("array<string>").alias("r")).alias("odd name"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 90, 3)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, str(tmp_path))
            assert out.columns == docs.columns, name
            path = str(tmp_path / f"{name}{table is docs}")
            out.write.parquet(path)
            at = spark.read.parquet(path)
            assert at.schema["odd name"].dataType.simpleString() == docs.schema["odd name"].dataType.simpleString()
            if table is docs and name != "mixture":
                assert at.filter("doc_id IS NULL").count() in (0, 2)
        assert corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count() == at.count()
        assert table is docs or at.count() == 0
