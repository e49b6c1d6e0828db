"""Search against walks over texts."""

import random
import re
import unicodedata

import pytest

from quillspark.functions.stem import stem
from quillspark.operators import search

TEXTS = ["A tale of Dragons and knights", "The dragon's relational café; knighted", "Cafés running, ran, runs", None, "", "drag queens AND kings", "knight " * 30 + "dragon"]


def words(t):
    folded = "".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if not 0x300 <= ord(c) <= 0x36F)
    return [w for w in re.split(r"[\W_]+", folded) if w]


@pytest.fixture(scope="module", params=[False, True])
def index(spark, request):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    return search.built(docs, "id", ["text"], stems=request.param)


def test_stems():
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal hopefulness hope formaliti formal triplicate triplic formative form electrical electr revival reviv adjustment adjust adoption adopt effective effect probate probat rate rate cease ceas controll control roll roll".split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]
    assert stem("ab") == "ab" and stem("café") == "café" and stem("") == ""


def has(fields, phrase, s):
    """How often the phrase stands in the fields (name to words)."""
    n = 0
    for name, own in fields.items():
        own = [s(w) for w in own]
        for i in range(len(own) - len(phrase.words) + 1):
            window = own[i : i + len(phrase.words)]
            last = window[-1].startswith(phrase.words[-1]) if phrase.prefix else window[-1] == phrase.words[-1]
            n += phrase.field in (None, name) and window[:-1] == [*phrase.words[:-1]] and last
    return n


def walked(docs, query, stems):
    options = search.alternatives(query, stems)
    s = stem if stems else str
    return {i for i, fields in docs.items() if options and any(all(has(fields, p, s) for p in want) and not any(all(has(fields, p, s) for p in g) for g in bar) for want, bar in options)}


MALFORMED = ('"unbalanced', "AND drag", "drag OR", "a NOT", "", "drag AND OR x", "x,y", "(a b)", "a NOT NOT b", '"..."')


@pytest.mark.parametrize("query", ["drag", "dragon knight", '"dragon"', 'knight NOT "dragon"', "cafe OR queens", "café", "tale AND dragons OR runs", "a NOT tale knights", *MALFORMED])
def test_queries_match_a_walk(index, query):
    want = walked({i: {"text": words(t)} for i, t in enumerate(TEXTS)}, query, index.stems)
    assert {r["id"] for r in search.matching(index, query).collect()} == want
    assert {r["id"] for r in search.ranked(index, query).collect()} == want
    assert (search.alternatives(query, index.stems) is None) == (query in MALFORMED)


TITLED = [
    (0, "The Dragon Knight", "a knight of dragons"), (1, "Knight", "the dragon. Knight rides"), (2, "dragon", "knight"), (3, "A b", "a b c a b d"),
    (4, None, "b a c, b"), (5, "tale of the dragon's knight", None), (6, "", ""), (7, "Café Łódź", "the cafe\u0301 łódź dragon knightly"),
]
PHRASES = [
    '"dragon knight"', '"dragon knight" AND a', '"a b c"', '"a b" NOT d', '"a b" NOT "b c"', "title:dragon", "title:drag knight", 'title:"dragon knight"', 'text:"dragon knight" OR title:tale',
    '"dragon\'s knight"', '"the dragon" kni', '"b a"', "title : knight", '"café łódź"', "cafe lodz", 'a OR "b a" NOT c', "no_such:dragon", "dragon and knight", '"a b" *',
]


@pytest.fixture(scope="module", params=[False, True])
def titled(spark, request):
    return search.built(spark.createDataFrame(TITLED, "id long, title string, text string"), "id", ["title", "text"], stems=request.param)


@pytest.mark.parametrize("query", PHRASES)
def test_phrases_match_a_walk(titled, query):
    """Phrases stand in one field, in order; the last word of a phrase of several is a prefix, as the query's rewriting leaves it."""
    docs = {i: {"title": words(a), "text": words(b)} for i, a, b in TITLED}
    want = walked(docs, query, titled.stems)
    assert {r["id"] for r in search.matching(titled, query).collect()} == want
    assert {r["id"] for r in search.ranked(titled, query).collect()} == want
    if query in ('"dragon knight"', '"a b c"', "title:drag knight", 'text:"dragon knight" OR title:tale', '"the dragon" kni', '"café łódź"'):
        assert want


def test_phrases_are_counted(spark):
    docs = spark.createDataFrame([(0, "x y x y x y", 1), (1, "x y z", 1), (2, "y x", 1)], "id long, text string, places int")
    index = search.built(docs, "id", ["text"])
    assert {r["id"]: r["f0"] for r in search._counted(index, [search.Phrase(("x", "y"))]).collect()} == {0: 3, 1: 1, 2: 0}
    assert [r["id"] for r in search.ranked(index, '"x y"').orderBy("score", ascending=False).collect()] == [0, 1]


PLACES = ["Café, cafe\u0301 CAFE caff\u0065", "Łódź łó\u0301dź", "İstanbul istanbul", "aaaa", "a.b a+b", None, "", "no"]


@pytest.mark.parametrize("needle", ["café", "cafe", "CAFE", "łódź", "istan", "aa", "a+b", "x"])
def test_places_are_of_the_text_itself(spark, needle):
    fold = lambda c: "".join(x for x in unicodedata.normalize("NFD", c.lower()) if not 0x300 <= ord(x) <= 0x36F)
    want = set()
    for i, t in enumerate(PLACES):
        chars = [(fold(c), at) for at, c in enumerate(t or "")]
        flat, of = "".join(f for f, _ in chars), [at for f, at in chars for _ in f]
        at, n = flat.find(fold(needle)), 0
        while len(needle) > 1 and at >= 0:
            end = at + len(fold(needle))
            start, stop, n = of[at], of[end - 1] + 1, n + 1
            while stop < len(t) and not fold(t[stop]):
                stop += 1
            want.add((i, n, start, stop - start))
            at = flat.find(fold(needle), end)
    docs = spark.createDataFrame([*enumerate(PLACES)], "id long, text string")
    assert set(map(tuple, search.places(docs, "id", "text", needle).collect())) == want


def test_more_hits_rank_higher(index):
    found = {r["id"]: r["score"] for r in search.ranked(index, "queens OR knight").collect()}
    assert found[5] > found[6] > 0


def test_folding(spark):
    df = spark.createDataFrame([(t,) for t in ("Ärger Éa", None, "ß")], "t string")
    assert [r[0] for r in df.select(search.folded("t")).collect()] == ["arger ea", None, "ß"]


def test_a_stored_index_equals_a_rebuilt_one(spark, tmp_path):
    """Batches that add, replace and remove texts, with merges in between; reopened by its path."""
    from quillspark.operators import text_index

    r = random.Random(3)
    say = lambda: " ".join(r.choice("dragon knight the a café tale of king".split()) for _ in range(r.randrange(1, 12)))
    folder, now = str(tmp_path / "index"), {}
    index = text_index.create(spark, folder, "doc", ["title", "text"])
    assert search.matching(index.index(), "dragon").collect() == [] and search.ranked(index.index(), "dragon").collect() == []
    sizes = []
    for step in range(7):
        batch = {i: (say() if i % 3 else None, say()) for i in r.sample(range(60), 25 if step == 0 else 6)}
        index = index.add(spark.createDataFrame([(i, *t, 1) for i, t in batch.items()], "doc long, title string, text string, length int"))
        now |= batch
        gone = r.sample(range(70), 4)
        index = index.remove(spark.createDataFrame([(i,) for i in [*gone, gone[0]]], "id long"))
        now = {i: t for i, t in now.items() if i not in gone}
        if step in (2, 5):
            index = index.merge()
        index = text_index.opened(spark, folder)
        sizes.append(len(index.segments))
        whole = search.built(spark.createDataFrame([(i, *t) for i, t in now.items()], "doc long, title string, text string"), "doc", ["title", "text"])
        stored = index.index()
        n, total = whole.lengths.agg({"*": "count", "length": "sum"}).select("count(1)", "sum(length)").first()
        assert stored.totals == (n, total)
        assert sorted(map(tuple, stored.lengths.collect())) == sorted(map(tuple, whole.lengths.collect()))
        if step in (1, 3, 6):
            assert sorted(map(str, stored.postings.collect())) == sorted(map(str, whole.postings.collect()))
            for query in ('"dragon knight"', "caf NOT king", "title:tale OR the"):
                assert dict(search.ranked(stored, query).collect()) == pytest.approx(dict(search.ranked(whole, query).collect()))
    one = index.merge(10**6)
    assert sizes[2] < 3 and sizes[5] < sizes[4] and len(one.segments) == 1 and one.marks == ()
    assert sorted(map(str, one.index().postings.collect())) == sorted(map(str, whole.postings.collect()))


def test_a_stored_index_is_scanned_by_term(spark, tmp_path):
    from quillspark.operators import text_index

    docs = spark.createDataFrame([(1, "x y"), (2, "z")], "id long, text string")
    index = text_index.create(spark, str(tmp_path / "i"), "id", ["text"]).add(docs).add(docs.filter("id = 1")).remove(docs.select("id").limit(1))
    plan = search.matching(index.index(), '"x y" OR z')._jdf.queryExecution().toString()
    assert plan.count("EqualTo(term,x)") >= 2 and "StringStartsWith(term,z)" in plan  # in the scans of both segments
    # of two writers of one version, the second fails and changes nothing
    again = text_index.opened(spark, str(tmp_path / "i"))
    again.add(docs)
    with pytest.raises(Exception, match="(?i)exist"):
        again.remove(docs.select("id"))
    last = text_index.opened(spark, str(tmp_path / "i"))
    assert len(last.segments) == 3 and last.index().lengths.count() == last.n == 2


@pytest.mark.parametrize("stems", [False, True])
def test_postings_are_grouped_where_texts_are_read(spark, monkeypatch, stems):
    """No term is shuffled, runs are sorted by term, and first counts each text of a term once, over several runs of a task."""
    monkeypatch.setattr(search, "RUN", 1)
    monkeypatch.setattr(search, "READ", 100)
    r = random.Random(5)
    say = lambda: " ".join(r.choice("Running runs Café cafe\u0301 of the The king \u0301 z".split()) for _ in range(r.randrange(0, 30)))
    docs = spark.createDataFrame([(i, say() if i % 4 else None, say()) for i in range(300)], "id long, title string, text string").coalesce(1)
    postings = search.term_postings(docs, "id", ["title", "text"], stems)
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    want = {}
    for row in docs.collect():
        for name in ("title", "text"):
            for at, w in enumerate(words(row[name])):
                want.setdefault((stem(w) if stems else w, name, row["id"]), []).append(at)
    rows = postings.collect()
    assert {(x["term"], x["field"], x["id"]): x["places"] for x in rows} == want and len(rows) == len(want)
    assert all(x["tf"] == len(x["places"]) and x["first"] == (x["field"] == "title" or (x["term"], "title", x["id"]) not in want) for x in rows)
    monkeypatch.setattr(search, "RUN", 1 << 20)
    whole = [x["term"] for x in search.sorted_postings(postings.repartition(1)).collect()]
    assert whole == sorted(x["term"] for x in rows)
