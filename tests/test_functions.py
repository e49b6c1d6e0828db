from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import library, merge


def test_text_functions(spark):
    df = spark.createDataFrame([("<p>A &amp; B</p><script>x</script>", "HTTP://A.org/B/#c", "  Ab, c! ", None)], "h string, u string, n string, z string")
    r = df.select(T.html_to_text(F.col("h")), T.canonical_url(F.col("u")), T.norm(F.col("n")), T.word_count(F.col("z")), T.word_count(F.col("n"))).first()
    assert tuple(r) == ("A & B", "http://a.org/B", "ab c", 0, 2)


def test_ratings_are_clamped(spark):
    df = spark.createDataFrame([(float("nan"),), (7.0,), (-1.0,), (3.3,), (None,)], "x double")
    assert [r[0] for r in df.select(T.clamp_rating(F.col("x"))).collect()] == [None, 5.0, 0.0, 3.5, None]


def test_containment_is_per_owned_title(spark):
    c = spark.createDataFrame([(1, "Silver Sea"), (2, "Silver Moon"), (3, "Sea"), (4, "")], "id long, title string")
    o = spark.createDataFrame([(9, "The Silver Sea Rises"), (8, "Moon")], "id long, title string")
    assert sorted(r["id"] for r in library.not_contained(c, o).collect()) == [2, 3, 4]


def test_pull_plan(spark):
    local = spark.createDataFrame([(1, "a", 5, 10, False), (2, "b", 5, 10, True), (3, "c", 9, 10, False)], "k long, v string, m long, updated_at long, dirty boolean")
    remote = spark.createDataFrame([(1, "x", 4, 11), (2, "x", 7, 99), (3, "x", 1, None), (4, "x", 1, 1)], "k long, v string, m long, updated_at long")
    got = {r["k"]: (r["action"], r["v"], r["m"]) for r in merge.plan_pull(local, remote, "k", ["v", "m"], ("m",)).collect()}
    assert got == {1: ("merge", "x", 5), 2: ("skip_dirty", "b", 7), 3: ("keep", "c", 9), 4: ("apply", "x", 1)}
