"""Sources read from folders of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def html_items(spark: SparkSession, folder: str) -> DataFrame:
    """Id, html, text of each item under folder: NAME.html, or NAME-ch0.html, NAME-ch1.html, ... in order up to the first one missing; empty files count as missing."""
    raw = spark.read.text(f"{folder}/*.html", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:-ch(\d+))?\.html$", 1).alias("id"), F.regexp_extract(F.col("_metadata.file_name"), r"-ch(\d+)\.html$", 1).alias("n"), "value")
    parts = raw.groupBy("id").agg(F.max(F.when(F.col("n") == "", F.col("value"))).alias("single"), F.array_sort(F.collect_list(F.when(F.col("n") != "", F.struct(F.col("n").cast("int").alias("n"), F.col("value").alias("html"))))).alias("chapters"))
    # the n-th chapter is followed as long as its number is n
    whole = F.filter("chapters", lambda c, i: c["n"] == i)
    html = F.coalesce("single", F.array_join(F.transform(whole, lambda c: c["html"]), "\n"))
    found = parts.filter(F.col("single").isNotNull() | (F.size(whole) > 0))
    return found.select("id", html.alias("html"), T.html_to_text(html).alias("text"))


def _word(w: Column) -> Column:
    return F.lower(F.replace(F.regexp_replace(w, r"\(.*\)$", ""), F.lit("_"), F.lit(" ")))


def synsets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Offset, pos, words, definition, example of the lines of data files: offset, file, kind, a count in hex, words and numbers, | and a gloss."""
    lines = spark.read.text(paths).filter(~F.col("value").startswith(" ") & F.contains("value", F.lit(" | ")))
    head = F.split(F.trim(F.substring_index("value", " | ", 1)), r"\s+")
    gloss = F.transform(F.split(F.expr("substring(value, instr(value, ' | ') + 3)"), ";"), lambda p: F.trim(p))
    rows = lines.select(head.alias("h"), F.filter(gloss, lambda p: p != "").alias("g")).withColumn("n", F.conv(F.get("h", F.lit(3)), 16, 10).cast("int"))
    words = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: _word(F.get("h", 4 + i * 2)))
    quoted = F.filter("g", lambda p: p.startswith('"'))
    return rows.select(
        F.get("h", F.lit(0)).alias("offset"),
        F.when(F.get("h", F.lit(2)) == "s", "a").otherwise(F.get("h", F.lit(2))).alias("pos"),
        F.filter(words, lambda w: F.length(w) > 0).alias("words"),
        F.array_join(F.filter("g", lambda p: ~p.startswith('"')), "; ").alias("definition"),
        F.regexp_replace(F.get(quoted, F.lit(0)), r'^"+|"+$', "").alias("example"),
    )


def senses(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Word, pos, sense (from 1, the commonest first), offset of the lines of index files."""
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(paths).filter(~F.col("value").startswith(" ") & (F.trim("value") != "")).select(t.alias("t"))
    n, p = F.get("t", F.lit(2)).cast("int"), F.get("t", F.lit(3)).cast("int")
    offsets = rows.select(_word(F.get("t", F.lit(0))).alias("word"), F.get("t", F.lit(1)).alias("pos"), F.posexplode(F.slice("t", 7 + p, n)).alias("at", "offset"))
    return offsets.select("word", "pos", (F.col("at") + 1).alias("sense"), "offset")


def dictionary(senses: DataFrame, synsets: DataFrame) -> DataFrame:
    """The entries (word, pos, sense, definition, example, synonyms) of senses whose synset is there, ordered by word, pos and sense."""
    joined = senses.join(synsets, ["pos", "offset"])
    others = F.filter("words", lambda w: w != F.col("word"))
    return joined.select("word", "pos", "sense", "definition", "example", others.alias("synonyms")).orderBy("word", "pos", "sense")
