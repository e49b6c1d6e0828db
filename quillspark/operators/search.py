"""Full-text search: positional postings by term, prefix, phrase and boolean queries, BM25, finding within texts, dictionary lookup."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stem
from ..functions.text import folded, folded_name
from ..tables import few, written


@dataclass(frozen=True)
class Index:
    """K1: postings (term, field, id, tf, places, first), a table in runs sorted by term, so that a scan reads few row groups; lengths (id,
    length); whether terms are stems; how many texts there are and their terms, if known."""

    postings: DataFrame
    lengths: DataFrame
    stems: bool = False
    totals: tuple[int, int] | None = None


#: What parts two terms: neither letters nor numbers, nor marks that folding takes away.
GAP = r"[^\p{L}\p{N}\u0300-\u036F]+"


#: Bytes of terms that a task sorts at once: a run of postings, several row groups of a stored index.
RUN = 32 << 20
#: Texts of a batch that Python gets, and postings of one that it gives back.
READ, GIVEN = 500, 20_000


def terms(text: Column) -> Column:
    """The folded terms of a text. Letters fold to letters, and what vanishes parts no terms, so texts are folded before they are split;
    those in ASCII needn't be."""
    plain = F.lower(text)
    return F.filter(F.split(F.when(plain.rlike(r"[^\x00-\x7F]"), folded(plain)).otherwise(plain), GAP), lambda t: t != "")


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The batches, joined until they have that many bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _coded(words: pa.Array, stems: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Words as numbers into a sorted list of the different ones (or of their stems), and that list."""
    coded = words.dictionary_encode()
    codes, known = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    if stems:
        coded = pa.array(map(stem, known.to_pylist()), pa.string()).dictionary_encode()
        codes, known = coded.indices.to_numpy(zero_copy_only=False)[codes], coded.dictionary
    order = pc.sort_indices(known)
    rank = np.empty(len(known), np.int64)
    rank[order.to_numpy()] = np.arange(len(known))
    return rank[codes], known.take(order)


def _grouped(run: pa.Table, fields: list[str], stems: bool) -> pa.Table:
    """The postings of the texts of a run (id, the terms of each field), sorted by term."""
    words, at, place = [], [], []
    for k, column in enumerate(run.columns[1:]):
        for lists, first in zip(column.chunks, np.cumsum([0, *(len(c) for c in column.chunks)]), strict=False):
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            words.append(lists.flatten())
            at.append((first + np.repeat(np.arange(len(n)), n)) * len(fields) + k)
            place.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    codes, known = _coded(pa.concat_arrays(words), stems)
    span = run.num_rows * len(fields)
    where = codes * span + np.concatenate(at)
    order = np.argsort(where, kind="stable")
    where = where[order]
    starts = np.flatnonzero(np.diff(where, prepend=-1))
    bounds = np.append(starts, len(where))
    text = where[starts] // len(fields)  # of a term
    columns = {
        "term": known.take(pa.array(where[starts] // span)),
        "field": pa.array(fields, pa.string()).take(pa.array(where[starts] % len(fields))),
        "id": run.column(0).take(pa.array(where[starts] % span // len(fields))),
        "tf": pa.array(np.diff(bounds)),
        "places": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(place)[order], pa.int32())),
        "first": pa.array(np.diff(text, prepend=-1) != 0),
    }
    return pa.table(columns)


def term_postings(docs: DataFrame, key: str, fields: list[str], stems: bool = False) -> DataFrame:
    """K1: term, field, id, tf, places (numbers of the terms of the field, from 0), first (whether no field before this one has the term
    in this text), in runs sorted by term. Texts are split in the JVM; a task groups the terms of its own texts, nothing is shuffled."""
    fields, id_type = list(fields), docs.select(key).dtypes[0][1]
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(READ))
    split = docs.select(F.col(key).alias("id"), *(terms(F.coalesce(f, F.lit(""))).alias(f"_{f}") for f in fields))

    def grouped(batches: Iterator[pa.RecordBatch], most=RUN) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, most):
            if run.num_rows:
                yield from _grouped(run, fields, stems).to_batches(GIVEN)

    return split.mapInArrow(grouped, postings_schema(id_type))


def postings_schema(id_type: str) -> str:
    return f"term string, field string, id {id_type}, tf long, places array<int>, first boolean"


def sorted_postings(postings: DataFrame) -> DataFrame:
    """Postings in runs sorted by term, each as large as a task may hold; nothing is shuffled."""

    def ordered(batches: Iterator[pa.RecordBatch], most=RUN) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, most):
            if run.num_rows:
                codes, _ = _coded(pa.concat_arrays(run.column("term").chunks))
                yield from run.take(pa.array(np.argsort(codes, kind="stable"))).to_batches(GIVEN)

    return postings.mapInArrow(ordered, postings.schema)


def text_lengths(docs: DataFrame, key: str, postings: DataFrame) -> DataFrame:
    """id, length (terms) of each row of docs."""
    held = postings.groupBy("id").agg(F.sum("tf").alias("length"))
    return docs.select(F.col(key).alias("id")).join(held, "id", "left").select("id", F.coalesce("length", F.lit(0)).alias("length"))


def built(docs: DataFrame, key: str, fields: list[str], stems: bool = False) -> Index:
    """K1: the index of the fields of docs; written once, for many queries. With stems, English inflections of a word are one term."""
    postings = written(term_postings(docs, key, fields, stems))
    return Index(postings, written(text_lengths(docs, key, postings)), stems)


#: Ids of texts replaced or removed that are broadcast, at most; beyond that, postings are shuffled by their ids to leave these out.
MARKED = 1 << 21


def replaced(index: Index, gone: DataFrame, new: Index | None = None) -> Index:
    """K4: index without the rows of gone (id), and with those of new."""
    ids = few(written(gone.select("id").distinct()), MARKED)
    left = Index(index.postings.join(ids, "id", "left_anti").select(*index.postings.columns), index.lengths.join(ids, "id", "left_anti"), index.stems)
    return left if new is None else Index(left.postings.unionByName(new.postings), left.lengths.unionByName(new.lengths), index.stems)


@dataclass(frozen=True)
class Phrase:
    """Words that follow one another in a field (any, if None); prefix: the last one is the beginning of a word."""

    words: tuple[str, ...]
    prefix: bool = False
    field: str | None = None


#: Of each alternative: the phrases wanted, and groups of phrases that mustn't all be there.
Alternative = tuple[list[Phrase], list[list[Phrase]]]


def as_prefixes(query: str) -> list[str]:
    """H7: the words of a query as prefixes; operators, words that begin with a quote and those with a star stay as they are."""
    return [w if w.upper() in ("AND", "OR", "NOT") or w.startswith('"') or w.endswith("*") else f"{w}*" for w in query.split()]


_TOKEN = re.compile(r'\s*(?:(?:(\w+)\s*:\s*)?(?:"((?:[^"]|"")*)"|([\w\u0080-\U0010FFFF]+))\s*(\*)?)')


def _tokens(query: str, stems: bool) -> list[Phrase | str] | None:
    """The phrases and operators of a query of prefixes; None if something else stands there."""
    out, at, whole = [], 0, " ".join(as_prefixes(query))
    while at < len(whole):
        m = _TOKEN.match(whole, at)
        if not m:
            return None
        field, quoted, bare, star = m.groups()
        at = m.end()
        if not field and not star and bare in ("AND", "OR", "NOT"):
            out.append(bare)
            continue
        words = [w for w in re.split(r"[\W_]+", folded_name(quoted if quoted is not None else bare)) if w]
        if not words:
            return None
        out.append(Phrase(tuple(map(stem, words)) if stems else tuple(words), bool(star), field.lower() if field else None))
    return out


def _parted(tokens: list, operator: str) -> Iterator[list]:
    """The stretches of tokens between operators."""
    start = 0
    for i, t in enumerate([*tokens, operator]):
        if t == operator:
            yield tokens[start:i]
            start = i + 1


def alternatives(query: str, stems: bool = False) -> list[Alternative] | None:
    """K2: the alternatives of a query; None if it is malformed. Words side by side belong together, then NOT binds closest, then AND,
    then OR; words in double quotes are a phrase, name: before a word or phrase looks in that field only."""
    tokens = _tokens(query, stems)
    if not tokens:
        return None
    out: list[Alternative] = []
    for option in _parted(tokens, "OR"):
        want: list[Phrase] = []
        bar: list[list[Phrase]] = []
        for part in _parted(option, "AND"):
            groups = list(_parted(part, "NOT"))
            if not all(groups):  # two operators, or one at an end
                return None
            want += groups[0]
            bar += groups[1:]
        out.append((want, bar))
    return out


def _hits(phrase: Phrase, i: int) -> Column:
    """Whether a posting is of the word i of the phrase."""
    word, last = phrase.words[i], i == len(phrase.words) - 1
    hit = F.col("term").startswith(word) if phrase.prefix and last else F.col("term") == word
    return hit if phrase.field is None else hit & (F.col("field") == phrase.field)


def _counted(index: Index, phrases: list[Phrase]) -> DataFrame:
    """id and how often its text has each phrase (f0, f1, ...). Only postings of the words of the phrases are read and shuffled."""
    words = [_hits(p, i) for p in phrases for i in range(len(p.words))]
    found = index.postings.filter(reduce(lambda a, b: a | b, words))
    each, counts = [], []
    for k, p in enumerate(phrases):
        if len(p.words) == 1:
            each.append(F.coalesce(F.sum(F.when(_hits(p, 0), F.col("tf"))), F.lit(0)).alias(f"f{k}"))
            counts.append(F.col(f"f{k}"))
            continue
        each += [F.flatten(F.collect_list(F.when(_hits(p, i), F.col("places")))).alias(f"p{k}_{i}") for i in range(len(p.words))]
        met = F.col(f"p{k}_0")
        for i in range(1, len(p.words)):  # where the words so far are followed by this one
            met = F.array_intersect(F.transform(met, lambda x: x + 1), F.col(f"p{k}_{i}"))
        counts.append(F.size(met).cast("long"))
    by_field = found.groupBy("id", "field").agg(*each).select("id", *(c.alias(f"f{k}") for k, c in enumerate(counts)))
    return by_field.groupBy("id").agg(*(F.sum(f"f{k}").alias(f"f{k}") for k in range(len(phrases))))


def _fitting(counted: DataFrame, phrases: list[Phrase], options: list[Alternative]) -> DataFrame:
    has = {p: F.col(f"f{k}") > 0 for k, p in enumerate(phrases)}
    both = lambda group: reduce(lambda a, b: a & b, [has[p] for p in group])
    fits = [reduce(lambda a, b: a & b, [both(want), *(~both(group) for group in bar)]) for want, bar in options]
    return counted.filter(reduce(lambda a, b: a | b, fits))


def _phrases(options: list[Alternative]) -> list[Phrase]:
    """All phrases, those wanted first."""
    return list(dict.fromkeys([*(p for want, _ in options for p in want), *(p for _, bar in options for group in bar for p in group)]))


def matching(index: Index, query: str) -> DataFrame:
    """K2: ids of texts that fit a query; none fits a malformed one."""
    options = alternatives(query, index.stems)
    if not options:
        return index.lengths.select("id").limit(0)
    phrases = _phrases(options)
    return _fitting(_counted(index, phrases), phrases, options).select("id")


def ranked(index: Index, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Id and BM25 score (larger is better) of the texts that fit a query, over the wanted phrases of all alternatives."""
    options = alternatives(query, index.stems)
    if not options:
        return index.lengths.select("id", F.lit(0.0).alias("score")).limit(0)
    phrases = _phrases(options)
    wanted = len({p for want, _ in options for p in want})
    n, total = index.totals or index.lengths.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    mean = total / n if n and total else 1.0
    tf = written(_counted(index, phrases))
    df = tf.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(wanted))).first()  # a number of each phrase
    score = F.lit(0.0)
    for i in range(wanted):
        idf = F.greatest(F.lit(1e-6), F.log(F.lit((n - df[i] + 0.5) / (df[i] + 0.5))))
        f = F.col(f"f{i}")
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("length") / F.lit(float(mean))))
    return _fitting(tf, phrases, options).join(index.lengths, "id").select("id", score.alias("score"))


def occurrences(docs: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """K5: how often each text has the needle, without overlaps, in any case."""
    n = F.size(F.split(F.lower(text), r"\Q" + needle.lower() + r"\E", -1)) - 1
    return docs.select(F.col(key).alias("id"), n.cast("long").alias("n")).filter("n > 0")


def folded_pattern(needle: str) -> str:
    """A pattern for texts in any form that, folded, are the folded needle."""
    one = lambda c: "[" + "".join(f"\\x{{{ord(v):x}}}" for v in sorted({c, *T.fold_variants().get(c, ())})) + r"][\u0300-\u036F]*"
    return "(?iu)" + "".join(map(one, folded_name(needle)))


def places(docs: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """K6: id, n (from 1), start (characters before it), length of each occurrence of the needle in the text as it is: both may be in
    any case, with diacritics, composed or not. Without overlaps; needles of one character find nothing."""
    if len(needle.strip()) < 2 or not folded_name(needle):
        return docs.select(F.col(key).alias("id"), *(F.lit(0).alias(c) for c in ("n", "start", "length"))).limit(0)
    pattern = folded_pattern(needle)
    cut = docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    # where a match ends: the lengths of all before it, summed up in one pass
    step = F.zip_with("p", "m", lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("length")))
    spans = cut.filter(F.size("m") > 0).select("id", "row", F.posexplode(F.slice(step, 1, F.size("m"))).alias("n", "s"))
    before = Window.partitionBy("row").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("s.gap") + F.col("s.length")).over(before)
    return spans.select("id", (F.col("n") + 1).alias("n"), (end - F.col("s.length")).cast("int").alias("start"), F.col("s.length").alias("length"))


#: Parts of speech in the order they are shown, and how many senses of each.
POS = ("n", "v", "a", "r")
SENSES = 6


def looked_up(words: DataFrame, entries: DataFrame, lemmas: DataFrame) -> DataFrame:
    """For each raw word the entry found (word), by itself, else by its irregular lemma, else by a base form; null if none.

    words: raw; entries: word, pos, sense, definition; lemmas: form, lemma. Three equi-joins on distinct words, first hit first.
    """
    asked = words.select("raw").distinct().withColumn("w", T.normal_word(F.col("raw"))).filter((F.length("w") > 0) & (F.length("w") <= 64))
    tries = asked.select("raw", F.lit(0).alias("at"), F.col("w").alias("word"))
    tries = tries.unionByName(asked.join(lemmas, asked["w"] == lemmas["form"]).select("raw", F.lit(1).alias("at"), F.col("lemma").alias("word")))
    tries = tries.unionByName(asked.select("raw", F.posexplode(T.base_forms(F.col("w"))).alias("at", "word")).withColumn("at", F.col("at") + 2))
    found = tries.join(entries.select("word").distinct(), "word", "left_semi").groupBy("raw").agg(F.min_by("word", F.struct("at", "word")).alias("word"))
    return words.select("raw").distinct().join(found, "raw", "left")


def shaped(entries: DataFrame) -> DataFrame:
    """Of each word, its parts of speech in order, with the first senses of each."""
    listed = F.slice(F.array_sort(F.collect_list(F.struct("sense", "definition"))), 1, SENSES)
    known = entries.filter(F.col("pos").isin(*POS))
    by_pos = known.groupBy("word", "pos").agg(listed.alias("senses"))
    order = F.array_position(F.array(*map(F.lit, POS)), F.col("pos"))
    one = F.struct(order.alias("o"), "pos", F.transform("senses", lambda x: x["definition"]).alias("definitions"))
    return by_pos.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(one)), lambda e: F.struct(e["pos"].alias("pos"), e["definitions"].alias("definitions"))).alias("entries"))
