"""Spelling variants of words by reduced-alphabet generation.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point. Letters are hashed to a few symbols; words that are near have reduced
forms that are equal or near. Every word generates the one-edit neighbourhood
of its reduced form over the small alphabet, the generated forms are joined with
the reduced vocabulary, and what meets is verified on the original words.

Being near is symmetric, so of the full neighbourhood only the half is generated
that finds each pair from one of its words: the form itself, all deletions (the
insertions are those of the longer word seen from the shorter) and replacements
by a later symbol (those by an earlier one are found from the other word). The
number of symbols follows the size of the vocabulary by a rule (``symbols``), so
a reduced form is shared by few words; it changes the cost, never the pairs.

Everything is SQL functions and joins. A word's partners, however many, are
counted and compared in partial aggregates. Null words are left out, repeated
rows of a word count together, words may hold any code points, and an empty
vocabulary gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import saved

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = LOWER + UPPER + "0123456789+/"  # symbols, in the order of their code points when sorted
TYPICAL = 6  # letters of a word for which reduced forms are meant to outnumber the words


def lowered(text: Column) -> Column:
    """A-Z lower-cased; the check spares most words the translation."""
    return F.when(F.lower(text) == text, text).otherwise(F.translate(text, UPPER, LOWER))


def long_runs(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, run): the maximal runs of letters of ``least`` code points or more, A-Z lower-cased."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least},}}"), F.lit(0))).alias("run"))
    return found.select("doc_id", lowered(F.col("run")).alias("run"))


def vocabulary(words: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    long = words.where(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def symbols(words: int) -> int:
    """As many symbols as make reduced forms of ``TYPICAL`` letters about as many as the words; 4 to 64."""
    return min(64, max(4, math.ceil(words ** (1 / TYPICAL))))


def reduced(word: Column, count: int) -> Column:
    """Each code point hashed to one of ``count`` symbols."""
    alphabet = "".join(sorted(ALPHABET))[:count]
    symbol = lambda i: F.substring(F.lit(alphabet), F.pmod(F.xxhash64(F.substr(word, i, F.lit(1))), F.lit(count)).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(word)), symbol), "")


def half_neighbourhood(form: Column, count: int) -> Column:
    """All deletions of a reduced form and its replacements by later symbols, without repeats."""
    alphabet = F.array(*[F.lit(x) for x in sorted(ALPHABET)[:count]])
    places = F.sequence(F.lit(1), F.length(form))
    head = lambda i: F.substr(form, F.lit(1), i - 1)
    tail = lambda i: F.substr(form, i + 1)
    deleted = F.transform(places, lambda i: F.concat(head(i), tail(i)))
    later = lambda i: F.filter(alphabet, lambda s: s > F.substr(form, i, F.lit(1)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(later(i), lambda s: F.concat(head(i), s, tail(i)))))
    return F.array_distinct(F.concat(deleted, replaced))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of near words of (word, n) once."""
    count = symbols(words.count())
    forms = saved(words.where(F.length("word") > 0).withColumn("form", reduced(F.col("word"), count)))
    met = forms.select(F.xxhash64("form").alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    own = forms.select(F.xxhash64("form").alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"), F.lit(True).alias("own"))
    others = F.explode(F.transform(half_neighbourhood(F.col("form"), count), lambda x: F.xxhash64(x)))
    made = forms.select(others.alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"), F.lit(False).alias("own"))
    near = (F.levenshtein("a", "b", 1) == 1) & (~F.col("own") | (F.col("a") < F.col("b")))
    return own.unionByName(made).join(met.withColumnRenamed("key", "met"), (F.col("key") == F.col("met")) & near).select("a", "a_n", "b", "b_n")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n).

    A word's form is its near word of largest n (ties: the smallest in code-point
    order) if that n is ``ratio`` times its own or more; its root is the end of the
    chain of forms. n grows by ``ratio`` with every step, so the largest n bounds
    the length of a chain, and doubling follows all chains in a few joins.
    """
    words = saved(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
    pairs = saved(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    told = words.join(near, "word", "left")
    follows = -F.col("best.less") >= ratio * F.col("n")
    told = saved(told.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("best.other")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n"),
    ))
    steps = saved(told.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    most = words.agg(F.max("n")).first()[0] or 1
    longest = max(1, math.ceil(math.log(max(most, 2), ratio)))
    for _ in range(max(0, math.ceil(math.log2(longest)))):
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = saved(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return told.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
