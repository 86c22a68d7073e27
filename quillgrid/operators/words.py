"""Word counts under several aggregation plans.

All plans give the same counts. They differ in what is shuffled:

=====================  =========================================================
``word_count``         one shuffle, map-side combined; a hot word reaches the
                       reducer as one row per map task
``salted``             two shuffles; the first splits each word over ``salts``
                       groups, by document and word
``salted_on_the_fly``  likewise, each occurrence draws its own group
``by_partition``       counts within each document, then within each partition,
                       then one shuffle of the partition totals
=====================  =========================================================
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import checks, rng
from quillgrid.sources.documents import tokens


def _identity(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "text"]


def _occurrences(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(tokens(F.col("text"))).alias("word"))


def per_document(docs: DataFrame) -> DataFrame:
    """How often each word occurs in each document.

    A document is one row, so its words are counted in place: sorted, and each run
    of equal words measured from the index of its end. Nothing is shuffled.
    """
    names = _identity(docs)
    last = F.size("sorted") - 1
    run_end = lambda at: (at == last) | (F.get("sorted", at) != F.get("sorted", at + 1))
    length = lambda end, k: end - F.coalesce(F.get("ends", k - 1), F.lit(-1))
    return (
        docs.select(*names, F.sort_array(tokens(F.col("text"))).alias("sorted"))
        .select(*names, "sorted", F.filter(F.sequence(F.lit(0), last), run_end).alias("ends"))
        .select(*names, F.inline(F.transform("ends", lambda end, k: F.struct(
            F.get("sorted", end).alias("word"), length(end, k).cast("long").alias("n")))))
    )


def per_document_salted(docs: DataFrame, salts: int, seed: int = 0) -> DataFrame:
    """``per_document`` with a group number 0..salts-1 drawn for each document and word."""
    checks.whole("salts", salts, 1)
    key = F.concat_ws("|", *_identity(docs), "word")
    return per_document(docs).withColumn("salt", rng.draw_below(salts, key, f"{seed}:"))


def word_count(docs: DataFrame) -> DataFrame:
    return _occurrences(docs).groupBy("word").agg(F.count("*").alias("n"))


def _two_rounds(rows: DataFrame, salt: Column) -> DataFrame:
    per_group = rows.groupBy(salt.alias("salt"), "word").agg(F.count("*").alias("n"))
    return per_group.groupBy("word").agg(F.sum("n").alias("n"))


def salted(docs: DataFrame, salts: int, seed: int = 0) -> DataFrame:
    """Two rounds; all occurrences of a word in one document share a group."""
    checks.whole("salts", salts, 1)
    names = _identity(docs)
    rows = docs.select(*names, F.explode(tokens(F.col("text"))).alias("word"))
    return _two_rounds(rows, rng.spread_key(salts, seed, *names, "word"))


def salted_on_the_fly(docs: DataFrame, salts: int, seed: int = 0) -> DataFrame:
    """Two rounds; the group is drawn per occurrence while grouping."""
    checks.whole("salts", salts, 1)
    names = _identity(docs)
    rows = docs.select(*names, F.posexplode(tokens(F.col("text"))).alias("at", "word"))
    return _two_rounds(rows, rng.spread_key(salts, seed, *names, "at"))


def by_partition(docs: DataFrame) -> DataFrame:
    """Document totals, combined inside each partition before the only shuffle."""
    return per_document(docs).groupBy("word").agg(F.sum("n").alias("n"))


def distinct_words(docs: DataFrame) -> DataFrame:
    return _occurrences(docs).agg(F.count_distinct("word").alias("distinct_words"))


def average_word_length(docs: DataFrame) -> DataFrame:
    """Mean length, in characters, of the distinct words; NULL without documents."""
    return (_occurrences(docs).groupBy("word").agg(F.length("word").alias("length"))
            .agg(F.avg("length").alias("average_word_length")))


def count_documents(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"))
