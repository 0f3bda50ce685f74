"""Sub-word token vectors: hashed character n-gram buckets as a table.

A bucket's vector is the count-weighted mean of the vectors of the vocabulary's tokens that have one of its n-grams; the
vector of a token that isn't in the vocabulary is the mean over the buckets of its own n-grams.  Buckets are trained
and tokens composed as joins and sums over distinct tokens, so the work follows the vocabulary and not the corpus, and
neither table passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.functions.vectors import l2_normalize
from vicinity.operators.encode import checked_length, lookup_token_vectors, vector_length
from vicinity.session import cut_lineage

# fixed values: n-grams of 3 to 6 characters of the token between "<" and ">", and the number of buckets
SHORTEST, LONGEST = 3, 6
BUCKETS = 2_000_000


def gram_buckets(token: str = "token", shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> Column:
    """Distinct buckets of a token's n-grams: the first 8 hex digits of an n-gram's md5, modulo ``buckets``."""
    marked = F.concat(F.lit("<"), F.col(token), F.lit(">"))
    n = F.length(marked)

    def grams(size: int) -> Column:
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substring(marked, i, F.lit(size)))) \
            .otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.flatten(F.array(*(grams(s) for s in range(shortest, longest + 1)))))
    return F.array_distinct(F.transform(every, lambda g: F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long") % buckets))


def train_buckets(vocab: DataFrame, **grams) -> DataFrame:
    """``(bucket, vec)`` from ``vocab(token, vec)`` or ``(token, vec, n)``, ``n`` being how often a token was seen.

    Null tokens and vectors are left out; every vector must be as long as the first.  One sum a component, summed in the
    tasks first, so an n-gram that very many tokens have costs no more than others.
    """
    weight = F.col("n").cast("double") if "n" in vocab.columns else F.lit(1.0)
    v = vocab.select("token", "vec", weight.alias("w")).filter("token is not null and vec is not null and w > 0")
    dim = vector_length(v)
    v = v.withColumn("vec", checked_length("vec", dim))
    rows = v.select(F.explode(gram_buckets(**grams)).alias("bucket"), "vec", "w")
    mean = F.array(*(F.sum(F.col("w") * F.col("vec")[i]) / F.sum("w") for i in range(dim)))
    return rows.groupBy("bucket").agg(mean.cast("array<double>").alias("vec"))


def compose(tokens: DataFrame, table: DataFrame, **grams) -> DataFrame:
    """``(token, vec)`` for distinct ``tokens(token)``: the mean over those of its buckets that ``table(bucket, vec)`` has.

    A token without any gets the zero vector, so none is lost.
    """
    dim = vector_length(table)
    rows = tokens.select("token", F.explode(gram_buckets(**grams)).alias("bucket")).join(table, "bucket")
    mean = F.array(*(F.avg(F.col("vec")[i]) for i in range(dim))).cast("array<double>")
    found = rows.groupBy("token").agg(mean.alias("vec"))
    zero = F.array(*(F.lit(0.0) for _ in range(dim))).cast("array<double>")
    return tokens.select("token").join(found, "token", "left").select("token", F.coalesce("vec", zero).alias("vec"))


def subword_vocabulary(tokens: DataFrame, vocab: DataFrame, table: DataFrame, **grams) -> DataFrame:
    """``(token, vec, known)`` for every distinct non-null token of ``tokens(token)``: looked up, or else composed."""
    distinct = cut_lineage(tokens.select("token").filter("token is not null").distinct())
    known = vocab.select("token", F.col("vec").cast("array<double>").alias("vec"))
    looked = distinct.join(known, "token").withColumn("known", F.lit(True))
    unseen = distinct.join(known.select("token"), "token", "left_anti")
    return looked.unionByName(compose(unseen, table, **grams).withColumn("known", F.lit(False)))


def lookup_with_subwords(tokens: DataFrame, vocab: DataFrame, table: DataFrame, normalize: bool = True, **grams) -> DataFrame:
    """:func:`vicinity.operators.encode.lookup_token_vectors` that keeps the tokens the vocabulary doesn't have."""
    every = subword_vocabulary(tokens, vocab, table, **grams).select("token", l2_normalize("vec").alias("vec") if normalize else "vec")
    return lookup_token_vectors(tokens.filter("token is not null"), every, normalize=False)
