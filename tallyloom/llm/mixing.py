"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's size is the count of its characters plus one for each document. Its mean repetition rate is what brings its
share of the output to its target weight. Each document draws ``u`` from a hash of its id and the seed; its number of
copies is the smallest k at which the Poisson distribution with that mean reaches ``u``. Copies are then dealt out by
the hash of id, copy number and seed, which shuffles them globally.

``u`` has 52 bits, so k lies within REACH standard deviations of the mean: a source's distribution is tabled over that
window alone (about 20 times the root of the rate), by sums over windows, whatever the rate. Copies are made in two
steps of at most CHUNK, so no row holds an array as long as its count.

Defined cases: null sources are one source; null texts count as empty; null ids draw by the text's digest; very long
texts are copied whole; repeated rows draw alike, each for itself; weights that are missing from ``weights`` are 0; a
source whose documents are all empty may get a very high rate; empty tables give empty results; an input column that
has the name of an added one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Tables are broadcast up to so many entries of 8 bytes in all; beyond, rows are joined with salted copies of them.
MAX_ENTRIES = 2_000_000
SALTS = 16
#: Half the width of a source's window, in standard deviations and in counts: the tails beyond are below 2**-53.
REACH, MORE = 10, 40
#: Copies that are made of a row at once.
CHUNK = 65_536


def _unit(*parts: Column) -> Column:
    """A double in (0, 1) from the first 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """One row for each source: __source and __rate, its mean count of copies.
    ``weights``: target shares by source, in any unit; None: the same for each. ``epochs``: output size by input size."""
    size = F.length(F.coalesce(F.col("text"), F.lit(""))) + 1
    sizes = docs.groupBy(F.col("source").alias("__source")).agg(F.sum(size).cast("double").alias("__size"))
    if weights is None:
        sizes = sizes.withColumn("__w", F.lit(1.0))
    else:
        pairs = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "__k string, __w double")
        sizes = sizes.join(F.broadcast(pairs), F.col("__source").eqNullSafe(F.col("__k")), "left").fillna(0.0, ["__w"]).drop("__k")
    sizes = written(sizes, "sizes")
    whole = sizes.agg(F.sum("__size").alias("total"), F.sum("__w").alias("weights")).first()
    if whole["weights"]:
        rate = F.lit(float(epochs)) * F.lit(whole["total"]) * F.col("__w") / (F.lit(whole["weights"]) * F.col("__size"))
    else:
        rate = F.lit(0.0)
    return sizes.select("__source", rate.alias("__rate"))


def tables(rates_: DataFrame) -> DataFrame:
    """One row for each source with a rate above 0: __source, __low and __cdf, the distribution from __low on.

    Logarithms of the probabilities are summed from the window's start and taken relative to the largest, so that
    neither ends underflow; the sums of the probabilities are divided by their total."""
    r = F.col("__rate")
    reach = F.lit(float(REACH)) * F.sqrt(r) + F.lit(float(MORE))
    low, high = F.greatest(F.floor(r - reach), F.lit(0)).cast("long"), F.ceil(r + reach).cast("long")
    at = rates_.filter(r > 0).withColumn("__low", low).select("__source", "__rate", "__low", F.explode(F.sequence(low, high)).alias("__k"))
    of = Window.partitionBy("__source")
    ahead = of.orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("__k") > F.col("__low"), F.log(r) - F.log(F.col("__k").cast("double"))).otherwise(F.lit(0.0))
    at = at.withColumn("__log", F.sum(step).over(ahead))
    at = at.withColumn("__p", F.exp(F.col("__log") - F.max("__log").over(of)))
    at = at.withColumn("__c", F.sum("__p").over(ahead) / F.sum("__p").over(of))
    sums = F.transform(F.sort_array(F.collect_list(F.struct("__k", "__c"))), lambda x: x["__c"])
    return at.groupBy("__source").agg(F.min("__low").alias("__low"), sums.alias("__cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 7) -> DataFrame:
    """The copies of all documents in shuffled order: the input's columns, n_copies, copy (from 1) and shuffle_key."""
    table = written(tables(rates(docs, weights, epochs)), "tables")
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("source").alias("__from"), key.alias("__key"))
    if (table.agg(F.sum(F.size("__cdf") + F.lit(8))).first()[0] or 0) <= MAX_ENTRIES:
        joined = rows.join(F.broadcast(table), F.col("__from").eqNullSafe(F.col("__source")))
    else:
        salted = table.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("__salt", F.pmod(F.xxhash64("__key"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, F.col("__from").eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__copy")))
    u = _unit(F.lit(str(seed)), F.col("__key"))
    copies = F.col("__low") + F.least(F.size(F.filter("__cdf", lambda c: c < F.col("__u"))), F.size("__cdf") - 1)
    rows = joined.withColumn("__u", u).select("__doc", "__key", copies.cast("int").alias("n_copies")).filter("n_copies > 0")
    chunks = F.sequence(F.lit(0), F.floor((F.col("n_copies") - 1) / CHUNK).cast("int"))
    rows = rows.withColumn("__chunk", F.explode(chunks))
    last = F.least(F.col("n_copies"), (F.col("__chunk") + 1) * CHUNK)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("__chunk") * CHUNK + 1, last)))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), "__key", F.col("copy").cast("string")).cast("binary")))
    added = ["n_copies", "copy", "shuffle_key"]
    keep = [c for c in docs.columns if c.lower() not in added]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*[F.col("__doc")[c].alias(c) for c in keep], *added).repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")
