"""Fuzzy dictionary search as a blocked join: never a cross join, no false negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _part(c: Column, i: Column, k: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of k + 1 nearly equal ones of an entry of length(c)."""
    n, p = F.length(c), k + 1
    short = F.floor(n / p)
    long_from = p - n % p
    return (i * short + F.greatest(i - long_from, F.lit(0)) + 1).cast("int"), (short + F.when(i >= long_from, 1).otherwise(0)).cast("int")


def fuzzy_find(words: DataFrame, dictionary: DataFrame, max_dist: int = 2, segments: bool = True) -> DataFrame:
    """The nearest dictionary entry of each distinct word: w, kind, match, dist, ord.

    words(w); dictionary(kind, ord, entry). Entries farther than max_dist do not count; of equally near ones the
    first in dictionary order wins. By segments: an entry within distance k shares, unchanged, one of its k + 1
    segments with the word, shifted by at most as many places as edits can lie on one side of it. Words and entries too short for that stay blocked by length,
    as all do without segments, which is a check on them for small dictionaries.
    """
    # As many parts as a shuffle has, however few the words: what they cost is the entries that they are measured against. Dealt in
    # turn, as Spark drops a repartitioning by w as the same as that of distinct(), and joins its small parts into one.
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = words.select("w").where("w is not null and w <> ''").distinct().repartition(parts)
    d = dictionary.select("kind", "ord", "entry").where("entry is not null and entry <> ''")
    k = max_dist
    sized = w.withColumn("n", F.explode(F.sequence(F.greatest(F.length("w") - k, F.lit(1)), F.length("w") + k)))
    if segments:
        at = F.explode(F.sequence(F.lit(0), F.lit(k)))
        long_d = d.where(F.length("entry") > k).withColumn("i", at)
        start, size = _part(F.col("entry"), F.col("i"), k)
        left = long_d.select("kind", "ord", "entry", F.length("entry").alias("n"), "i", F.substr("entry", start, size).alias("seg"))
        probe = sized.where(F.col("n") > k).withColumn("i", at)
        filler = F.rpad(F.lit(""), F.col("n").cast("int"), F.lit("x"))
        start, size = _part(filler, F.col("i"), k)
        probe = probe.withColumns({"s": start, "z": size, "more": F.length("w") - F.col("n")})
        # Before segment i at most i edits are spent, behind it at most k - i, or another segment is shared as well.
        first = F.greatest(F.lit(1), F.col("s") - F.col("i"), F.col("s") + F.col("more") - (k - F.col("i")))
        last = F.least(F.length("w") - F.col("z") + 1, F.col("s") + F.col("i"), F.col("s") + F.col("more") + (k - F.col("i")))
        probe = probe.withColumns({"first": first, "last": last}).where("first <= last").withColumn("p", F.explode(F.sequence("first", "last")))
        probe = probe.select("w", "n", "i", F.substr("w", "p", "z").alias("seg"))
        pairs = probe.join(left, ["n", "i", "seg"]).select("w", "kind", "ord", "entry")  # a pair that shares more segments is measured more than once
        short = sized.where(F.col("n") <= k).join(d.withColumn("n", F.length("entry")), "n").select("w", "kind", "ord", "entry")
        pairs = pairs.union(short)
    else:
        pairs = sized.join(d.withColumn("n", F.length("entry")), "n")
    near = pairs.withColumn("dist", F.levenshtein("w", "entry", k)).where("dist >= 0")
    best = near.groupBy("w", "kind").agg(F.min(F.struct("dist", "ord", "entry")).alias("b"))
    return best.select("w", "kind", F.col("b.entry").alias("match"), F.col("b.dist").alias("dist"), F.col("b.ord").alias("ord"))
