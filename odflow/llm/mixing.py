"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflow.llm.common import shielded
from odflow.session import materialise, small_side

WEIGHTS = (3.0, 1.0, 2.0)
BINS = 16_384


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def odds_number(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key alone."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 12), 16, 10).cast("double")
    return (digits + 0.5) / F.lit(float(1 << 48))


def target_sizes(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Target of each source: the shares by weight, none above ``most`` times the source's size.

    ``sizes``: (source, source_size), one row per source. The excess of capped sources goes to the
    others by weight: sources are capped in the order of their ceiling per weight, and the level that
    the rest of the budget gives to the rest of the weights is the common one where it is highest.
    There is one row per source, so the unpartitioned windows are as small as the list of sources.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    whole = Window.partitionBy()
    order = Window.orderBy("ceiling", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        weighed.withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("ceiling", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    )
    level = F.max("level").over(whole)  # levels rise while the source at hand is capped, and fall after
    return levels.withColumn("common", level).select(
        "source",
        "source_size",
        F.when(F.col("ceiling") <= F.col("common"), F.col("cap")).otherwise(F.col("common") * F.col("weight")).alias("target"),
    )


def size_class(size: Column) -> Column:
    """Binary digits of the size less one: 0 for 0 and 1, 1 for 2 and 3, and so on."""
    return F.length(F.bin(F.greatest(size, F.lit(1)))) - 1


def class_shares(mass: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """(source, class, target, source_size, whole, p, wanted): copies that documents of a class get on average.

    ``mass``: (source, class, mass) with the words of each class. The copies are in proportion to the root
    of 2 ^ class up to ``most``, at a level where the words of the source come to its target. ``whole`` of them
    are certain, ``p`` is the chance of one more, ``wanted`` the words that the drawn ones are to have. A source has
    some 40 classes at most, so these windows are small.
    """
    source = Window.partitionBy("source")
    order = source.orderBy(F.desc("class"))
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    weighed = mass.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "weight", F.sqrt(F.pow(F.lit(2.0), F.col("class")))
    )
    capped = F.coalesce(F.sum(F.col("mass") * F.lit(most)).over(before), F.lit(0.0))
    level = F.try_divide(F.col("target") - capped, F.sum(F.col("weight") * F.col("mass")).over(onward))
    copies = F.coalesce(F.least(F.lit(most), F.col("common") * F.col("weight")), F.lit(0.0))
    levelled = weighed.withColumn("level", level).withColumn("common", F.max("level").over(source))
    shares = levelled.withColumn("copies", copies).withColumn("whole", F.floor("copies"))
    certain = F.sum(F.col("whole") * F.col("mass")).over(source)
    return shares.select(
        F.col("source").alias("_source"), F.col("class").alias("_class"), "target", "source_size", "whole",
        (F.col("copies") - F.col("whole")).alias("p"), (F.col("target") - certain).alias("wanted"),
    )


def pareto_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    bins: int = BINS,
) -> DataFrame:
    """``docs`` with size, source_size, target and copies.

    Input: doc_id, text, source and any others, all kept (columns named as the new ones are
    replaced). Sources by code point, null last, take the weights in turn. Within a source the
    mean number of copies of a document grows with the root of its size (by powers of two, up to ``most``), at the
    level where the source's words come to its target: long documents lose least by being cut, and short ones are
    thinned first. The whole copies are certain, and the rest is an inclusion probability p, which differs from
    document to document. Documents are ranked by the quotient of random odds u / (1 - u) and inclusion odds
    p / (1 - p), and those with the smallest quotients are taken until the words still wanted are reached; the
    document that crosses the target is taken if that comes nearer to it. So the sample has a fixed size and
    unequal probabilities.

    The random number comes from the id alone (the text for null ids), so reruns agree. Rows of one
    quotient, id and size are a group, from which as many rows are taken as are wanted; which of
    them follows from their text and place in the input. The cut is found
    without ordering a whole source: words per narrow bin of the quotient, then per group in the bin of the cut, then
    rows in narrow bins within the group of the cut. Null and empty texts have size 0 and take no words. Sources of
    size 0 have target 0. An empty table gives no rows.
    """
    mixed = lambda df: _pareto_mix(df, weights, share, most, seed, bins)
    return shielded(docs, ("doc_id", "text", "source"), mixed, ("size", "source_size", "target", "copies"))


def _pareto_mix(base: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: str, bins: int) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    hidden = {
        "_size": word_count(F.col("text")), "_u": odds_number(key, seed),
        "_tie": F.shiftrightunsigned(F.xxhash64("text", F.monotonically_increasing_id()), 1),
    }
    # stored, so that every pass sees the same numbers, whatever the input is computed from
    sized = materialise(base.withColumns(hidden).withColumn("_k", size_class(F.col("_size"))), "mix")
    light = sized.select("source", "_size", "_u", "_tie", "_k", "doc_id")
    mass = materialise(light.groupBy("source", F.col("_k").alias("class")).agg(F.sum("_size").alias("mass")), "mass")
    sizes = mass.groupBy("source").agg(F.sum("mass").alias("source_size"))
    plan = small_side(class_shares(mass, target_sizes(sizes, weights, share, most), most))
    own = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_k") == F.col("_class"))
    quotient = F.try_divide(F.col("_u") / (1 - F.col("_u")), F.col("p") / (1 - F.col("p")))  # p is below 1
    rank = F.struct((quotient / (1 + quotient)).alias("t"), "doc_id", "_size").alias("_rank")
    drawable = light.join(plan, own).where(F.col("p") > 0).select("source", "wanted", "_tie", rank)
    drawable = drawable.withColumn("bin", F.floor(F.col("_rank.t") * bins))
    # 1: the bin of the cut
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        drawable.groupBy("source", "bin", "wanted").agg(F.sum("_rank._size").alias("m"))
        .withColumn("below", F.coalesce(F.sum("m").over(running), F.lit(0)))
        .where((F.col("below") <= F.col("wanted")) & (F.col("below") + F.col("m") > F.col("wanted")))
        .select(F.col("source").alias("_s"), F.col("bin").alias("_bin"), "below")
    )
    edges = small_side(edges)
    # 2: the group of the cut within it
    at_edge = drawable.join(edges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_bin")))
    upto = Window.partitionBy("source").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("_rank._size")
    groups = (
        at_edge.groupBy("source", "_rank", "wanted", "below").agg(F.count("*").alias("n"))
        .withColumn("under", F.col("below") + F.coalesce(F.sum(F.col("n") * size).over(upto), F.lit(0)))
        .withColumn("taken", F.ceil(F.coalesce(F.try_divide(F.col("wanted") - F.col("under"), size), F.lit(0.0)) + 0.5) - 1)
        .withColumn("taken", F.least(F.col("n"), F.greatest(F.lit(0), F.col("taken"))))
    )
    groups = materialise(groups, "groups")
    cuts = groups.groupBy(F.col("source").alias("_s")).agg(
        F.max(F.when((F.col("taken") == F.col("n")) & (size > 0), F.col("_rank"))).alias("cut"),
        F.max(F.when((F.col("taken") > 0) & (F.col("taken") < F.col("n")), F.struct("_rank", "taken"))).alias("part"),
    )
    # 3: the rows of a group that is taken in part
    parts = small_side(cuts.where("part IS NOT NULL").select(F.col("_s").alias("_p"), F.col("part._rank").alias("_r"), F.col("part.taken").alias("_n")))
    tie_bin = F.shiftright("_tie", 49)  # 16,384 bins of the 63 bits
    tied = at_edge.join(parts, F.col("source").eqNullSafe(F.col("_p")) & (F.col("_rank") == F.col("_r"))).withColumn("tie_bin", tie_bin)
    earlier = Window.partitionBy("source").orderBy("tie_bin").rowsBetween(Window.unboundedPreceding, -1)
    tie_edges = (
        tied.groupBy("source", "tie_bin", "_n").agg(F.count("*").alias("c"))
        .withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
        .where((F.col("before") < F.col("_n")) & (F.col("before") + F.col("c") >= F.col("_n")))
        .select(F.col("source").alias("_q"), F.col("tie_bin").alias("_tie_bin"), "before")
    )
    place = F.col("before") + F.row_number().over(Window.partitionBy("source").orderBy("_tie"))
    last = (
        tied.join(small_side(tie_edges), F.col("source").eqNullSafe(F.col("_q")) & (F.col("tie_bin") == F.col("_tie_bin")))
        .withColumn("place", place).where(F.col("place") <= F.col("_n"))
        .groupBy(F.col("source").alias("_t")).agg(F.max("_tie").alias("last"))
    )
    found = edges.join(cuts.withColumnRenamed("_s", "_c"), F.col("_s").eqNullSafe(F.col("_c")), "left").join(
        last, F.col("_s").eqNullSafe(F.col("_t")), "left"
    )
    found = small_side(found.select(F.col("_s").alias("_e"), "_bin", "cut", F.col("part._rank").alias("tied"), "last"))
    placed = sized.join(plan, own).join(found, F.col("source").eqNullSafe(F.col("_e")), "left").withColumn("_rank", rank)
    bin_of = F.floor(F.col("_rank.t") * bins)
    drawn = (
        F.col("_bin").isNull()  # all that can be drawn is wanted, or nothing can be
        | (bin_of < F.col("_bin")) | ((bin_of == F.col("_bin")) & (F.col("_rank") <= F.col("cut")))
        | ((F.col("_rank") == F.col("tied")) & (F.col("_tie") <= F.col("last")))
    )
    drawn = (F.col("p") > 0) & (F.col("wanted") > 0) & F.coalesce(drawn, F.lit(False))
    return placed.select(
        *base.columns, F.col("_size").alias("size"), "source_size", "target", (F.col("whole") + drawn.cast("long")).alias("copies")
    )
