"""Mixing sources to target weights by entropy balancing.

Of all document rates in [0, 2] that give each source its target of words, take those closest to
one copy each in relative entropy: ``rate = min(2, exp(tilt * size / mean size))``, one tilt for
each source. The tilts solve the convex dual of the word constraints; each Newton step is one
distributed aggregation over a histogram of sizes, and all sources step at once. Rates then
become whole copies: along the sizes of a source, running sums of copies follow those of rates,
and a few more steps move single copies until what is left is smaller than any document.
Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut, pick

#: Highest number of copies of one document.
MOST = 2
#: Bounds on the loops; each stops as soon as nothing is left to do.
NEWTON_STEPS, TRIM_STEPS = 40, 8
#: Relative distance from the target at which a source is balanced.
NEAR = 1e-10
#: Shares of one (source, size) class when its documents are ranked.
SALTS = 1024


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """sizes: key, source, source_size; adds target, the word count that the mix wants.

    Sources take share * all words by weight, weights repeating along code-point order, null
    last. A target stops at MOST times its source's size; the excess goes to the others by
    weight until none is above. Sorted by size over weight the sources that stop come first, so
    running sums find them. The windows hold one row for each source.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    at = (F.row_number().over(ordered) - 1) % len(weights) + 1
    listed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at.cast("int")))
    cap = F.lit(float(MOST)) * F.col("source_size")
    rising = Window.orderBy(cap / F.col("weight"), "key")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    listed = listed.withColumn("level", left / weights_left)
    listed = listed.withColumn("open", F.col("weight") * F.col("level") < cap)
    ground = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct(cap / F.col("weight"), "key")))
    listed = listed.withColumn("ground", ground.over(every))
    target = F.when(F.col("open"), F.least(cap, F.col("weight") * F.col("ground"))).otherwise(cap)
    return listed.select("key", "source", "source_size", target.alias("target"))


def _rate(size: Column) -> Column:
    """Copies that a document of this size has on average, given its source's tilt."""
    z = size / F.greatest(F.col("mean"), F.lit(1.0))
    tilted = F.exp(F.least(F.col("tilt") * z, F.lit(1.0)))
    return F.when(F.col("full"), F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), tilted))


def balance(classes: DataFrame, aims: DataFrame) -> DataFrame:
    """aims with each source's tilt. classes: key, size, n; aims: key, source_size, target, mean.

    Newton's method on the logarithm of the words taken, kept inside a shrinking bracket; a
    source whose target is all that it can give is full and needs no tilt.
    """
    state = aims.withColumns(
        {
            "full": F.col("target") >= MOST * F.col("source_size") * (1 - NEAR),
            "tilt": F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.greatest(F.col("source_size"), F.lit(1))),
            "low": F.lit(-1e4),
            "high": F.lit(1e9),
            "off": F.lit(1.0),
        }
    )
    state = cut(state, "mix-tilts")
    for _ in range(NEWTON_STEPS):
        rate, z = _rate(F.col("size")), F.col("size") / F.greatest(F.col("mean"), F.lit(1.0))
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < MOST, words * z).otherwise(F.lit(0.0))
        sums = (
            classes.join(state.select("key", "tilt", "full", "mean"), "key")
            .groupBy("key")
            .agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        )
        above = F.col("words") > F.col("target")
        high = F.when(above, F.least("high", "tilt")).otherwise(F.col("high"))
        low = F.when(above, F.col("low")).otherwise(F.greatest("low", "tilt"))
        wanted = F.col("tilt") - F.log(F.col("words") / F.col("target")) * F.col("words") / F.col("slope")
        usable = (F.col("slope") > 0) & (F.col("words") > 0) & (wanted > low) & (wanted < high)
        halfway = F.when((high > 1e8), F.abs(F.col("tilt")) * 2 + 1).otherwise((low + high) / 2)
        off = F.abs(F.col("words") / F.col("target") - 1)
        still = (~F.col("full")) & (F.col("target") > 0) & (off > NEAR)
        state = cut(
            state.drop("off")
            .join(sums, "key")
            .select(
                "key", "source_size", "target", "mean", "full",
                F.when(still, F.when(usable, wanted).otherwise(halfway)).otherwise(F.col("tilt")).alias("tilt"),
                low.alias("low"), high.alias("high"),
                F.when(still, off).otherwise(F.lit(0.0)).alias("off"),
            ),
            "mix-tilts",
        )
        if not (state.agg(F.max("off")).first()[0] or 0.0) > NEAR:
            break
    return state


def round_copies(classes: DataFrame, tilts: DataFrame) -> DataFrame:
    """key, size, n, copies: whole copies of each class of equal source and size."""
    falling = Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rates = classes.join(tilts.withColumn("tilt", F.round("tilt", 9)), "key")
    rates = rates.withColumn("wanted", F.col("n") * _rate(F.col("size")))
    running = F.sum("wanted").over(falling)
    copies = F.floor(running + 0.5) - F.floor(running - F.col("wanted") + 0.5)
    out = rates.withColumn("copies", F.greatest(F.lit(0), F.least(copies, MOST * F.col("n"))).cast("long"))
    out = cut(out.select("key", "size", "n", "copies", "target"), "mix-copies")
    for _ in range(TRIM_STEPS):
        gap = out.groupBy("key").agg(
            F.round(F.max("target") - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("gap")
        )
        open_ = F.when(F.col("gap") > 0, MOST * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        usable = (F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & (open_ > 0)
        pick_ = (
            out.join(gap, "key")
            .where(usable)
            .groupBy("key")
            .agg(F.max_by(F.struct("size", "gap", open_.alias("room")), "size").alias("x"))
            .select(
                "key",
                "x.size",
                (F.signum("x.gap") * F.least(F.col("x.room"), F.floor(F.abs("x.gap") / F.col("x.size"))))
                .cast("long")
                .alias("more"),
            )
        )
        moved = out.join(pick_, ["key", "size"], "left")
        moved = cut(moved.withColumn("more", F.coalesce("more", F.lit(0).cast("long"))), "mix-copies")
        out = moved.withColumn("copies", F.col("copies") + F.col("more")).drop("more")
        if not moved.where("more != 0").limit(1).count():
            break
    return out


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, source.

    size: words of the text (null or empty: 0). taken = copies * size with copies 0, 1 or 2. The
    null source is a source of its own, last in order. Empty documents have whatever copies their
    rate gives and take no words; a table without words has targets 0. Equal documents of one
    source and size are told apart by a hash of their id, so reruns agree; rows that repeat an id
    count as documents of their own. An empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    docs = pick(docs, id_col, text_col, source_col).toDF("doc_id", "text", "source")
    docs = docs.withColumn("source", F.col("source").cast("string"))
    rows = docs.select("doc_id", "source", key.alias("key"), word_count(F.col("text")).alias("size"))
    rows = cut(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), "mix-rows")
    salted = cut(rows.groupBy("key", "source", "size", "salt").agg(F.count(F.lit(1)).alias("n")), "mix-salted")
    classes = cut(salted.groupBy("key", "source", "size").agg(F.sum("n").alias("n")), "mix-classes")
    sizes = classes.groupBy("key", "source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")
    )
    sizes = cut(sizes, "mix-sizes")
    aims = cut(targets(sizes, weights, share).join(sizes.select("key", "docs"), "key"), "mix-aims")
    aims = aims.withColumn("mean", F.col("source_size") / F.col("docs"))
    tilts = balance(classes.select("key", "size", "n"), aims.select("key", "source_size", "target", "mean"))
    copies = round_copies(classes.select("key", "size", "n"), tilts)
    # Rank the documents of a class: over salts by running sums, within a salt by hash of the id.
    along = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ranked = salted.drop("source").withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    ranked = ranked.drop("n").join(copies.drop("target"), ["key", "size"])
    within = Window.partitionBy("key", "size", "salt").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    out = rows.withColumn("place", F.row_number().over(within)).join(ranked, ["key", "size", "salt"])
    whole = F.floor(F.col("copies") / F.col("n"))
    extra = F.col("before") + F.col("place") <= F.col("copies") - whole * F.col("n")
    out = out.withColumn("taken_copies", (whole + extra.cast("long")).cast("long"))
    return out.join(aims.select("key", "source_size", "target"), "key").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.col("taken_copies").alias("copies"),
        (F.col("taken_copies") * F.col("size")).alias("taken"),
        "source",
    )
