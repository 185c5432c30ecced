"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, carried, quoted, saved


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Adds target to (source, source_size): what each source gives to a mix of the size of all.

    Sources by code point, null last, take the weights in turn. No target is above most times its source's
    size; the excess is reshared by weight. That ends where target = least(most * size, weight * level) for one
    level, which the sources in the order of most * size / weight give in one pass of running sums.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumns({"most": F.col("source_size") * F.lit(float(most)), "full": F.col("source_size") * F.lit(float(most)) / F.col("weight")})
    before = Window.orderBy("full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("_level", level)
    final = F.min(F.when(F.col("full") > F.col("_level"), F.struct("full", F.col("source").isNull(), "source", "_level"))).over(whole)["_level"]
    return ranked.withColumn("target", F.when(F.col("full") <= F.col("_level"), F.col("most")).otherwise(F.least("most", F.col("weight") * final))).drop("most", "full", "_level")


def tilts(classes: DataFrame, goals: DataFrame, most: float, *, exact: float = 1e-10, steps: int = 100) -> DataFrame:
    """(skey, tilt): the dual variables of entropy balancing, by Newton iterations over the documents of all sources at once.

    Of all rates 0 <= r <= most of the documents whose words, sum(r * size) over a source, make its target, those of
    least relative entropy to one copy each are min(most, exp(tilt * size)), one tilt a source: the one that minimises the
    convex dual. Its gradient is target - sum(r * size), its second derivative the sum of r * size * size over what is not
    capped. Each iteration is one distributed aggregate of both over classes (skey, size, n) of equal documents, for all
    sources that are not there yet. A Newton step is taken for the logarithm of the words made, which a tilt moves almost
    evenly, and the middle of the interval known to hold the root where the step would leave it. Only how many sources
    are left comes back to the driver; the state is a row per source in a written table, and a lost executor repeats a step.

    A target of most times its source's size has every rate at most (an infinite tilt), one of nothing none.
    """
    mass = classes.where("size > 0").groupBy("skey").agg(F.sum(F.col("n") * F.col("size") * F.col("size")).alias("mass"))
    state = goals.select("skey", "source_size", "target").join(mass, "skey", "left")
    full = F.col("target") >= F.col("source_size") * F.lit(float(most) * (1 - 1e-13))
    first = F.log(F.col("target") / F.col("source_size")) * F.col("source_size") / F.col("mass")
    tilt = F.when(F.coalesce(F.col("source_size"), F.lit(0)) == 0, 0.0).when(F.col("target") <= 0, float("-inf")).when(full, float("inf")).otherwise(first)
    state = state.withColumns({"tilt": tilt, "low": F.lit(float("-inf")), "high": F.lit(float("inf"))})
    state = saved(state.withColumn("done", F.abs("tilt").isin(float("inf"), 0.0)).select("skey", "target", "tilt", "low", "high", "done"))
    for _ in range(steps):
        open_ = state.where("not done")
        if open_.isEmpty():
            break
        power = F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(50.0)))
        rate = F.least(F.lit(float(most)), power)
        words = F.col("n") * F.col("size")
        found = classes.where("size > 0").join(open_.select("skey", "tilt"), "skey").groupBy("skey").agg(
            F.sum(rate * words).alias("made"), F.sum(F.when(power < most, power * words * F.col("size")).otherwise(0.0)).alias("bent")
        )
        moved = open_.join(found, "skey")
        low, high = F.when(F.col("made") < F.col("target"), F.col("tilt")).otherwise(F.col("low")), F.when(F.col("made") >= F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        moved = moved.withColumns({"low": low, "high": high, "gap": F.log(F.col("target") / F.col("made"))})
        newton = F.col("tilt") + F.when(F.col("bent") > 0, F.col("gap") * F.col("made") / F.col("bent"))
        wide = F.when(F.col("low") == float("-inf"), F.col("high") - 1 - F.abs("high")).when(F.col("high") == float("inf"), F.col("low") + 1 + F.abs("low")).otherwise((F.col("low") + F.col("high")) / 2)
        step = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(wide)
        there = (F.abs("gap") < exact) | (step == F.col("tilt"))
        moved = moved.withColumn("new", F.when(F.abs("gap") < exact, F.col("tilt")).otherwise(step)).select("skey", "target", F.col("new").alias("tilt"), "low", "high", there.alias("done"))
        state = saved(state.where("done").union(moved))
    return state.select("skey", "tilt")


def _copies(most: int):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        """Copies of each class of a source, largest sizes first: what rounding leaves goes on to smaller sizes."""
        pdf = pdf.sort_values("size", ascending=False)
        owed, out = 0.0, []
        for size, n, r in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist(), strict=True):
            if size == 0:
                out.append(n)
                continue
            owed += r * n * size
            take = min(most * n, max(0, int(owed / size + 0.5)))
            owed -= take * size
            out.append(take)
        return pdf.assign(copies=out)[["skey", "size", "n", "rate", "copies"]]

    return fold


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, salts: int = 256, columns: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, rate): a row for each document.

    size is the number of words, taken = copies * size what the mix takes. Targets follow targets(); a document's rate
    is min(most, exp(tilt * size)) with its source's tilt from tilts(). Rates become whole copies by classes of equal
    source and size: one task per source walks its distinct sizes (not its documents) downwards and carries what
    rounding leaves, so that a source ends within half of its smallest document of its target where its
    sizes allow it. Within a class the copies go to the documents of least hash, counted in salted parts so
    that a class of very many copies is no single task. Reruns agree.

    A null text has size 0; a null source is a source. Documents without words take 0, have rate 1 and one copy. Repeated
    ids are documents of their own. An empty table gives an empty result. `columns` of docs are passed through,
    with _ before their names, and order rows of one id; others are ignored.
    """
    passing, _, inner, passed = carried(docs, columns)
    sized = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(source).cast("string").alias("source"), word_count(quoted(text).cast("string")).alias("size"), *passing)
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    sized = sized.select("doc_id", key.alias("skey"), "size", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(salts)).cast("int").alias("salt"), *inner)
    sized = sized if inner else saved(sized)  # whole rows are read again rather than written
    parts = saved(sized.groupBy("skey", "size", "salt").agg(F.count(F.lit(1)).alias("n")))
    classes = saved(parts.groupBy("skey", "size").agg(F.sum("n").alias("n")))
    totals = classes.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    totals = totals.withColumn("source", F.when(F.col("skey") != "n", F.substring("skey", 2, 1 << 30)))
    goals = saved(targets(totals, weights, most).select("skey", "source_size", "target"))
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(50.0)))))
    rated = classes.join(tilts(classes, goals, most), "skey").select("skey", "size", "n", rate.alias("rate"))
    taken = saved(rated.groupBy("skey").applyInPandas(_copies(most), "skey string, size long, n long, rate double, copies long"))
    before = F.sum("n").over(Window.partitionBy("skey", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    dealt = parts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    dealt = saved(dealt.join(taken, ["skey", "size"]).join(goals, "skey"))
    place = F.row_number().over(Window.partitionBy("skey", "size", "salt").orderBy(F.xxhash64("doc_id"), "doc_id", *inner)) - 1 + F.col("before")
    out = sized.join(dealt, ["skey", "size", "salt"]).withColumn("copies", F.expr("copies div n") + F.when(place < F.col("copies") % F.col("n"), 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", *passed)
