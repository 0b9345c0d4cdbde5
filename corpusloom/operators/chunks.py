"""Sentence chunkers and synthetic assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Strategies, how much of a chunk they replace, and from where.
STRATEGIES = [("rewrite_full", "full", 1.0, 0.0), ("translate_full", "full", 1.0, 0.0), ("rewrite_middle", "partial", 0.40, 0.3), ("continue_tail", "partial", 0.50, 0.5), ("rescue_full", "rescue", 1.0, 0.0), ("rescue_partial", "rescue", 0.40, 0.3)]


def strategy_table(spark) -> DataFrame:
    return spark.createDataFrame(STRATEGIES, "strategy string, kind string, share double, start double")


def sentences(text) -> Column:
    """Sentences: cut after . ! ? in front of white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def semantic_cuts(words, similarity, threshold: float, least: int, most: int) -> Column:
    """Sentence counts of consecutive chunks: a chunk ends where the similarity to the next sentence is low and it has `least` words, or where the next one would exceed `most`.

    `words` has a number for each sentence; `similarity` one for each neighbouring pair.
    """
    state = F.struct(F.expr("cast(array() as array<int>)").alias("done"), F.lit(0).alias("n"), F.lit(0).alias("w"))
    items = F.transform(words, lambda w, i: F.struct(w.cast("int").alias("w"), F.coalesce(F.try_element_at(similarity, F.when(i > 0, i)), F.lit(1.0)).alias("s")))

    def step(a, x):
        cut = (a["n"] > 0) & (((x["s"] < threshold) & (a["w"] >= least)) | (a["w"] + x["w"] > most))
        return F.struct(F.when(cut, F.concat(a["done"], F.array(a["n"]))).otherwise(a["done"]).alias("done"), F.when(cut, 1).otherwise(a["n"] + 1).alias("n"), F.when(cut, x["w"]).otherwise(a["w"] + x["w"]).alias("w"))

    return F.aggregate(items, state, step, lambda a: F.when(a["n"] > 0, F.concat(a["done"], F.array(a["n"]))).otherwise(a["done"]))


def chunk_count(words) -> Column:
    """How many equal chunks a text of so many words gets."""
    return F.when(words < 120, 1).when(words < 250, 2).when(words < 500, 3).when(words < 900, 4).when(words < 1500, 6).otherwise(F.least(F.lit(12), F.ceil(words / 250).cast("int")))


def equal_cuts(words, similarity, n) -> Column:
    """Boundaries (sentence positions) of n chunks: for each target share of the words, the free boundary with the least mix of distance (.65) and similarity (.35)."""
    ints = "cast(array() as array<int>)"
    upto = F.aggregate(words, F.expr(ints), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x.cast("int"))))
    goals = F.when(n > 1, F.sequence(F.lit(1), (n - 1).cast("int"))).otherwise(F.expr(ints))

    def cuts(ends):
        total = F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0))
        places = F.zip_with(ends, similarity, lambda e, s: F.struct(e.alias("e"), F.coalesce(s, F.lit(0.0)).alias("s")))
        numbered = F.transform(F.slice(places, 1, F.greatest(F.size(ends) - 1, F.lit(0))), lambda x, i: F.struct((i + 1).alias("p"), x["e"].alias("e"), x["s"].alias("s")))

        def choose(spots):
            def step(used, k):
                cost = lambda x: 0.65 * F.abs(x["e"] - total * k / n) / F.greatest(total, F.lit(1)) + 0.35 * x["s"]
                free = F.transform(F.filter(spots, lambda x: ~F.array_contains(used, x["p"])), lambda x: F.struct(cost(x).alias("c"), x["p"].alias("p")))
                return let(F.array_min(free), lambda best: F.when(best.isNotNull(), F.concat(used, F.array(best["p"]))).otherwise(used))

            return F.array_sort(F.aggregate(goals, F.expr(ints), step))

        return let(numbered, choose)

    return let(upto, cuts)


def pieces(parts, cuts) -> Column:
    """Sentences joined between sorted boundaries."""
    starts = F.concat(F.array(F.lit(0)), cuts)
    ends = F.concat(cuts, F.array(F.size(parts)))
    return F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(parts, a + 1, b - a), " "))


def assemble(original, generated, start, end, mode) -> Column:
    """struct(text, start, end, fraction) of a synthetic text: replace_full, replace_fragment [start, end) or append."""
    head, tail = F.substring(original, 1, start), F.substring(original, end + 1, F.length(original))
    text = F.when(mode == "replace_full", generated).when(mode == "append", F.concat(original, F.lit(" "), generated)).otherwise(F.concat(head, generated, tail))
    first = F.when(mode == "replace_full", 0).when(mode == "append", F.length(original) + 1).otherwise(start)
    return F.struct(text.alias("text"), first.alias("start"), (first + F.length(generated)).alias("end"), F.round(F.coalesce(F.try_divide(F.length(generated), F.length(text)), F.lit(0.0)), 3).alias("fraction"))
