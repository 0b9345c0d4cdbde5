"""Span arithmetic over arrays of (start, end), half open, in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LABELLED_SPAN, SPAN
from .text import SQL_WHITE, let, sql_word_count

EMPTY = f"cast(array() as array<{SPAN}>)"


def parse_spans(c) -> Column:
    """struct(spans, error) of a JSON list of pairs; error is null where it parses."""
    raw = F.from_json(c, "array<array<int>>")
    ok = raw.isNotNull() & F.forall(raw, lambda x: (F.size(x) == 2) & x[0].isNotNull() & x[1].isNotNull())
    blank = c.isNull() | (F.trim(c) == "")
    spans = F.transform(raw, lambda x: F.struct(x[0].alias("start"), x[1].alias("end")))
    error = F.when(blank | ok, F.lit(None)).when(raw.isNull(), F.lit("ai_spans_json_invalid")).otherwise(F.lit("ai_spans_json_not_pairs"))
    return F.struct(F.when(blank, F.expr(EMPTY)).when(ok, spans).alias("spans"), error.alias("error"))


def invalid(spans, length) -> Column:
    """Names of what makes spans unusable: negative, empty or out of bounds."""
    has = lambda test: F.exists(spans, test)
    return F.array_compact(F.array(F.when(has(lambda s: s["start"] < 0), "negative_span"), F.when(has(lambda s: s["end"] <= s["start"]), "empty_span"), F.when(has(lambda s: s["end"] > length), "span_out_of_bounds")))


def merge(spans) -> Column:
    """Sorted spans with overlapping and adjacent ones joined."""
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, s: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))
    return F.aggregate(F.array_sort(spans), F.expr(EMPTY), lambda a, s: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= s["start"]), joined(a, s)).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))


def overlaps(spans) -> Column:
    """Whether sorted neighbours overlap, and whether they touch."""
    own = F.array_sort(spans)
    pairs = F.zip_with(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda a, b: b["start"] - a["end"])
    return F.struct(F.exists(pairs, lambda d: d < 0).alias("overlap"), F.exists(pairs, lambda d: d == 0).alias("adjacent"))


def tile(spans, length) -> Column:
    """Labelled spans that cover a text: `ai` where merged spans are, `human` between them."""
    piece = lambda a, b, label: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(label).alias("label"))
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(length.cast("int")))
    gaps = F.filter(F.zip_with(ends, starts, lambda e, s: piece(e, s, "human")), lambda p: p["end"] > p["start"])
    return F.array_sort(F.concat(gaps, F.transform(spans, lambda s: piece(s["start"], s["end"], "ai"))).cast(f"array<{LABELLED_SPAN}>"))


def total(spans) -> Column:
    return F.aggregate(spans, F.lit(0), lambda a, s: a + s["end"] - s["start"])


def fraction(spans, length) -> Column:
    """Share of the characters inside spans, 0 for an empty text."""
    return F.coalesce(F.try_divide(total(spans).cast("double"), length.cast("double")), F.lit(0.0))


def tiles_exactly(spans, length) -> Column:
    """Whether labelled spans are sorted, not empty, and cover 0 to length without gap."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    return (F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) == length) & F.forall(F.zip_with(spans, F.slice(ends, 1, F.size(spans)), lambda s, e: (s["start"] == e) & (s["end"] > s["start"]) & s["label"].isin("ai", "human")), lambda x: x)


def clamp(spans, text) -> Column:
    """Spans inside the text, with their text; empty ones go."""
    n = F.length(text)
    inside = F.transform(spans, lambda s: F.struct(F.least(F.greatest(s["start"], F.lit(0)), n).alias("start"), F.least(F.greatest(s["end"], F.lit(0)), n).alias("end")))
    return F.transform(F.filter(inside, lambda s: s["end"] > s["start"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text")))


def repair_tail(spans, text) -> Column:
    """A single span from 0 that leaves a non-blank tail behind a long enough prefix reaches the end."""
    n, only = F.length(text), spans[0]
    reach = (F.size(spans) == 1) & (only["start"] == 0) & (only["end"] < n) & (only["end"] >= F.greatest(F.lit(30), F.floor(n / 5))) & (F.trim(F.substring(text, only["end"] + 1, n)) != "")
    return F.when(reach, F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))).otherwise(spans)


def bio(offsets, spans) -> Column:
    """Token labels from spans: 0 outside, 1 the first of a run inside, 2 the next ones; -100 for (0, 0) tokens, which end a run."""

    def states(own):
        inside = lambda t: F.exists(own, lambda s: ~((t[1] <= s["start"]) | (t[0] >= s["end"])))
        return F.transform(offsets, lambda t: F.when((t[0] == 0) & (t[1] == 0), -1).when(inside(t), 1).otherwise(0))

    follows = lambda state, i: F.coalesce(F.try_element_at(state, F.when(i > 0, i)), F.lit(0)) == 1
    return let(let(spans, states), lambda state: F.transform(state, lambda x, i: F.when(x == -1, -100).when(x == 0, 0).when(follows(state, i), 2).otherwise(1)))


def word_runs(text, spans) -> Column:
    """Merged spans inside a text as runs of the words that they touch: (start, end) in words from 0, half open, merged.

    Words are runs of characters other than SQL_WHITE. They are counted before and in each span; no offsets are made.
    """
    cut = lambda s: (s["start"] > 0) & F.substring(text, s["start"], F.lit(2)).rlike(f"^[^{SQL_WHITE}]{{2}}")  # noqa: E731  the span starts within a word
    first = lambda s: sql_word_count(F.substring(text, F.lit(1), s["start"])) - cut(s).cast("int")
    pairs = F.transform(spans, lambda s: F.struct(first(s).alias("start"), sql_word_count(F.substring(text, s["start"] + 1, s["end"] - s["start"])).alias("n")))
    return merge(F.transform(F.filter(pairs, lambda r: r["n"] > 0), lambda r: F.struct(r["start"].alias("start"), (r["start"] + r["n"]).alias("end"))))


def run_labels(runs, n) -> Column:
    """Labels of n words from merged runs of words, as `bio` gives them: 0 outside, 1 the first of a run, 2 the next ones."""
    times = lambda label, k: F.array_repeat(F.lit(label), k)

    def of(own):
        before = lambda i: F.coalesce(F.get(own, i - 1)["end"], F.lit(0))
        parts = F.transform(own, lambda r, i: F.concat(times(0, r["start"] - before(i)), F.array(F.lit(1)), times(2, r["end"] - r["start"] - 1)))
        return F.concat(F.flatten(parts), times(0, n - before(F.size(own))))

    return let(runs, of)


def run_counts(runs, n) -> Column:
    """struct(o, b, i): how often `run_labels` of the same runs has 0, 1 and 2, by arithmetic alone."""
    whole = lambda x: x.cast("bigint")
    return let(runs, lambda own: F.struct(whole(n - total(own)).alias("o"), whole(F.size(own)).alias("b"), whole(total(own) - F.size(own)).alias("i")))


def window_bounds(offsets, labels) -> Column:
    """First and last character of a window's tokens that aren't special."""
    real = F.filter(F.arrays_zip(offsets.alias("o"), labels.alias("l")), lambda x: x["l"] != -100)
    return F.struct(F.try_element_at(real, F.lit(1))["o"][0].alias("start"), F.try_element_at(real, F.lit(-1))["o"][1].alias("end"))


def segments(spans, text, least: float = 0.5) -> Column:
    """A text in parts for display: AI (confidence above `least`), HUMAN (other spans) and NONE between them."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["confidence"] > least, "AI").otherwise("HUMAN").alias("label"))))
    n = F.length(text)
    ends = F.concat(F.array(F.lit(0)), F.transform(ordered, lambda s: s["end"]))
    starts = F.concat(F.transform(ordered, lambda s: s["start"]), F.array(n))
    gaps = F.filter(F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("start"), s.alias("end"), F.lit("NONE").alias("label"))), lambda p: p["end"] > p["start"])
    return F.transform(F.array_sort(F.concat(gaps, ordered)), lambda p: F.struct(p["label"].alias("label"), F.substring(text, p["start"] + 1, p["end"] - p["start"]).alias("text")))


def iou(a, b) -> Column:
    """Overlap of two spans over their union."""
    both = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    return F.coalesce(F.try_divide(both.cast("double"), (a["end"] - a["start"] + b["end"] - b["start"] - both).cast("double")), F.lit(0.0))


def greedy_matches(predicted, truth, least: float = 0.5) -> Column:
    """How many predicted spans, in order, find a true span of IoU `least` or more that is still free; the best one is taken."""
    state = F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("used"))

    def count(true):
        def step(a, p):
            scored = F.transform(true, lambda t, i: F.struct(F.when(F.array_contains(a["used"], i), F.lit(-1.0)).otherwise(iou(p, t)).alias("v"), (-i).alias("i")))
            hit = lambda best: F.coalesce(best["v"] >= least, F.lit(False))
            return let(F.array_max(scored), lambda best: F.struct((a["n"] + hit(best).cast("int")).alias("n"), F.when(hit(best), F.concat(a["used"], F.array(-best["i"]))).otherwise(a["used"]).alias("used")))

        return F.aggregate(predicted, state, step, lambda a: a["n"])

    return let(truth, count)


def top(spans, k: int = 5, by: str = "confidence") -> Column:
    """The k spans of highest confidence, best first; of equals, the one that starts first. Spans without confidence come last."""
    keyed = F.transform(spans, lambda s: F.struct((-F.coalesce(s[by].cast("double"), F.lit(float("-inf")))).alias("k"), s["start"].alias("b"), s["end"].alias("e"), s.alias("s")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["s"])
