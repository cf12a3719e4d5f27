"""Vector and scalar expressions: all JVM-side, in index order, so results are repeatable."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column, floor: float = 1e-8) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(floor))


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def gaussian(t: Column, center: Column, sigma: float, height: float = 1.0) -> Column:
    """height * exp(-(t - center)^2 / (2 sigma^2)); without a width, height at the center's whole part."""
    if sigma <= 0:
        return F.when(t == center.cast("int"), F.lit(height)).otherwise(F.lit(0.0))
    return F.lit(height) * F.exp(-F.pow(t - center, F.lit(2.0)) / F.lit(2 * sigma * sigma))


def temporal_decay(i: Column, j: Column, gamma: float = 0.001) -> Column:
    return F.exp(-F.lit(gamma) * F.pow(i - j, F.lit(2.0)))


def min_max(x: Column, by: Window, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Rescaled to [lo, hi] in each partition; its middle where all values are alike."""
    a, b = F.min(x).over(by), F.max(x).over(by)
    return F.when(b - a < 1e-8, F.lit((lo + hi) / 2)).otherwise(F.lit(lo) + (x - a) / (b - a) * (hi - lo))


def softmax(x: Column, by: Window, temperature: float = 0.1) -> Column:
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    e = F.exp((x - F.max(x).over(by)) / temperature)
    return e / F.sum(e).over(by)


def uniform_indices(n: Column, count: int) -> Column:
    """count indices spread evenly over 0..n-1, truncated, distinct; all of them if n <= count."""
    some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: (i * (n - 1) / F.lit(max(1, count - 1))).cast("int")))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= count, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(some)


def _window(lo: Column, hi: Column, n: Column, count: int) -> Column:
    """count frames spread evenly over lo..hi, both moved into 0..n-1."""
    a, z = (F.greatest(F.least(x.cast("int"), (n - 1).cast("int")), F.lit(0)) for x in (lo, hi))
    return F.transform(uniform_indices(F.greatest(a, z) - F.least(a, z) + 1, count), lambda i: F.least(a, z) + i)


def temporal_focus(n: Column, question: Column, count: int, fps: float = 1.0) -> Column:
    """Frames of 0..n-1 at the times a question names: its first or last minutes or seconds, the start, the end, and
    quarters for questions of order. Sorted, distinct, thinned evenly to count."""
    q, none = F.coalesce(F.lower(question), F.lit("")), F.array().cast("array<int>")
    if count <= 0:
        return none
    span = lambda word: r"\b" + word + r"\s+(\d+)\s*(seconds?|secs?|minutes?|mins?)\b"
    frames = lambda word: (F.regexp_extract(q, span(word), 1).try_cast("double") * F.when(F.regexp_extract(q, span(word), 2).contains("min"), 60).otherwise(1) * fps).cast("int")
    # The words below, and the parts of a video that they stand for.
    tenth = (n * 0.1).cast("int")
    quarters = F.array(F.lit(0), *((n * x).cast("int") for x in (0.25, 0.5, 0.75)), (n - 1).cast("int"))
    parts = [
        F.when(q.rlike(span("first")), _window(F.lit(0), frames("first"), n, min(4, count))),
        F.when(q.rlike(span("last")), _window(F.greatest(n - frames("last") - 1, F.lit(0)), n - 1, n, min(4, count))),
        F.when(q.rlike(r"\b(beginning|start|first|early)\b"), _window(F.lit(0), tenth, n, min(3, count))),
        F.when(q.rlike(r"\b(end|last|final|finally|later)\b"), _window(F.greatest(n - F.greatest(tenth, F.lit(1)), F.lit(0)), n - 1, n, min(3, count))),
        F.when(q.rlike(r"\b(before|after|then|next|previous|order|sequence)\b"), quarters),
    ]
    every = F.array_sort(F.array_distinct(F.concat(*(F.coalesce(p, none) for p in parts))))
    thin = F.when(F.size(every) > count, F.transform(uniform_indices(F.size(every), count), lambda i: F.get(every, i))).otherwise(every)
    return F.when(n > 0, thin).otherwise(none)


def focused_indices(n: Column, question: Column, temporal: Column, count: int, fps: float = 1.0) -> Column:
    """temporal_focus() first, then evenly spread frames, count in all; only the latter for other questions."""
    base = uniform_indices(n, count)
    both = F.array_sort(F.slice(F.array_distinct(F.concat(temporal_focus(n, question, count, fps), base)), 1, max(1, count)))
    return F.when(temporal, both).otherwise(base)
