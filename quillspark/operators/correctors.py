"""Pluggable correctors: functions from a list of texts to a list of texts, run in Arrow batches."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import error_rate, improvement
from . import windows as W

Corrector = Callable[[list[str]], list[str]]


class Late(Exception):
    """A corrector took too long."""


@contextmanager
def limit(seconds: float | None) -> Iterator[None]:
    """Raises Late in the block after so many seconds, where the platform's timers allow it (a worker's main thread)."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def ring(*_: object) -> None:
        raise Late

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


#: Rows whose corrected texts are handed back together.
HANDED = 1024


def correct(df: DataFrame, text: str, corrector: Corrector, out: str = "pred_text", error: str = "error", seconds: float | None = 120, at_once: int = 64) -> DataFrame:
    """The texts corrected, at_once at a time. A group that fails or takes longer than one text may is tried again text by text; a text that fails, or takes
    longer than so many seconds, has null and its error's name, and the others go on."""
    return _corrected(df, text, {(out, error): corrector}, seconds, at_once)


def _corrected(df: DataFrame, text: str, models: dict[tuple[str, str], Corrector], seconds: float | None, at_once: int = 64) -> DataFrame:
    """Columns of texts and errors for each model. One worker of a task runs all models; it holds Python's texts of at_once rows, and the results of HANDED."""

    def one(corrector: Corrector, x: str) -> tuple[str | None, str | None]:
        try:
            with limit(seconds):
                return corrector([x])[0], None
        except Exception as failed:
            return None, type(failed).__name__

    def group(corrector: Corrector, texts: list[str | None]) -> list[tuple[str | None, str | None]]:
        given = [x for x in texts if x is not None]
        try:
            with limit(seconds):
                got = iter(corrector(given) if given else [])
            return [(None, None) if x is None else (next(got), None) for x in texts]
        except Exception:
            return [(None, None) if x is None else one(corrector, x) for x in texts]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for start in range(0, len(texts), HANDED):
                part, parts = texts.slice(start, HANDED), [[] for _ in range(2 * len(models))]
                for at in range(0, len(part), at_once):
                    every = part.slice(at, at_once).to_pylist()
                    for k, corrector in enumerate(models.values()):
                        for c, values in enumerate(zip(*group(corrector, every), strict=True)):
                            parts[2 * k + c].append(pa.array(values, pa.string()))
                yield pa.StructArray.from_arrays([pa.concat_arrays(p) for p in parts], [f"c{k}" for k in range(len(parts))])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    names = [name for pair in models for name in pair]
    every = F.arrow_udf(run, ", ".join(f"c{k} string" for k in range(len(names))))(F.col(text))
    held = df.withColumn("__all", every)
    return held.withColumns({name: F.col("__all").getField(f"c{k}") for k, name in enumerate(names)}).drop("__all")


def correct_by_all(df: DataFrame, text: str, models: dict[str, Corrector], seconds: float | None = 120) -> DataFrame:
    """A column of predictions for each named model, and one of its errors (<name>_error). A model that fails on a text takes nothing from the others."""
    return _corrected(df, text, {(name, f"{name}_error"): model for name, model in models.items()}, seconds)


def correct_disjoint(df: DataFrame, key: str, text: str, corrector: Corrector, size: int = 50) -> DataFrame:
    """key and text, corrected in windows side by side that are joined again. Empty texts have no row."""
    parts = W.windows(df.select(key, text), text, "disjoint", size)
    return W.stitched(correct(parts, text, corrector, text).select(key, "start", text), key, "start", text)


def correct_ngrams(df: DataFrame, key: str, text: str, corrector: Corrector, size: int = 50, weighting: str = "uniform") -> DataFrame:
    """key and text, corrected in all full windows that then vote on each place."""
    parts = W.windows(df.select(key, text).withColumn("n", F.length(text)), text, "full", size)
    return W.elected(W.votes(correct(parts, text, corrector, text), key, "n", text, weighting, size), key).withColumnRenamed("text", text)


def evaluation_grid(df: DataFrame, key: str, ocr: str, gt: str, decoders: dict[str, Corrector], size: int, distance: Callable[[Column, Column], Column]) -> DataFrame:
    """decoding, window, window_size, weighting, cer_before, cer_after, improvement for each decoder with disjoint windows of two sizes and sliding ones of three weightings.

    One plan: the cells' corrected texts are put one under the other and aggregated together.
    """
    cells = [("disjoint", s, None) for s in (size, 2 * size)] + [("sliding", size, w) for w in ("uniform", "triangle", "bell")]
    every = []
    for decoding, corrector in decoders.items():
        for window, n, weighting in cells:
            done = correct_disjoint(df, key, ocr, corrector, n) if weighting is None else correct_ngrams(df, key, ocr, corrector, n, weighting)
            cell = (F.lit(decoding).alias("decoding"), F.lit(window).alias("window"), F.lit(n).alias("window_size"), F.lit(weighting).cast("string").alias("weighting"))
            every.append(done.select(F.col(key).alias("__key"), F.col(ocr).alias("__fixed"), *cell))
    joined = reduce(DataFrame.unionByName, every).join(df.select(F.col(key).alias("__key"), F.col(ocr).alias("__ocr"), F.col(gt).alias("__gt")), "__key")
    rate = lambda c: F.avg(error_rate(distance(F.col(c), F.col("__gt")), F.length("__gt")))
    rates = joined.groupBy("decoding", "window", "window_size", "weighting").agg(rate("__ocr").alias("cer_before"), rate("__fixed").alias("cer_after"))
    return rates.withColumn("improvement", improvement(F.col("cer_before"), F.col("cer_after")))
