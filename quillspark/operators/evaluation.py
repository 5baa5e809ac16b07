"""Statistics of error rates, and precision and recall of marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.editing import aligned_column, with_word_distances, words
from ..functions.text import MARKS, edit_distance, error_rate, has_residual_command, improvement, mask_inline_prediction, mask_inline_target
from ..storage import stored
from .confusion import aligned_pairs
from .quantiles import quantiles


QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """By group count, mean, sample deviation, minimum, quartiles (exact, linear) and maximum."""
    kind = df.schema[column].dataType
    rows = quantiles(df, by, {column: F.col(column)}, QUARTILES)
    return rows.select(*by, "n", "mean", "std", F.col("min").cast(kind).alias("min"), *(F.col("q")[k].alias(f"q{p}") for k, p in enumerate((25, 50, 75))), F.col("max").cast(kind).alias("max"))


def spread(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """By group count, mean, median, deviation and interquartile range."""
    rows = quantiles(df, by, {column: F.col(column)}, QUARTILES)
    return rows.select(*by, "n", "mean", F.col("q")[1].alias("median"), "std", (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def better_worse(before: Column, after: Column) -> list[Column]:
    """Rows that got worse, and all others (ties and unknown ones too), as counts and parts of all rows."""
    worse = F.count(F.when(F.coalesce(before < after, F.lit(False)), 1))
    return [worse.alias("worse"), (F.count(F.lit(1)) - worse).alias("not_worse"), (100.0 * worse / F.count(F.lit(1))).alias("worse_pct")]


def mark_counts(pairs: DataFrame, target: str, predicted: str, marks: dict[str, str]) -> DataFrame:
    """By mark name: true and false positives, false negatives, and how many the target has. pairs: aligned characters, a row each.

    A target mark that is predicted as another mark is a false positive of that one and no false negative of its own.
    """
    t, p = F.col(target), F.col(predicted)
    signs = list(marks.values())
    tm, pm = t.isin(signs), p.isin(signs)
    entry = lambda sign, tp, fp, fn, n: F.struct(sign.alias("sign"), *(F.lit(x).alias(c) for c, x in zip(("tp", "fp", "fn", "n"), (tp, fp, fn, n), strict=True)))
    events = (
        F.when(tm & (t == p), F.array(entry(t, 1, 0, 0, 1)))
        .when(tm & pm, F.array(entry(t, 0, 0, 0, 1), entry(p, 0, 1, 0, 0)))
        .when(tm, F.array(entry(t, 0, 0, 1, 1)))
        .when(pm, F.array(entry(p, 0, 1, 0, 0)))
    )
    summed = pairs.filter(tm | pm).select(F.explode(events).alias("e")).select("e.*").groupBy("sign").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n")))
    names = F.create_map(*(F.lit(x) for name, sign in marks.items() for x in (sign, name)))
    return summed.select(names[F.col("sign")].alias("mark"), "tp", "fp", "fn", "n")


def mark_metrics(df: DataFrame, target: str, predicted: str, marks: dict[str, str] = MARKS) -> DataFrame:
    """Counts, precision, recall and F1 of the marks of predictions of any length: each pair of texts is aligned first, and marks are compared place by place."""
    aligned = df.select(aligned_column(F.col(predicted), F.col(target)).alias("a")).select("a.gt_aligned", "a.ocr_aligned")
    pairs = aligned_pairs(aligned, "gt_aligned", "ocr_aligned")
    return precision_recall(mark_counts(pairs, "pdf_letters", "ocr_letters", marks))


def precision_recall(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1: 0 where a denominator is 0, null for marks that the target never has."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    seen = lambda c: F.when(F.col("n") > 0, c)
    return counts.withColumn("precision", seen(ratio(tp, tp + fp))).withColumn("recall", seen(ratio(tp, tp + fn))).withColumn("f1", seen(ratio(2 * tp, 2 * tp + fp + fn)))


def report(df: DataFrame, **rates: tuple[str, str]) -> DataFrame:
    """The whole report as rows of metric and value: for each named rate with its columns before and after, mean, median, deviation and interquartile range of both
    and of the improvement, and the per cent of rows that did not get worse; all rounded to two places. All quartiles are found in the same passes."""
    df = stored(df.select(*dict.fromkeys(c for pair in rates.values() for c in pair)), "report-rates")
    values = {}
    for name, (before, after) in rates.items():
        values |= {f"{name}_before": F.col(before), f"{name}_after": F.col(after), f"{name}_improvement": improvement(F.col(before), F.col(after))}
    worse = {name: F.count(F.when(F.coalesce(F.col(before) < F.col(after), F.lit(False)), 1)) for name, (before, after) in rates.items()}
    wide = df.agg(*(F.try_divide(100.0 * (F.count(F.lit(1)) - w), F.count(F.lit(1))).alias(f"{name}_not_worse") for name, w in worse.items()))
    found = quantiles(df, [], values, QUARTILES).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("mean", "std", "q")))).alias("s"))
    # a row each
    rows = wide.join(found, how="left", on=F.lit(True))
    stats = []
    for k in values:
        s = F.try_element_at("s", F.lit(k))
        of = {"mean": s["mean"], "median": s["q"][1], "std": s["std"], "iqr": s["q"][2] - s["q"][0]}
        stats += [F.round(x, 2).alias(f"{k}_{name}") for name, x in of.items()]
    flat = rows.select(*stats, *(F.round(f"{name}_not_worse", 2).alias(f"{name}_not_worse") for name in rates))
    return flat.unpivot([], flat.columns, "metric", "value")


def fixed(df: DataFrame, ocr: str = "ocr", target: str = "target", predicted: str = "predicted", marks: dict[str, str] = MARKS) -> DataFrame:
    """The rows with texts in which math, citations and references are marks, and error rates in characters and words (cer_, wer_) against the target:
    of the OCR text (orig) and the prediction (corr) as they are, of the fixed prediction (fix_corr) and of the OCR text (fix) against the fixed target.

    evaluated is false, and all that is new null, where a text is null, dollars in the target do not pair, or the fixed target still has
    control sequences. No row is dropped.
    """

    def fix(text: Column) -> Column:
        return markup.mask_commands_column(markup.mask_commands_column(text, "\\cite", marks["cite"]), "\\ref", marks["ref"])

    whole = df.withColumn("target_fixed", fix(mask_inline_target(F.col(target), marks["inline"]))).withColumn("predicted_fixed", fix(mask_inline_prediction(F.col(predicted), marks["inline"])))
    known = F.col(ocr).isNotNull() & F.col(predicted).isNotNull() & F.col("target_fixed").isNotNull()
    whole = whole.withColumn("evaluated", F.coalesce(known & ~has_residual_command(F.col("target_fixed")), F.lit(False)))
    shown = lambda c: F.when(F.col("evaluated"), F.col(c))
    whole = whole.withColumn("target_fixed", shown("target_fixed")).withColumn("predicted_fixed", shown("predicted_fixed"))
    pairs = {"orig": (ocr, target), "corr": (predicted, target), "fix_corr": ("predicted_fixed", "target_fixed"), "fix": (ocr, "target_fixed")}
    rows = with_word_distances(whole, **{f"__wer_{name}": pair for name, pair in pairs.items()})
    rate = lambda edits, size: F.when(F.col("evaluated"), error_rate(edits, size))
    cers = {f"cer_{name}": rate(edit_distance(F.col(a), F.col(b)), F.length(b)) for name, (a, b) in pairs.items()}
    wers = {f"wer_{name}": rate(F.col(f"__wer_{name}"), words(F.col(b))) for name, (_, b) in pairs.items()}
    return rows.withColumns(cers | wers).drop(*(f"__wer_{name}" for name in pairs))
