"""Coverage, displacement errors by horizon, classification reports and running bests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .joins import assert_unique


def coverage(expected: DataFrame, attempted: DataFrame, id_col: str, valid: str) -> DataFrame:
    """Every id of either side with its class: valid, invalid, missing or extra. attempted has a boolean column `valid`."""
    e = expected.select(id_col).distinct().withColumn("_e", F.lit(True))
    a = attempted.groupBy(id_col).agg(F.max(valid).alias("_v"), F.count("*").alias("_n"))
    kind = F.when(F.col("_e").isNull(), "extra").when(F.col("_n").isNull(), "missing").when(F.col("_v"), "valid").otherwise("invalid")
    return e.join(a, id_col, "full_outer").select(id_col, kind.alias("kind"))


class CoverageError(ValueError):
    """A strict evaluation without exactly one valid prediction per expected id."""


def matched(references: DataFrame, predictions: DataFrame, strict: bool = True) -> DataFrame:
    """References (sample_id, ...) with their valid predictions (sample_id, status, error, ...), prediction columns prefixed `p_`.

    Ids must be unique on both sides, and references are not empty. strict: any id that is missing, failed or not expected is an error.
    """
    for rows in (references, predictions):
        assert_unique(rows, "sample_id")
    if references.isEmpty():
        raise ValueError("no references")
    if strict:
        odd = problems(references, predictions).limit(5).collect()
        if odd:
            raise CoverageError(f"coverage is not exact: {[(r['sample_id'], r['kind'], r['reason']) for r in odd]}")
    good = predictions.where(F.coalesce("status", F.lit("ok")) == "ok")
    named = good.select("sample_id", *[F.col(c).alias(f"p_{c}") for c in good.columns if c != "sample_id"])
    return references.join(named, "sample_id")


def problems(references: DataFrame, predictions: DataFrame) -> DataFrame:
    """(sample_id, kind, reason) of ids that are missing, invalid or extra; the reason of invalid ones is their error, or else their status."""
    status = F.coalesce("status", F.lit("ok"))
    a = predictions.select("sample_id", (status == "ok").alias("_ok"), F.coalesce("error", F.concat(F.lit("generation status is "), status)).alias("_reason"))
    both = coverage(references, a, "sample_id", "_ok").where("kind <> 'valid'")
    return both.join(a.select("sample_id", "_reason"), "sample_id", "left").select("sample_id", "kind", F.when(F.col("kind") == "invalid", F.col("_reason")).alias("reason"))


def coverage_report(classes: DataFrame) -> DataFrame:
    """One row of counts and fractions of coverage()."""
    n = {k: F.count_if(F.col("kind") == k) for k in ("valid", "invalid", "missing", "extra")}
    expected = n["valid"] + n["invalid"] + n["missing"]
    return classes.agg(
        expected.alias("expected"), *[v.alias(k) for k, v in n.items()],
        F.coalesce(F.try_divide(n["valid"], expected), F.lit(0.0)).alias("valid_fraction"),
        F.coalesce(F.try_divide(n["valid"] + n["invalid"], expected), F.lit(0.0)).alias("attempted_fraction"),
        (F.count_if(F.col("kind") != "valid") == 0).alias("exact"),
    )


def distances(pairs: DataFrame, truth: str, predicted: str, keep: tuple[str, ...]) -> DataFrame:
    """(keep, t, dist) of two arrays of points (x, y), t from 1."""
    steps = F.arrays_zip(F.col(truth).alias("a"), F.col(predicted).alias("b"))
    p = pairs.select(*keep, F.posexplode(steps).alias("t", "p"))
    a, b = F.col("p")[truth], F.col("p")[predicted]
    return p.select(*keep, (F.col("t") + 1).alias("t"), F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2).alias("dist"))


def displacement(steps: DataFrame, horizons: tuple[float, ...], hz: float) -> DataFrame:
    """(horizon, steps, ade, fde, samples) of (t, dist): mean over the first steps, and at the last of them.

    One pass: each horizon is a conditional aggregate, so rows are not multiplied by horizons.
    """
    counts = [round(s * hz) for s in horizons]
    if len(set(counts)) < len(counts) or min(counts) < 1:
        raise ValueError("horizons must be distinct and at least one step")
    t, d = F.col("t"), F.col("dist")
    row = steps.agg(*[x for n in counts for x in (F.avg(F.when(t <= n, d)).alias(f"ade_{n}"), F.avg(F.when(t == n, d)).alias(f"fde_{n}"), F.count_if(t == n).alias(f"n_{n}"))])
    rows = F.array(*[F.struct(F.lit(f"{s:g}s").alias("horizon"), F.lit(n).alias("steps"), F.col(f"ade_{n}").alias("ade"), F.col(f"fde_{n}").alias("fde"), F.col(f"n_{n}").alias("samples")) for s, n in zip(horizons, counts)])
    return row.select(F.inline(rows))


def classification(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per observed label precision, recall, f1 and support, with accuracy and macro_f1 of all; 0/0 counts as 0."""
    counts = pairs.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("t").alias("label"), F.lit(True).alias("is_t")), F.struct(F.col("p").alias("label"), F.lit(False).alias("is_t")))
    each = counts.select("t", "p", "n", F.explode(sides).alias("s")).select("t", "p", "n", "s.*")
    hit = F.col("t") == F.col("p")
    per = each.groupBy("label").agg(
        F.sum(F.when(hit & F.col("is_t"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("is_t"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("is_t"), F.col("n")).otherwise(0)).alias("predicted")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.select("label", "support", "tp", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))
    everything = Window.partitionBy()  # a row per label: a vocabulary, not the data
    return per.select("label", "support", "precision", "recall", "f1", ratio(F.sum("tp").over(everything), F.sum("support").over(everything)).alias("accuracy"), F.avg("f1").over(everything).alias("macro_f1"))


def running_best(rows: DataFrame, group: str, order: tuple[str, ...], metric: str) -> DataFrame:
    """rows with best, the smallest metric so far in the group, and is_best where it falls."""
    w = Window.partitionBy(group).orderBy(*order)
    before = F.min(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("best", F.min(metric).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("is_best", F.coalesce(F.col(metric) < before, F.lit(True)))


def masked_ade(truth: Column, predicted: Column, mask: Column) -> Column:
    """Mean distance over the valid steps of arrays of points; 0 where none is valid."""
    d = F.zip_with(truth, predicted, lambda a, b: F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2))
    total = F.aggregate(F.zip_with(d, mask, lambda x, m: F.when(m, x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return total / F.greatest(F.size(F.filter(mask, lambda m: m)), F.lit(1))


def masked_last(truth: Column, predicted: Column, mask: Column) -> Column:
    """Distance at the step whose place is the number of valid steps less one, as the metric is defined; null where none is valid."""
    n = F.size(F.filter(mask, lambda m: m))
    a, b = F.get(truth, n - 1), F.get(predicted, n - 1)
    return F.when(n > 0, F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def kl_loss(mean: Column, log_variance: Column) -> Column:
    """Divergence of diagonal normals from the standard one, the mean over their numbers; null for none."""
    terms = F.zip_with(mean, log_variance, lambda m, v: 1 + v - m * m - F.exp(v))
    return F.when(F.size(terms) > 0, -0.5 * _total(terms) / F.size(terms))


def smooth_l1(difference: Column) -> Column:
    """Half the square below one, else the size less one half."""
    d = F.abs(difference)
    return F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)


def cross_entropy(scores: Column, index: Column) -> Column:
    """Minus the log of the softmax at index (from 0); null for an index outside."""
    top = F.array_max(scores)
    return top + F.log(_total(F.transform(scores, lambda x: F.exp(x - top)))) - F.get(scores, index)


def winner_loss(modes: Column, scores: Column, target: Column, valid: Column) -> Column:
    """Struct of one row's loss terms: assigned, the mode (from 0) whose point at the last step, by number of valid ones, is nearest to the
    target's (the first of equals), steps, the valid steps, regression, the sum of smooth L1 over these, and classification, the cross-entropy of assigned.

    modes: array of arrays of points (x, y). A batch's loss is sum(regression) / sum(steps) + avg(classification). Null without a valid step.
    """
    steps = F.size(F.filter(valid, lambda v: v))
    at = lambda path: F.get(path, steps - 1)
    away = F.transform(modes, lambda m: F.hypot(at(m)["x"] - at(target)["x"], at(m)["y"] - at(target)["y"]))
    made = let(away, lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int"))

    def build(k: Column) -> Column:
        term = F.zip_with(F.get(modes, k), target, lambda p, t: smooth_l1(p["x"] - t["x"]) + smooth_l1(p["y"] - t["y"]))
        kept = F.zip_with(term, valid, lambda e, v: F.when(v, e).otherwise(0.0))
        return F.struct(k.alias("assigned"), steps.alias("steps"), _total(kept).alias("regression"), cross_entropy(scores, k).alias("classification"))

    return F.when(steps > 0, let(made, build))


def vector_metric(rows: DataFrame, p: str, q: str, lambda_cos: float = 0.4) -> DataFrame:
    """One row of mse over all elements, the mean cosine and mse + lambda_cos (1 - cos), of two columns of arrays of like width. Norms count as 1e-8 at least."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda c: F.greatest(F.sqrt(dot(c, c)), F.lit(1e-8))
    square = total(F.zip_with(p, q, lambda x, y: (x.cast("double") - y.cast("double")) ** 2))
    each = rows.select(square.alias("s"), F.size(p).alias("n"), (dot(p, q) / (norm(p) * norm(q))).alias("c"))
    m = each.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mse"), F.avg("c").alias("cosine"))
    return m.withColumn("combined", F.col("mse") + lambda_cos * (1 - F.col("cosine")))


def pooled(vectors: Column, mask: Column) -> Column:
    """Struct of mean and largest, by component, of the vectors of an array whose mask is true; zeros where none is. Vectors are of one width. Numbers that are null
    take no part; a component that has no other is null."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: F.coalesce(x["m"], F.lit(False))), lambda x: x["v"])
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))

    def both(k: Column) -> Column:
        of = lambda f: F.transform(F.get(k, F.lit(0)), lambda _, i: f(F.transform(k, lambda v: F.get(v, i).cast("double"))))
        mean = of(lambda a: let(F.filter(a, lambda x: x.isNotNull()), lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), F.size(v))))
        some = F.size(k) > 0
        return F.struct(F.when(some, mean).otherwise(zero).alias("mean"), F.when(some, of(F.array_max)).otherwise(zero).alias("largest"))

    return let(kept, both)
