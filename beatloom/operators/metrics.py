"""Predictions to decisions, record votes and metrics.

Everything per record or per class is a plain grouped aggregate, so partial sums
are formed before the shuffle and one large record or class does no harm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.functions.arrays import let
from beatloom.operators.ordered import running
from beatloom.session import cut_lineage


def ratio(top: Column, bottom: Column) -> Column:
    """Division where an empty denominator gives 0."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


# ---- scores to decisions ---------------------------------------------------


def softmax(logits: Column) -> Column:
    # Shifted by the largest logit so that exp cannot overflow.
    shifted = lambda s: F.transform(s["z"], lambda z: F.exp(z - s["top"]))
    share = lambda e: let(F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, x: a + x).alias("sum")), lambda t: F.transform(t["e"], lambda x: x / t["sum"]))
    return let(let(F.struct(logits.alias("z"), F.array_max(logits).alias("top")), shifted), share)


def sigmoid(logits: Column) -> Column:
    return F.transform(logits, lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def argmax(values: Column) -> Column:
    """Zero-based index of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def one_hot(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == index).cast("int"))


def above(probs: Column, line: float = 0.5) -> Column:
    return F.transform(probs, lambda p: (p > line).cast("int"))


# ---- losses ----------------------------------------------------------------

LOG_FLOOR = -100.0


def _safe_ln(p: Column) -> Column:
    return F.when(p <= 0, F.lit(LOG_FLOOR)).otherwise(F.greatest(F.ln(p), F.lit(LOG_FLOOR)))


def weighted_cross_entropy(df: DataFrame, prob_of_class: Column, weight: Column) -> Column:
    """Aggregate: weighted negative log likelihood, normalised by the weights."""
    return F.sum(weight * -_safe_ln(prob_of_class)) / F.sum(weight)


def mean_bce(probs: Column, labels: Column) -> Column:
    """Aggregate: binary cross-entropy averaged over every element."""
    each = F.zip_with(probs, labels, lambda p, y: -(y * _safe_ln(p) + (1 - y) * _safe_ln(1 - p)))
    return F.sum(F.aggregate(each, F.lit(0.0), lambda a, x: a + x)) / F.sum(F.size(probs))


# ---- record level ----------------------------------------------------------


def _exact(prob: Column) -> Column:
    """Decimal form whose sums do not depend on the order of rows."""
    return prob.cast("decimal(28,12)")


def record_scores(preds: DataFrame, record: str, n_classes: int, line: float = 0.5) -> DataFrame:
    """One row per record: sentences, votes and mean probability per class, labels,
    and the multi-label decision (a class is on with more than half of the votes)."""
    each = range(n_classes)
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    sums = [F.count("*").alias("n")]
    sums += [F.sum((at("probs", i) > line).cast("bigint")).alias(f"_v{i}") for i in each]
    sums += [(F.sum(_exact(at("probs", i))).cast("double") / F.count(at("probs", i))).alias(f"_p{i}") for i in each]
    sums += [F.max(at("labels", i)).alias(f"_y{i}") for i in each]
    wide = preds.groupBy(record).agg(*sums)
    pack = lambda tag: F.array(*[F.col(f"_{tag}{i}") for i in each])
    return wide.select(
        record,
        "n",
        pack("v").alias("votes"),
        pack("p").alias("probs"),
        pack("y").alias("labels"),
        F.transform(pack("v"), lambda v: (v * 2 > F.col("n")).cast("int")).alias("pred"),
    )


def record_class(preds: DataFrame, record: str) -> DataFrame:
    """Single-label vote: the class most sentences choose, the lowest on ties."""
    votes = preds.select(record, argmax(F.col("probs")).alias("class")).groupBy(record, "class").agg(F.count("*").alias("votes"))
    return votes.groupBy(record).agg(
        F.max_by("class", F.struct(F.col("votes"), -F.col("class"))).alias("class"), F.max("votes").alias("votes"), F.sum("votes").alias("n")
    )


# ---- metrics ---------------------------------------------------------------


def confusion(pred: Column, label: Column) -> list[Column]:
    return [
        F.count_if((pred == 1) & (label == 1)).alias("tp"),
        F.count_if((pred == 1) & (label == 0)).alias("fp"),
        F.count_if((pred == 0) & (label == 1)).alias("fn"),
        F.count_if((pred == 0) & (label == 0)).alias("tn"),
    ]


def rates(counts: DataFrame) -> DataFrame:
    """Sensitivity, specificity, precision and their geometric mean from the counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return counts.withColumns(
        {
            "sensitivity": sens,
            "specificity": spec,
            "precision": ratio(tp, tp + fp),
            "gmean": F.sqrt(sens * spec),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        }
    )


def multilabel_summary(df: DataFrame, n_classes: int) -> DataFrame:
    """Subset accuracy and macro F1 of array columns ``pred`` and ``labels`` in one pass."""
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    f1 = []
    for i in range(n_classes):
        p, y = at("pred", i), at("labels", i)
        f1.append(ratio(2 * F.count_if((p == 1) & (y == 1)), F.sum((p + y).cast("bigint"))))
    total = f1[0]
    for x in f1[1:]:
        total = total + x
    return df.agg(
        F.count("*").alias("n"), F.avg((F.col("pred") == F.col("labels")).cast("int")).alias("subset_accuracy"), (total / n_classes).alias("macro_f1")
    )


def long_scores(df: DataFrame) -> DataFrame:
    """(class, score, label) rows from array columns ``probs`` and ``labels``."""
    pairs = F.arrays_zip(F.col("probs").alias("p"), F.col("labels").alias("y"))
    return df.select(F.posexplode(pairs).alias("class", "x")).select("class", F.col("x.p").alias("score"), F.col("x.y").alias("label"))


def class_auroc(scores: DataFrame) -> DataFrame:
    """Tie-aware area under the ROC curve per class; NULL without both outcomes.

    Rows collapse to one per (class, score), stored since the running count of negatives looks
    at them more than once; the count is taken in pieces, so a class of any size splits."""
    per_score = scores.groupBy("class", "score").agg(
        F.sum(F.col("label").cast("bigint")).alias("pos"), F.sum((1 - F.col("label")).cast("bigint")).alias("neg")
    )
    below = running(cut_lineage(per_score), ["class"], ["score"], "neg", "neg_below")
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return below.groupBy("class").agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.try_divide(won, pairs).alias("auroc"))


def macro_auroc(scores: DataFrame) -> DataFrame:
    """Mean over the classes that have both outcomes."""
    return class_auroc(scores).agg(F.avg("auroc").alias("macro_auroc"), F.count("auroc").alias("classes"))


def masked_token_accuracy(df: DataFrame, guess: str, target: str, ignored: list[int]) -> DataFrame:
    real = ~F.col(target).isin(ignored)
    hit = F.count_if(real & (F.col(guess) == F.col(target)))
    return df.agg(F.count_if(real).alias("valid"), hit.alias("correct"), F.round(ratio(hit, F.count_if(real)), 6).alias("accuracy"))


def weighted_loss(df: DataFrame, keys: list[str], loss_sum: Column, n: Column) -> DataFrame:
    """Mean loss over unequal batches: summed loss over summed sizes, at least 1."""
    return df.groupBy(*keys).agg((F.sum(loss_sum) / F.greatest(F.sum(n), F.lit(1))).alias("loss"))


def seed_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric across seeds."""
    aggs = [F.count("*").alias("seeds")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return df.groupBy(*keys).agg(*aggs)


WORD = 62  # members per mask


def _by_member(preds: DataFrame, keys: list[str], member: str, prob: str, members: int | list) -> DataFrame:
    """Per row: sum of the probabilities, predictions, and distinct members. Where the members are listed,
    each is a bit, so that one grouping counts them; else they are grouped first."""
    if isinstance(members, int):
        once = preds.groupBy(*keys, member).agg(F.sum(_exact(F.col(prob))).alias("_sum"), F.count("*").alias("_n"))
        return once.groupBy(*keys).agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"), F.count("*").alias("members"))
    at = F.array_position(F.array(*[F.lit(m) for m in members]), F.col(member)) - 1
    bit = lambda w: F.when((at >= w * WORD) & (at < (w + 1) * WORD), F.call_function("shiftleft", F.lit(1).cast("bigint"), (at - w * WORD).cast("int"))).otherwise(0)
    words = range(-(-len(members) // WORD))
    rows = preds.groupBy(*keys).agg(F.sum(_exact(F.col(prob))).alias("_sum"), F.count("*").alias("_n"), *[F.bit_or(bit(w)).alias(f"_w{w}") for w in words])
    seen = sum((F.bit_count(f"_w{w}") for w in words), F.lit(0)).cast("bigint")
    return rows.withColumn("members", seen).drop(*[f"_w{w}" for w in words])


def ensemble(preds: DataFrame, keys: list[str], member: str, prob: str, members: int | list) -> DataFrame:
    """Mean probability over ensemble members (their number, or the list of them), for rows that every member scored once."""
    count = members if isinstance(members, int) else len(members)
    rows = _by_member(preds, keys, member, prob, members).filter((F.col("members") == count) & (F.col("_n") == count))
    return rows.select(*keys, (F.col("_sum").cast("double") / F.col("_n")).alias("prob"), "members")


def alignment_gaps(preds: DataFrame, keys: list[str], member: str, prob: str, members: int | list) -> DataFrame:
    """Rows that some member did not score, or scored twice: must be empty for an aligned ensemble."""
    count = members if isinstance(members, int) else len(members)
    rows = _by_member(preds, keys, member, prob, members).filter((F.col("members") != count) | (F.col("_n") != count))
    return rows.select(*keys, "members", F.col("_n").alias("predictions"))
