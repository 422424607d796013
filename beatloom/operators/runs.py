"""Run tables: epoch curves, best-epoch rules, run tags, upserts, manifests."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.operators.ordered import CELL, folded, ranked, windowed

SMOOTHING = 5

# The smallest gain in G-mean that counts, and run settings by default.
GMEAN_DELTA = 0.005
DEFAULT_HEAD_FACTOR = "0.1"
DEFAULT_ALPHA = "16"


# ---- epoch curves ----------------------------------------------------------


def trailing_mean(epochs: DataFrame, keys: list[str], metrics: list[str], window: int = SMOOTHING, cell: int = CELL) -> DataFrame:
    """Mean of the last ``window`` epochs per metric, NULL when any of them is missing, and whether the
    window is full. The neighbours are rows, not epoch numbers, so gaps in the numbers do not matter;
    rows are numbered first, and a run of any length splits into cells of numbered rows."""

    def add(frame) -> dict[str, Column]:
        over = frame(-(window - 1), 0)
        rows = F.count(F.lit(1)).over(over)
        return {**{f"{m}_smooth": F.when(F.count(m).over(over) == rows, F.avg(m).over(over)) for m in metrics}, "full": rows == window}

    placed = ranked(epochs, keys, ["epoch", *metrics], out="_pos")
    return windowed(placed, keys, "_pos", window - 1, 0, add, max(cell, window)).drop("_pos")


class BestEpoch:
    """Walk along a run: remembers the best values and their epoch, counts epochs without gain, and stops when
    ``patience`` of them follow each other. ``gains(best, values)`` tells whether an epoch is better; ``keeps``
    gives the new best values. A missing or NaN value is no gain."""

    def __init__(self, start: tuple[float, ...], gains: Callable[[tuple, tuple], bool], keeps: Callable[[tuple, tuple], tuple], patience: int):
        self.best, self.gains, self.keeps, self.patience = start, gains, keeps, patience
        self.epoch = self.stop = self.at_best = None
        self.bad = self.seen = 0

    def step(self, epoch: int, *values) -> None:
        self.seen += 1
        if self.stop is not None:
            return
        if self.gains(self.best, values):
            self.best, self.epoch, self.at_best, self.bad = self.keeps(self.best, values), epoch, values, 0
        else:
            self.bad += 1
            if self.bad >= self.patience:
                self.stop = epoch

    def end(self) -> tuple:
        return self.epoch, self.stop, self.seen, *(self.at_best or ())


def _best(epochs: DataFrame, keys: list[str], metrics: list[str], walk: Callable[[], BestEpoch], shown: int | None = None) -> DataFrame:
    """(keys, best_epoch, stop_epoch, epochs, at_best): ``at_best`` holds the metrics of the best epoch."""
    double = {f"_m{k}": ("double", pa.float64()) for k in range(len(metrics))}
    fields = {name: ("int", pa.int32()) for name in ("best_epoch", "stop_epoch", "epochs")} | double
    rows = epochs.select(*keys, F.col("epoch").cast("int").alias("epoch"), *[F.col(m).cast("double").alias(m) for m in metrics])
    ends = folded(rows, keys, ["epoch", *metrics], ["epoch", *metrics], lambda: _Padded(walk(), len(metrics)), fields)
    at = F.struct(*[F.col(f"_m{k}").alias(m) for k, m in enumerate(metrics[:shown])])
    return ends.select(*keys, "best_epoch", "stop_epoch", "epochs", at.alias("at_best"))


class _Padded:
    """A run without a best epoch has missing metrics there."""

    def __init__(self, walk: BestEpoch, metrics: int):
        self.step, self.walk, self.width = walk.step, walk, 3 + metrics

    def end(self) -> tuple:
        found = self.walk.end()
        return found + (None,) * (self.width - len(found))


def _more(a: float | None, b: float, delta: float = 0.0) -> bool:
    return a is not None and a - b > delta


def best_epoch_by_loss(epochs: DataFrame, keys: list[str], loss: str, delta: float, patience: int) -> DataFrame:
    """Best epoch = last one whose loss is lower than the best so far by more than ``delta``."""
    gains = lambda best, x: x[0] is not None and best[0] - x[0] > delta
    return _best(epochs, keys, [loss], lambda: BestEpoch((float("inf"),), gains, lambda best, x: x, patience))


def best_epoch_by_gmean(epochs: DataFrame, keys: list[str], gmean: str, auroc: str, patience: int, delta: float = GMEAN_DELTA) -> DataFrame:
    """Higher G-mean by more than ``delta`` wins; within it, the higher AUROC. A missing AUROC
    is no gain, and none later counts as higher than it."""

    def gains(best: tuple, x: tuple) -> bool:
        if x[0] is None:
            return False
        gain = x[0] - best[0]
        return gain > delta or (abs(gain) <= delta and x[1] is not None and x[1] > best[1])

    keeps = lambda best, x: (x[0], float("nan") if x[1] is None else x[1])
    return _best(epochs, keys, [gmean, auroc], lambda: BestEpoch((float("-inf"),) * 2, gains, keeps, patience))


def best_epoch_smoothed(epochs: DataFrame, keys: list[str], auroc: str, acc_col: str, delta: float, patience: int) -> DataFrame:
    """Gain in the smoothed AUROC, or in smoothed accuracy where AUROC is missing,
    counted once the smoothing window is full."""
    smooth = trailing_mean(epochs, keys, [auroc, acc_col])
    metrics = [f"{auroc}_smooth", f"{acc_col}_smooth"]
    gains = lambda best, x: bool(x[2]) and (_more(x[1], best[1], delta) if x[0] is None else _more(x[0], best[0], delta))
    keeps = lambda best, x: (best[0], x[1]) if x[0] is None else (x[0], best[1])
    full = smooth.withColumn("full", F.col("full").cast("int"))
    return _best(full, keys, [*metrics, "full"], lambda: BestEpoch((float("-inf"),) * 2, gains, keeps, patience), shown=2)


def value_at_best(best: DataFrame, metric: str) -> DataFrame:
    """The metric in the best epoch, one of those its rule reads."""
    return best.withColumn(f"best_{metric}", F.col("at_best")[metric])


# ---- run tags --------------------------------------------------------------


def _sci(x: Column) -> Column:
    """Like ``1e-04``: one significant digit and a two-digit exponent."""
    return F.format_string("%.0e", x.cast("double"))


def run_tag() -> Column:
    """Tag of (cw, lr, r, do, ld, wd, all_modules, ck, hf, a, fold, dup): settings that
    came later appear only when they differ from the default."""
    part = lambda show, text: F.when(show, text).otherwise(F.lit(""))
    return F.concat(
        F.concat_ws(
            "_",
            F.concat(F.lit("cw"), F.col("cw").cast("string")), F.concat(F.lit("lr"), _sci(F.col("lr"))), F.concat(F.lit("r"), F.col("r").cast("string")),
            F.concat(F.lit("do"), F.col("do").cast("string")), F.concat(F.lit("ld"), F.col("ld").cast("string")), F.concat(F.lit("wd"), _sci(F.col("wd"))),
            F.concat(F.lit("tm"), F.when(F.col("all_modules"), "all").otherwise("attn")),
        ),
        part(F.col("ck") == "val_loss", F.lit("_ckvloss")),
        part(F.col("hf").cast("string") != DEFAULT_HEAD_FACTOR, F.concat(F.lit("_hf"), F.col("hf").cast("string"))),
        part(F.col("a").cast("string") != DEFAULT_ALPHA, F.concat(F.lit("_a"), F.col("a").cast("string"))),
        part(F.col("fold").isNotNull(), F.concat(F.lit("_f"), F.coalesce(F.col("fold").cast("string"), F.lit("")))),
        part(F.col("fold").isNotNull() & (F.col("dup") == "repeat"), F.lit("_dupr")),
    )


# Parts of a run tag and the pattern of each value.
TAG_PARTS = {
    "cw": r"[\d.]+", "lr": r"[\d.e+-]+", "r": r"\d+", "do": r"[\d.]+", "ld": r"[\d.]+", "wd": r"[\d.e+-]+", "tm": r"[A-Za-z]+",
}
TAG_OPTIONS = {"ck": r"[A-Za-z]+", "hf": r"[\d.]+", "a": r"\d+", "f": r"[123]", "dup": r"[ur]"}
TAG_DEFAULTS = {"lr": "1e-04", "r": "8", "do": "0.1", "ld": "0.1", "wd": "1e-04", "tm": "all", "hf": "0.1", "a": "16"}
UNTAGGED = "(untagged)"


def tag_settings(tag: Column) -> dict[str, Column]:
    """Settings read back from a tag, with the defaults of parts it leaves out. A tag
    that does not have the full required shape yields NULLs."""
    head = "_".join(f"{k}({v})" for k, v in TAG_PARTS.items())
    tail = "".join(f"(?:_{k}({v}))?" for k, v in TAG_OPTIONS.items())
    group = {k: i + 1 for i, k in enumerate([*TAG_PARTS, *TAG_OPTIONS])}
    get = lambda k: F.nullif(F.regexp_extract(tag, head + tail, group[k]), F.lit(""))
    known = get("cw").isNotNull()
    default = lambda c, v: F.when(known, F.coalesce(c, F.lit(v)))
    return {
        "class_weight": get("cw"),
        "lr": get("lr"),
        "lora_r": get("r"),
        "dropout": get("do"),
        "lora_dropout": get("ld"),
        "weight_decay": get("wd"),
        "target_modules": get("tm"),
        "lr_head_factor": default(get("hf"), DEFAULT_HEAD_FACTOR),
        "lora_alpha": default(get("a"), DEFAULT_ALPHA),
        "fold": get("f"),
        "fold_dup": F.when(get("dup") == "u", "unique").when(get("dup") == "r", "repeat").when(get("f").isNotNull(), "unique"),
        "ckpt_metric": F.when(get("ck") == "vloss", "val_loss").when(known, "gmean"),
    }


def stem_tag(stem: Column) -> tuple[Column, Column]:
    """Tag and seed in the name of a metric file, ``metrics_<tag>_seed<n>``; a run saved without a tag is named so."""
    tag = F.regexp_extract(stem, r"^metrics_(?:(.*)_)?seed(\d+)$", 1)
    seed = F.regexp_extract(stem, r"^metrics_(?:(.*)_)?seed(\d+)$", 2)
    return F.coalesce(F.nullif(tag, F.lit("")), F.lit(UNTAGGED)), F.nullif(seed, F.lit("")).cast("int")


def short_tag(tag: Column) -> Column:
    """Only the parts that differ from the defaults; the class weight always stays."""
    usual = F.array(*[F.lit(k + v) for k, v in TAG_DEFAULTS.items()])
    named = F.filter(F.split(tag, "_"), lambda p: p.rlike("^(cw|lr|r|do|ld|wd|tm|ck|hf|a)"))
    left = F.array_join(F.filter(named, lambda p: ~F.array_contains(usual, p)), " ")
    return F.when(left == "", tag).otherwise(left)


def ranked_runs(runs: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Runs from best to worst, missing values last."""
    return runs.orderBy(*[F.desc_nulls_last(c) for c in by], tie)


# ---- upserts and planners --------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones with their key; columns either side lacks are NULL."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def missing_outputs(existing: DataFrame, splits: list[str], shards: int, force: bool = False) -> DataFrame:
    """Expected (split, shard) pairs that do not exist yet; all of them when forced."""
    spark = existing.sparkSession
    expected = spark.range(shards).select(
        F.explode(F.array(*[F.lit(s) for s in splits])).alias("split"), F.col("id").cast("int").alias("shard")
    )
    return expected if force else expected.join(existing.select("split", "shard"), ["split", "shard"], "left_anti")


def shard_manifest(recorded: DataFrame, listed: DataFrame) -> DataFrame:
    """Row counts per (shard, segment): the latest record wins, shards found but never
    recorded are taken from the listing, empty shards are left out.

    ``recorded``: shard, worker, shard_idx, segment, n_rows, seq. ``listed``: the same
    without seq, counted from the files. A NULL shard_idx is a worker's last file."""
    fresh = ["worker", "shard_idx", "n_rows"]
    newest = recorded.groupBy("shard", "segment").agg(F.max_by(F.struct(*fresh), "seq").alias("r"))
    found = listed.select("shard", "segment", F.struct(*fresh).alias("l"))
    # A recorded shard is not inspected again, so its listing adds no segments.
    unrecorded = found.join(recorded.select("shard").distinct(), "shard", "left_anti")
    rows = newest.select("shard", "segment", F.col("r").alias("x"), F.lit("recorded").alias("source")).unionByName(
        unrecorded.select("shard", "segment", F.col("l").alias("x"), F.lit("listed").alias("source"))
    )
    return rows.select("shard", "x.worker", "x.shard_idx", "segment", "x.n_rows", "source").filter("n_rows > 0")


def manifest_order() -> list[Column]:
    return [F.col("worker"), F.asc_nulls_last("shard_idx"), F.col("segment")]


# ---- log lines -------------------------------------------------------------

# Metrics scraped from training logs.
LOG_METRICS = ["train recon_error", "train loss", "train perplexity", "val recon_error", "val loss", "val perplexity"]


def log_metric(line: Column, name: str) -> Column:
    """The value after ``name =`` in a log line, NULL when it is not there."""
    return F.nullif(F.regexp_extract(line, rf"{name}\s*=\s*(\S+)", 1), F.lit("")).cast("double")
