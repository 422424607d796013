"""URL filters: explicit rules, and for all other urls the likelihood ratio of two character models.

The models are smoothed variable-order Markov models of the urls that rules accept and of those that
rules reject: the next character is predicted from up to ``ORDER`` before it, each order falling back
on the shorter one by as much as its context is short of evidence (Witten-Bell). A url's score is the
difference of its log likelihoods under both models per character, its end included.

The models are a stored table of all distinct runs of ``ORDER`` + 1 characters, real ones, so it grows with the
urls. Counts are summed before and after one exchange; shorter orders follow from them. Urls are scored by
joining their runs with the table. Whole numbers (log ratios in 1/10000) make sums exact.

The limit is calibrated on all ruled urls, each scored by counts without its own fold (one of ``FOLDS`` by hash)
(where that leaves none of a class, by all counts): it is where the share of accepted urls at or above it exceeds that of rejected ones most. Other urls are scored
by the counts of all ruled ones.

Defined cases: a null url counts as empty; without rejected urls, all are allowed; without accepted ones,
none; repeated urls are judged alike, and counted each time; an empty table gives no rows; further columns pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from beatloom.functions.arrays import let
from beatloom.llm.common import packed, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 5
START, END = "\x02", "\x03"  # before and behind a url
BASE = 1.0 / 256  # probability of a character that was never seen
SCALE, STEP = 10_000, 100
FOLDS = 5


def host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or # (A-Z lower-cased)."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. ``rules``: (verdict, host/path)."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def grams(url: Column) -> Column:
    """The runs of ORDER + 1 characters that end in each character of the url and in its end."""
    text = F.translate(url, UPPER, LOWER)
    chars = F.concat(F.array(*[F.lit(START)] * ORDER), F.filter(F.split(text, ""), lambda c: c != ""), F.array(F.lit(END)))
    run = lambda c, i: F.concat(*[c[i - ORDER + k] for k in range(ORDER + 1)])
    return let(chars, lambda c: F.transform(F.sequence(F.lit(ORDER), F.size(c) - 1), lambda i: run(c, i)))


def fold(url: Column) -> Column:
    return F.conv(F.substring(F.md5(url.cast("binary")), 1, 8), 16, 10).cast("long") % FOLDS


VIEWS = range(FOLDS + 1)  # view 0 counts all ruled urls, view f + 1 all but fold f


def gram_counts(runs: DataFrame) -> DataFrame:
    """(gram, a0.., r0..): per view, how often accepted and rejected urls hold a run. ``runs``: gram, accepted (null
    for urls without a rule), _fold, n."""
    count = lambda what, f: F.sum(F.when(what & (F.col("_fold") == f), F.col("n")).otherwise(0)).alias(f"{'a' if what is yes else 'r'}_{f}")
    yes, no = F.coalesce(F.col("accepted"), F.lit(False)), F.coalesce(~F.col("accepted"), F.lit(False))
    by_fold = runs.groupBy("gram").agg(*[count(what, f) for what in (yes, no) for f in range(FOLDS)])
    every = lambda x: sum((F.col(f"{x}_{f}") for f in range(FOLDS)), F.lit(0))
    views = [(every(x) - (F.col(f"{x}_{v - 1}") if v else F.lit(0))).alias(f"{x}{v}") for x in "ar" for v in VIEWS]
    return by_fold.select("gram", *views)


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratios) from ``gram_counts``: per view the log ratio of the last character after those before it. Orders
    are built up from the shortest; a context has at most as many rows as there are characters."""
    names = [f"{x}{v}" for x in "ar" for v in VIEWS]
    shorter = None
    for order in range(ORDER + 1):
        level = counts.groupBy(F.substring("gram", ORDER - order + 1, order + 1).alias("gram")).agg(*[F.sum(c).alias(c) for c in names])
        context = W.partitionBy(F.substring("gram", 1, order))
        level = level.withColumns({f"n_{c}": F.sum(c).over(context) for c in names} | {f"t_{c}": F.sum(F.signum(F.col(c).cast("double"))).over(context) for c in names})
        if shorter is not None:
            level = level.withColumn("_s", F.substring("gram", 2, order)).join(shorter, "_s")
        lower = lambda c: F.lit(BASE) if shorter is None else F.col(f"q_{c}")
        n, t = (lambda c: F.col(f"n_{c}")), (lambda c: F.col(f"t_{c}"))
        back = lambda c: F.when(n(c) + t(c) > 0, (F.col(c) + t(c) * lower(c)) / (n(c) + t(c))).otherwise(lower(c))
        shorter = level.select(F.col("gram").alias("_s"), *[back(c).alias(f"q_{c}") for c in names])
        if order < ORDER:
            shorter = stored(shorter, "url-order")
    ratio = lambda v: F.round((F.ln(f"q_a{v}") - F.ln(f"q_r{v}")) * SCALE).cast("int")
    return shorter.select(F.col("_s").alias("gram"), F.array(*[ratio(v) for v in VIEWS]).alias("ratios"))


def scored(runs: DataFrame, ratios: DataFrame) -> DataFrame:
    """(id, _score): log-likelihood difference per character, in whole hundredths, by the url's view."""
    ratio = F.element_at("ratios", F.col("view") + 1).cast("long")
    sums = runs.select("id", "view", "gram").join(ratios, "gram").groupBy("id").agg(F.sum(ratio).alias("s"), F.count("*").alias("k"))
    return sums.select("id", F.floor(F.col("s") / F.col("k") / STEP).cast("long").alias("_score"))


def calibrated(scores: DataFrame) -> int | None:
    """The limit from (_score, accepted, n) rows: halfway down from the smallest score at which accepted urls lead
    rejected ones by most to the next score seen; None allows all."""
    count = lambda what: F.sum(F.when(what, F.col("n")).otherwise(0))
    bins = scores.groupBy("_score").agg(count(F.col("accepted")).alias("a"), count(~F.col("accepted")).alias("r"))
    found = sorted((s, a, r) for s, a, r in bins.collect())  # a row per hundredth
    all_a, all_r = sum(x[1] for x in found), sum(x[2] for x in found)
    if not all_r:
        return None
    best, limit, below, a, r = None, None, None, all_a, all_r
    for s, da, dr in [*found, (found[-1][0] + 1, 0, 0)]:
        lead = a * all_r - r * all_a if all_a else -r
        if best is None or lead > best:
            best, limit = lead, s if below is None else -(-(s + below) // 2)
        below, a, r = s, a - da, r - dr
    return limit


def _lonely_folds(urls: DataFrame) -> list[int]:
    """Folds without which no accepted or no rejected url is left: their urls are scored by all counts."""
    by_fold = urls.groupBy("_fold").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")).collect()
    rest = lambda f, x: sum(r[x] for r in by_fold if r["_fold"] != f)
    return [f for f in range(FOLDS) if not rest(f, "a") or not rest(f, "r")]


def judged(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``pages`` with _host, _path, _rule, _verdict (columns of these names are replaced)."""
    rows = pages.drop("_host", "_path", "_rule", "_verdict", "_said", "_score", "_url")
    url = F.coalesce("url", F.lit(""))
    rows = rows.withColumns({"_host": host(url), "_path": path(url)})
    rule, verdict = ruled(F.col("_host"), F.col("_path"), rules)
    rows = rows.withColumns({"_rule": rule, "_said": verdict, "_url": url})
    # Distinct urls, numbered where they are stored.
    urls = rows.groupBy("_url").agg(F.first("_said").alias("_said"), F.count("*").alias("n"))
    urls = urls.select("_url", (F.col("_said") == "allow").alias("accepted"), "n", fold(F.col("_url")).alias("_fold"), F.monotonically_increasing_id().alias("id"))
    urls = stored(urls, "urls")
    lonely = F.col("_fold").isin(_lonely_folds(urls)) | F.col("accepted").isNull()
    urls = urls.withColumn("view", F.when(lonely, 0).otherwise(F.col("_fold") + 1).cast("int"))
    runs = urls.select("id", "accepted", "n", "_fold", "view", F.explode(grams(F.col("_url"))).alias("gram"))
    counts = stored(gram_counts(runs), "url-grams")
    scores = stored(scored(runs, stored(log_ratios(counts), "url-model")), "url-scores")
    found = urls.join(scores, "id")
    limit = calibrated(found.filter("accepted IS NOT NULL"))
    own = F.lit("allow") if limit is None else F.when(F.col("_score") >= limit, "allow").otherwise("block")
    mine = found.select(F.col("_url"), own.alias("_own"))
    return rows.join(mine, "_url").withColumn("_verdict", F.coalesce("_said", "_own")).drop("_said", "_own", "_url")


def allowed(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The rows of ``pages`` whose url is allowed, unchanged."""
    return judged(packed(pages, "url"), rules).filter("_verdict = 'allow'").select("_row.*")
