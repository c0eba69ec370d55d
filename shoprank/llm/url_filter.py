"""URL filter: ratio of two smoothed variable-order Markov models over characters, DataFrame operations only.

Host/path rules decide what they fit. The URLs that rules allow and block are also the training classes: for
each class a character model of order 0 to ``order`` is counted and smoothed by Witten-Bell interpolation,

    p_k(c | ctx) = (n(ctx c) + T(ctx) * p_{k-1}(c | shorter ctx)) / (n(ctx) + T(ctx)),

T being the number of different characters seen after ctx; an unseen context falls back to the shorter one, and
order -1 is uniform. A URL's score is the log2 ratio allow : block summed over its characters and its end,
divided by their number. The threshold is calibrated on labelled URLs kept out of the counts: the score that
best separates them (true allow rate minus false allow rate; the smallest such score on a tie).

Distribution: URLs are reduced to distinct texts first; a text's characters become windows of ``order`` + 1
characters, which are reduced to distinct windows before any smoothing; orders are chained by joins of these
aggregates. Sums are integers (micro-bits), so results don't depend on the order of addition.

Nulls and texts without ``://``: host and path empty, no rule. A null URL is scored as an empty text. If one
class has no held-out URL, the threshold is minus infinity: the method then allows. Repeated rows get equal
verdicts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: Fixed values: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\u0002", "\u0003"
#: One labelled URL in so many is kept out of the counts and calibrates the threshold.
CALIBRATION_FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL text; both empty if it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as host/path text, verdict) of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _windows(texts: DataFrame, order: int) -> DataFrame:
    """One row per character (and end) of each text: its window of ``order`` characters before it and itself."""
    padded = F.concat(F.lit(START * order), F.col("t"), F.lit(END))
    return texts.withColumn("w", F.explode(F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order + 1}}}))"), F.lit(1))))


def window_scores(windows: DataFrame, order: int) -> DataFrame:
    """(w, micro): log2 p_allow / p_block of every distinct window, in millionths.

    windows: (w, na, nb), distinct windows with their counts in the two classes (0 if only unlabelled texts have it).
    """
    below = None
    for k in range(order + 1):
        grams = windows.groupBy(F.expr(f"right(w, {k + 1})").alias("g")).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
        grams = grams.withColumn("ctx", F.expr(f"left(g, {k})"))
        ctx = grams.groupBy("ctx").agg(
            F.sum("na").alias("ca"), F.sum("nb").alias("cb"),
            F.count(F.when(F.col("na") > 0, 1)).alias("ta"), F.count(F.when(F.col("nb") > 0, 1)).alias("tb"))
        step = grams.join(ctx, "ctx")
        if below is None:
            step = step.withColumns({"qa": F.lit(1 / 256), "qb": F.lit(1 / 256)})
        else:
            step = step.withColumn("s", F.expr(f"right(g, {k})")).join(
                below.select(F.col("g").alias("s"), F.col("pa").alias("qa"), F.col("pb").alias("qb")), "s")

        def smooth(n: str, c: str, t: str, q: str) -> Column:
            return F.when(F.col(c) > 0, (F.col(n) + F.col(t) * F.col(q)) / (F.col(c) + F.col(t))).otherwise(F.col(q))

        below = step.select("g", smooth("na", "ca", "ta", "qa").alias("pa"), smooth("nb", "cb", "tb", "qb").alias("pb"))
    return below.select(F.col("g").alias("w"), F.round((F.log2("pa") - F.log2("pb")) * 1e6).cast("long").alias("micro"))


def _threshold(scored: DataFrame) -> float:
    """The score, in thousandths of a bit, that best separates held-out labelled texts; -inf without both classes."""
    held = scored.where("verdict IS NOT NULL AND held")
    # a log ratio is bounded by the smoothing, so there are a few ten thousand different thousandths at most
    bins = held.groupBy(F.floor(F.col("score") * 1000).alias("bin")).agg(
        F.count(F.when(F.col("verdict") == "allow", 1)).alias("a"), F.count(F.when(F.col("verdict") == "block", 1)).alias("b"))
    bins = bins.collect()
    na, nb = sum(r.a for r in bins), sum(r.b for r in bins)
    if not na or not nb:
        return float("-inf")
    best, at, a, b = -2.0, 0, na, nb
    for r in sorted(bins, key=lambda r: r.bin):
        gain = a / na - b / nb
        if gain > best + 1e-12:
            best, at = gain, r.bin
        a, b = a - r.a, b - r.b
    return at / 1000


def url_verdicts(df: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 rules: list[tuple[str, str, str]] | None = None, order: int = 5) -> DataFrame:
    """(id, host, path, rule, verdict, score, threshold) for every row of ``df``; score is null where a rule decides."""
    spark = df.sparkSession
    rules = RULES if rules is None else rules
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({
        "rule": rule, "ruled": verdict,
        "t": F.translate(F.regexp_replace(F.coalesce("url", F.lit("")), f"[{START}{END}]", " "), UPPER, LOWER)})
    rows = rows.withColumns({"k1": F.xxhash64("t", "ruled"), "k2": F.xxhash64(F.lit(1), "t", "ruled")})
    texts = rows.select("k1", "k2", "t", F.col("ruled").alias("verdict")).dropDuplicates(["k1", "k2"])
    texts = written(spark, texts.withColumn("held", F.pmod("k2", F.lit(CALIBRATION_FOLDS)) == 0), "url-texts")
    windows = _windows(texts, order)
    counted = windows.groupBy("w").agg(
        F.count(F.when((F.col("verdict") == "allow") & ~F.col("held"), 1)).alias("na"),
        F.count(F.when((F.col("verdict") == "block") & ~F.col("held"), 1)).alias("nb"))
    micro = written(spark, window_scores(written(spark, counted, "url-windows"), order), "url-model")
    # only held-out and undecided texts need a score
    needed = windows.where("held OR verdict IS NULL").select("k1", "k2", "verdict", "held", "w")
    scored = (
        needed.join(micro, "w").groupBy("k1", "k2", "verdict", "held")
        .agg((F.sum("micro") / F.count(F.lit(1)) / 1e6).alias("score"))
    )
    scored = written(spark, scored, "url-scores")
    limit = F.lit(_threshold(scored))
    out = rows.join(scored.where("verdict IS NULL").select("k1", "k2", "score"), ["k1", "k2"], "left")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("score") >= limit, "allow").otherwise("block")).alias("verdict"),
        "score", limit.alias("threshold"))


def op4_url_markov_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's URL: host, path, the rule that fits and the verdict."""
    return url_verdicts(table(spark, sf_dir, "pages", "page_id", "url"))
