"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Each rule rejects a document whose metric exceeds a cutoff. Cutoffs come from a
fixed grid and are certified on labelled documents: for a stratum, a rule and a
cutoff, the number of good documents beyond the cutoff is binomial, and the
exact lower tail at the allowed false-rejection rate is its p-value. Within a
stratum and a rule the cutoffs are tested from lenient to strict until one
fails (fixed-sequence testing); over strata and rules the level is divided
(Bonferroni). With probability ``1 - delta`` no certified cutoff rejects more
than ``alpha`` of the good documents of its stratum, whichever is chosen. Among
the certified ones that with the best ``junk rate - weight * good rate`` is
used, the most lenient on ties, and none if no rate is above zero.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WHITE, WHITE_RE, broadcast_if_small, store

#: rule -> (numerator, denominator) over the columns of :func:`with_metrics`
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines")
#: Strata are few (languages); beyond this the join shuffles.
MAX_BROADCAST_STRATA = 10_000


@dataclass(frozen=True)
class RiskControl:
    alpha: float = 0.02
    delta: float = 0.1
    weight: float = 10.0
    #: from lenient to strict
    grid: tuple[float, ...] = field(default=(0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05))


P = "__lgq_"


def with_metrics(docs: DataFrame, text: str = "text", prefix: str = P) -> DataFrame:
    """Add the metric columns, named with ``prefix``, to every row.

    All work is within the row: a text of any length is one array of words and
    one of hashed 3-word windows, and nothing is shuffled. A null text counts
    as an empty one.
    """
    words, lines, grams, sure = F.col(f"{prefix}w"), F.col(f"{prefix}l"), F.col(f"{prefix}g"), F.col(f"{prefix}s")
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(WHITE))
    n = F.size(words)
    empty_longs = F.array().cast("array<bigint>")
    out = docs.withColumns({
        f"{prefix}w": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RE)),
        f"{prefix}l": F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != ""),
    })
    # hashes of the words at i, i+1, i+2; equal hashes mean equal windows
    out = out.withColumn(
        f"{prefix}g",
        F.when(n < 3, empty_longs).otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))),
    )
    # window hashes found twice or more: neighbours in sorted order
    ordered = F.col(f"{prefix}o")
    out = out.withColumn(f"{prefix}o", F.when(F.size(F.array_distinct(grams)) == F.size(grams), empty_longs).otherwise(F.sort_array(grams)))
    twice = F.array_distinct(F.filter(ordered, lambda h, i: (i > 0) & (h == F.get(ordered, i - 1))))
    out = out.withColumn(f"{prefix}s", twice)
    m = F.size(grams)
    # positions of repeated windows; for many repeated hashes by sorting (hash, position), else by looking them up
    looked_up = F.filter(F.transform(grams, lambda h, i: F.when(F.array_contains(sure, h), i)), lambda i: i.isNotNull())
    pairs = F.col(f"{prefix}p")
    out = out.withColumn(
        f"{prefix}p",
        F.when(F.size(sure) > 32, F.sort_array(F.arrays_zip(grams.alias("h"), F.sequence(F.lit(0), m - 1).alias("i")))),
    )
    same = lambda j, k: F.get(pairs, j).getField("h") == F.get(pairs, k).getField("h")
    by_sort = F.sort_array(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda j: F.coalesce((j > 0) & same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False))),
            lambda j: F.get(pairs, j).getField("i"),
        )
    )
    at = F.col(f"{prefix}a")
    out = out.withColumn(f"{prefix}a", F.when(F.size(sure) == 0, F.array().cast("array<int>")).when(F.size(sure) > 32, by_sort).otherwise(looked_up))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).cast("long").alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    whole = F.coalesce(F.col(text), F.lit(""))
    length = lambda c: F.char_length(c).cast("long")
    return out.withColumns({
        f"{prefix}n_words": n.cast("long"),
        f"{prefix}word_chars": length(F.array_join(words, "")),
        f"{prefix}n_symbols": length(F.regexp_replace(whole, "[^#*$%&|<>]+", "")),
        f"{prefix}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        f"{prefix}n_repeat_words": F.when(F.size(at) == 0, F.lit(0).cast("long")).otherwise(covered),
        f"{prefix}n_capitals": length(F.regexp_replace(whole, "[^A-Z]+", "")),
        f"{prefix}n_lines": F.size(lines).cast("long"),
    }).drop(*(f"{prefix}{k}" for k in "wlgospa"))


def base_failed(prefix: str = P) -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * n)


def rate(rule: str, prefix: str = P) -> Column:
    over, under = RULES[rule]
    return F.coalesce(F.try_divide(F.col(f"{prefix}{over}").cast("double"), F.col(f"{prefix}{under}").cast("double")), F.lit(0.0))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed from logarithms of its terms.

    From ``k >= n * p`` on it is near one half or more, and 1 is returned.
    """
    step = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    total = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))),
        F.struct(first.alias("t"), F.exp(first).alias("s")),
        lambda a, i: F.struct(
            (a["t"] + F.log((n - i + 1).cast("double") / i.cast("double")) + step).alias("t"),
            (a["s"] + F.when(i <= k, F.exp(a["t"] + F.log((n - i + 1).cast("double") / i.cast("double")) + step)).otherwise(0.0)).alias("s"),
        ),
        lambda a: a["s"],
    )
    return F.when((n <= 0) | (k >= n * p), F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(total)


def cutoffs(metrics: DataFrame, labels: DataFrame, control: RiskControl, prefix: str = P) -> DataFrame:
    """One row for each stratum: ``stratum`` and a cutoff for each rule (null: none certified).

    ``metrics``: ``doc_id``, ``stratum`` and the metric columns of all documents.
    A document with several labels is good if one says so; rows with a null id
    or label are not used. Documents that fail the base rules are left out, as
    the learned rules see only what those let through.
    """
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") >= 1).alias("good"))
    marked = metrics.where(~base_failed(prefix)).join(truth, "doc_id")
    # first: how many cutoffs, from the lenient end, the metric does not exceed
    first = lambda r: sum((rate(r, prefix) <= c).cast("int") for c in control.grid)
    hits = marked.select("stratum", "good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), first(r).alias("at")) for r in RULES))).alias("c")).select("stratum", "good", "c.*")
    n_good, n_junk = F.sum(F.col("good").cast("long")), F.sum((~F.col("good")).cast("long"))
    per_cell = hits.groupBy("stratum", "rule", "at").agg(n_good.alias("k"), n_junk.alias("caught"))
    whole = Window.partitionBy("stratum", "rule")
    lenient_first = whole.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    strata = metrics.select("stratum").distinct().agg(F.count(F.lit(1)).alias("strata"))
    counted = per_cell.select(
        "stratum", "rule", "at",
        F.sum("k").over(lenient_first).alias("k"), F.sum("caught").over(lenient_first).alias("caught"),
        F.sum("k").over(whole).alias("good"), F.sum("caught").over(whole).alias("junk"),
    ).where(F.col("at") < len(control.grid)).crossJoin(F.broadcast(strata))  # one row
    tested = counted.withColumn("p", binomial_tail(F.col("k"), F.col("good"), control.alpha / len(RULES))).withColumn("cutoff", F.element_at(F.array(*map(F.lit, control.grid)), F.col("at") + 1))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    gain = ratio("caught", "junk") - F.lit(control.weight) * ratio("k", "good")
    passed = tested.withColumn("worst", F.max("p").over(lenient_first)).where(F.col("worst") <= F.lit(control.delta) / (F.col("strata") * len(RULES))).withColumn("gain", gain).where("gain > 0")
    best = passed.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(F.round("gain", 9), "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))


def judged(measured: DataFrame, cuts: DataFrame, prefix: str = P) -> DataFrame:
    """Add ``<prefix>kept`` to rows with metrics and ``<prefix>stratum``."""
    cuts = cuts.select(F.col("stratum").alias(f"{prefix}of"), *(F.col(f"cut_{r}").alias(f"{prefix}cut_{r}") for r in RULES))
    rejected = base_failed(prefix)
    for r in RULES:
        rejected = rejected | F.coalesce(rate(r, prefix) > F.col(f"{prefix}cut_{r}"), F.lit(False))
    out = measured.join(broadcast_if_small(cuts, MAX_BROADCAST_STRATA), F.col(f"{prefix}stratum") == F.col(f"{prefix}of"), "left")
    return out.withColumn(f"{prefix}kept", ~rejected).drop(f"{prefix}of", *(f"{prefix}cut_{r}" for r in RULES))


def stratum(name: str | None) -> Column:
    """The value of the stratum column; null is a stratum of its own."""
    return F.coalesce(F.col(name).cast("string"), F.lit("\0null")) if name else F.lit("all")


def measure(docs: DataFrame, strata: str | None = "lang", owner: str = "") -> DataFrame:
    """The stored metrics table: ``doc_id``, ``stratum`` and prefixed metrics, without texts."""
    slim = docs.select("doc_id", stratum(strata).alias("stratum"), "text")
    return store(with_metrics(slim).drop("text"), "quality-metrics", owner)


def quality_table(docs: DataFrame, labels: DataFrame, control: RiskControl = RiskControl(), strata: str | None = "lang", owner: str = "") -> DataFrame:
    """Metrics and verdict of every document, one row for each row of ``docs``.

    Null and empty texts have no words and fail the base rules. Repeated rows
    get the same verdict. Empty labels certify nothing: only the base rules act.
    """
    metrics = measure(docs, strata, owner)
    cuts = store(cutoffs(metrics, labels.select("doc_id", "quality"), control), "quality-cutoffs", owner)
    return judged(metrics.withColumnRenamed("stratum", f"{P}stratum"), cuts).withColumn(f"{P}base_failed", base_failed())


def quality_filter(docs: DataFrame, labels: DataFrame, control: RiskControl = RiskControl(), strata: str | None = "lang", owner: str = "") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns unchanged.

    Texts are measured twice (for the cutoffs, then for the verdict) so that no
    text is ever shuffled.
    """
    cuts = store(cutoffs(measure(docs, strata, owner), labels.select("doc_id", "quality"), control), "quality-cutoffs", owner)
    measured = with_metrics(docs.withColumn(f"{P}stratum", stratum(strata)))
    # the row number keeps the filter from being pushed below, where it would hold every metric's expression many times over
    told = judged(measured, cuts).select(*docs.columns, f"{P}kept", F.monotonically_increasing_id().alias(f"{P}row"))
    return told.where(F.col(f"{P}kept") & (F.col(f"{P}row") >= 0)).select(*docs.columns)
