"""Scored text to period sentiment per entity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.operators import skew

# Fixed values of the sentiment rules.
RECENCY_RATE = 0.03
MIN_NEWS = 3
STRONG = 0.6
PLAIN = 0.5

UNRELIABLE_WHEN_FEW = [
    "sentiment_mean", "sentiment_mean_raw", "sentiment_std", "sentiment_median", "sentiment_confidence",
    "sentiment_extremity", "sentiment_dispersion", "sentiment_momentum", "sentiment_reversal", "sentiment_skew",
]


def add_score_fields(df: DataFrame) -> DataFrame:
    """Compound, confidence and label from the three class probabilities."""
    p, n, u = F.col("positive_prob"), F.col("negative_prob"), F.col("neutral_prob")
    top = F.greatest(p, n, u)
    return df.withColumns(
        {
            "compound": (p - n) * (1 - u),
            "confidence": top,
            "label": F.when(p == top, "positive").when(n == top, "negative").otherwise("neutral"),
        }
    )


def add_recency_weight(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """exp(-rate * (last position in the group - position)), from a pre-aggregated maximum."""
    df = skew.join_group_totals(df, keys, {"_last": F.max(position)})
    return df.withColumn("recency_weight", F.exp(-RECENCY_RATE * (F.col("_last") - F.col(position)))).drop("_last")


def _share(c: str, cut: float) -> Column:
    return F.avg(F.when(F.col(c) > cut, 1.0).otherwise(0.0))


def period_sentiment(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """All per-group moments in one aggregation; the median comes from exact group quantiles."""
    df = add_recency_weight(df, keys, position)
    w = F.col("confidence") * F.col("recency_weight")
    n = F.count("compound")
    # skewness() is the population form; the sample form needs the usual factor.
    factor = F.sqrt(n * (n - 1.0)) / (n - 2.0)
    agg = df.groupBy(*keys).agg(
        F.avg("compound").alias("sentiment_mean_raw"),
        F.coalesce(F.stddev_samp("compound"), F.lit(0.0)).alias("sentiment_std"),
        n.alias("news_count"),
        F.avg("positive_prob").alias("avg_positive_prob"),
        F.avg("negative_prob").alias("avg_negative_prob"),
        F.avg("neutral_prob").alias("avg_neutral_prob"),
        F.avg("confidence").alias("sentiment_confidence"),
        F.max("compound").alias("max_sentiment"),
        F.min("compound").alias("min_sentiment"),
        F.when(n < 3, 0.0).otherwise(F.skewness("compound") * factor).alias("sentiment_skew"),
        _share("positive_prob", STRONG).alias("pct_strongly_positive"),
        _share("negative_prob", STRONG).alias("pct_strongly_negative"),
        _share("positive_prob", PLAIN).alias("positive_ratio"),
        _share("negative_prob", PLAIN).alias("negative_ratio"),
        F.when(F.sum(w) > 0, F.sum(w * F.col("compound")) / F.sum(w)).otherwise(F.avg("compound")).alias("sentiment_mean"),
    )
    med = skew.quantiles(df, keys, "compound", [0.5], "_q")
    agg = skew.join_null_safe(agg, med.select(*keys, F.element_at("_q", 1).alias("sentiment_median")), keys, "left")
    return agg.withColumns(
        {
            "sentiment_extremity": (F.abs("max_sentiment") + F.abs("min_sentiment")) / 2.0,
            "sentiment_dispersion": F.col("max_sentiment") - F.col("min_sentiment"),
        }
    )


def add_momentum_reversal(df: DataFrame, entity: str, period: str) -> DataFrame:
    """Change of the 3-row mean and the sign flip; the first row counts as a flip."""
    w = W.partitionBy(entity).orderBy(period)
    df = df.withColumn("_m3", F.avg("sentiment_mean").over(w.rowsBetween(-2, 0)))
    before = F.lag("sentiment_mean").over(w)
    flip = F.when(before.isNull() | F.col("sentiment_mean").isNull(), 1.0).otherwise(
        F.when(F.signum("sentiment_mean") != F.signum(before), 1.0).otherwise(0.0)
    )
    return df.withColumns(
        {"sentiment_momentum": F.coalesce(F.col("_m3") - F.lag("_m3").over(w), F.lit(0.0)), "sentiment_reversal": flip}
    ).drop("_m3")


def null_thin_periods(df: DataFrame, min_news: int = MIN_NEWS) -> DataFrame:
    """Sentiment columns of groups with too few texts become NULL."""
    thin = F.col("news_count") < min_news
    return df.withColumns({c: F.when(~thin, F.col(c)) for c in UNRELIABLE_WHEN_FEW if c in df.columns})


def score_with(df: DataFrame, text: str, scorer) -> DataFrame:
    """Score texts with a pluggable model.

    ``scorer`` maps a pandas Series of texts to three arrays (positive,
    negative, neutral). It runs in Arrow batches inside the tasks; blank text
    stays neutral without reaching the scorer.
    """
    @F.pandas_udf("struct<positive_prob double, negative_prob double, neutral_prob double>")
    def probs(batches: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(
            {"positive_prob": 0.0, "negative_prob": 0.0, "neutral_prob": 1.0}, index=batches.index
        )
        keep = batches.fillna("").str.strip() != ""
        if keep.any():
            p, n, u = scorer(batches[keep].str.strip())
            out.loc[keep, "positive_prob"] = p
            out.loc[keep, "negative_prob"] = n
            out.loc[keep, "neutral_prob"] = u
        return out

    df = df.withColumn("_p", probs(F.col(text)))
    df = df.withColumns({c: F.col(f"_p.{c}") for c in ("positive_prob", "negative_prob", "neutral_prob")}).drop("_p")
    return add_score_fields(df)


def score_with_lexicon(df: DataFrame, text: str, positive: list[str], negative: list[str]) -> DataFrame:
    """Built-in scorer: share of listed words in the whole text, all in native expressions."""
    words = F.filter(F.split(F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))), "[^a-z]+"), lambda t: t != "")
    df = df.withColumn("_w", words)
    pos = F.size(F.filter("_w", lambda t: t.isin(*positive))).cast("double")
    neg = F.size(F.filter("_w", lambda t: t.isin(*negative))).cast("double")
    df = df.withColumns({"_pos": pos, "_neg": neg, "_n": F.size("_w").cast("double")}).drop("_w")
    empty = F.col("_n") == 0
    total = F.nullif(F.col("_n"), F.lit(0.0))
    df = df.withColumns(
        {
            "positive_prob": F.when(empty, 0.0).otherwise(F.try_divide(F.col("_pos"), total)),
            "negative_prob": F.when(empty, 0.0).otherwise(F.try_divide(F.col("_neg"), total)),
            "neutral_prob": F.when(empty, 1.0).otherwise(
                F.try_divide(F.col("_n") - F.col("_pos") - F.col("_neg"), total)
            ),
        }
    ).drop("_pos", "_neg", "_n")
    return add_score_fields(df)


# Words of market news with a direction, and words that turn the next ones around.
RISING = (
    "advance advances approval beat beats boom boost bullish climb climbs exceeds gain gains good great growth higher improve improved improves jump jumps leading optimistic "
    "outperform outperforms positive profit profits profitable rally rallies rebound record recover recovery rise rises rising robust soar soars strong stronger success surge surges upgrade upgraded win wins"
).split()
FALLING = (
    "bad bankrupt bankruptcy bearish breach cut cuts crash crisis debt decline declines declining default defaults delay delays downgrade downgraded drop drops fail fails failure fall falling falls fear fears "
    "fine fined fraud investigation lawsuit layoffs loss losses lower miss missed misses negative penalty plunge plunges poor probe recall recession risk risks slump slumps warning weak weaker worse worst"
).split()
NEGATORS = "barely cannot hardly lack lacks less neither never no nor not without".split()
NEGATION_REACH = 3


def score_with_polarity(df: DataFrame, text: str, positive: list[str] = RISING, negative: list[str] = FALLING, negators: list[str] = NEGATORS, reach: int = NEGATION_REACH) -> DataFrame:
    """Scorer on a stated word list with negation, over whole texts, in native expressions.

    A listed word with a negator among the ``reach`` words before it counts for
    the other side. Probabilities are shares of the listed words, shrunk by one
    neutral word; texts without listed words are neutral.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+"), lambda t: t != "")
    d = df.withColumn("_w", words)

    def side(w, i):
        sign = F.when(w.isin(*positive), 1).when(w.isin(*negative), -1).otherwise(0)
        start = F.greatest(i - reach + 1, F.lit(1))
        before = F.slice(F.col("_w"), start, i - start + 1)
        return F.when(sign == 0, 0).when(F.exists(before, lambda x: x.isin(*negators)), -sign).otherwise(sign)

    d = d.withColumn("_s", F.filter(F.transform("_w", side), lambda x: x != 0)).drop("_w")
    pos, neg = F.size(F.filter("_s", lambda x: x > 0)).cast("double"), F.size(F.filter("_s", lambda x: x < 0)).cast("double")
    total = pos + neg + 1
    return add_score_fields(d.withColumns({"positive_prob": pos / total, "negative_prob": neg / total, "neutral_prob": 1 / total}).drop("_s"))
