"""Scores of how causal evidence fits theory, strata and model importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.cleaning import strip_lag, to_map
from panelwright.operators.macro import union_all

# Sign that theory expects per explanatory group (0 means no prior).
EXPECTED_SIGN = {
    "price_momentum": 1, "trend": 1, "fundamentals": 1, "sentiment": 1, "macro_rates": -1, "macro_cycle": 1,
    "macro_global": 0, "macro_commodity": 0, "macro_fx": 0, "macro_equity": 1, "risk": -1, "position_size": 0,
    "concentration": 0, "herding": 0,
}
CONSENSUS_CONFIDENCE = 0.15
GROUNDED_CONFIDENCE = 0.3
SPACE_WEIGHT, TIME_WEIGHT = 0.70, 0.30
NO_STABILITY = 0.8
NO_CONCORDANCE = 0.5


def target_links(links: DataFrame, target: str = "action_ordinal") -> DataFrame:
    return links.where((F.col("edge_type") == "GRANGER_CAUSES") & (F.col("target") == target))


def coherence_breakdown(links: DataFrame) -> DataFrame:
    """Per link: expected and actual sign, agreement, group known, contribution and weight."""
    expected = to_map(EXPECTED_SIGN, F.col("cause_group"), 0)
    known = F.col("cause_group").isin(*EXPECTED_SIGN).cast("double")
    df = links.withColumns({"expected_sign": expected, "domain_entailment": known, "fdr_significant": (F.col("p_fdr") < 0.05).cast("int")})
    agree = F.when(F.col("expected_sign") == 0, 0.5).otherwise((F.signum("beta") == F.col("expected_sign")).cast("double"))
    df = df.withColumn("sign_agreement", agree)
    return df.withColumns(
        {
            "contribution": F.col("fdr_significant") * F.col("sign_agreement") * F.col("domain_entailment"),
            "weight": F.col("fdr_significant") * F.abs("beta") * F.col("domain_entailment"),
        }
    )


def coherence(links: DataFrame) -> DataFrame:
    """Uniform and effect-weighted agreement with theory, and counts, in one aggregation."""
    b = coherence_breakdown(links)
    sig = F.col("fdr_significant") == 1
    w = F.sum("weight")
    return b.agg(
        F.avg("contribution").alias("coherence"),
        F.when(w > 1e-9, F.sum(F.col("weight") * F.col("sign_agreement")) / w).otherwise(0.0).alias("coherence_weighted"),
        F.count("*").alias("n_edges"),
        F.sum("fdr_significant").alias("n_fdr_significant"),
        F.count(F.when(sig & (F.col("sign_agreement") == 1), 1)).alias("n_theory_aligned"),
        F.count(F.when(sig & (F.col("sign_agreement") == 0) & (F.col("expected_sign") != 0), 1)).alias("n_contrarian"),
        F.avg("sign_agreement").alias("pct_sign_agreement"),
        F.avg("domain_entailment").alias("pct_domain_grounded"),
    )


def lag_persistence(links: DataFrame, min_lags: int = 3) -> DataFrame:
    """Share of significant causes that are significant at ``min_lags`` lags or more."""
    per = links.where(F.col("p_fdr") < 0.05).groupBy("cause").agg(F.countDistinct("lag").alias("n_lags"))
    return per.agg(F.coalesce(F.avg((F.col("n_lags") >= min_lags).cast("double")), F.lit(0.0)).alias("lag_persistence"))


def method_variables(links: DataFrame, parents: DataFrame, effects: DataFrame, confidence: float = CONSENSUS_CONFIDENCE) -> DataFrame:
    """(method, variable) pairs found by each method for the signed target."""
    g = links.where(F.col("p_fdr") < 0.05).select(F.lit("granger").alias("method"), F.col("cause").alias("variable"))
    i = parents.where(F.col("confidence") >= confidence).select(F.lit("icp").alias("method"), "variable")
    d = effects.where((F.col("outcome") == "action_ordinal") & F.col("significant")).select(F.lit("dml").alias("method"), F.col("treatment").alias("variable"))
    return union_all([g, i, d]).distinct()


def consensus(methods: DataFrame) -> DataFrame:
    """How many variables each combination of methods confirms."""
    m = methods.groupBy("variable").agg(*[F.max((F.col("method") == k).cast("int")).alias(k) for k in ("granger", "icp", "dml")])
    g, i, d = (F.col(k) == 1 for k in ("granger", "icp", "dml"))
    n = lambda c: F.count(F.when(c, 1))
    return m.agg(n(g & ~i & ~d).alias("granger_only"), n(g & i).alias("granger_and_icp"), n(g & d).alias("granger_and_dml"), n(g & i & d).alias("all_three"))


# Feature sets compared in the method ablation, as set expressions.
FEATURE_SETS = {
    "granger_only": "g", "icp_only_conf25": "i25", "icp_only_conf50": "i50", "icp_only_conf10": "i10", "dml_only": "d", "markov_blanket": "m",
    "mb_union_dml": "m or d", "mb_union_icp": "m or i25", "granger_union_icp": "g or i25", "all_causal_union": "g or i25 or d or m",
    "all_causal_intersection": "g and i25 and d", "dml_intersection_icp": "d and i25", "granger_intersection_dml": "g and d",
    "all_features": "a",
}


def feature_sets(links: DataFrame, parents: DataFrame, effects: DataFrame, blanket: DataFrame, everything: DataFrame) -> DataFrame:
    """Members of the fourteen feature-set variants as (feature_set, variable) rows."""
    tagged = union_all(
        [
            links.where(F.col("p_value") < 0.05).select(F.lit("g").alias("k"), F.col("cause").alias("variable")),
            *[parents.where(F.col("confidence") >= c).select(F.lit(k).alias("k"), "variable") for k, c in (("i10", 0.10), ("i25", 0.25), ("i50", 0.50))],
            effects.where("significant").select(F.lit("d").alias("k"), F.col("treatment").alias("variable")),
            blanket.select(F.lit("m").alias("k"), "variable"),
            everything.select(F.lit("a").alias("k"), "variable"),
        ]
    )
    keys = ["g", "i10", "i25", "i50", "d", "m", "a"]
    flags = tagged.groupBy("variable").agg(*[F.max(F.col("k") == k).alias(k) for k in keys])
    picks = F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in FEATURE_SETS.items()])
    return flags.select(F.explode(F.array_compact(picks)).alias("feature_set"), "variable")


def stratum_overlap(parents: DataFrame, threshold: float = CONSENSUS_CONFIDENCE) -> DataFrame:
    """Jaccard overlap of the variables of every pair of strata."""
    v = parents.where(F.col("confidence") >= threshold).select("stratum", "variable").distinct()
    size = v.groupBy("stratum").agg(F.count("*").alias("n"))
    a, b = v.withColumnRenamed("stratum", "s1"), v.withColumnRenamed("stratum", "s2")
    both = a.join(b, "variable").where(F.col("s1") < F.col("s2")).groupBy("s1", "s2").agg(F.count("*").alias("n_shared"))
    s1 = size.select(F.col("stratum").alias("s1"), F.col("n").alias("n1"))
    s2 = size.select(F.col("stratum").alias("s2"), F.col("n").alias("n2"))
    grid = s1.join(s2, F.col("s1") < F.col("s2")).join(both, ["s1", "s2"], "left").fillna(0, ["n_shared"])
    return grid.withColumn("jaccard", F.col("n_shared") / (F.col("n1") + F.col("n2") - F.col("n_shared")))


def sign_concordance(links: DataFrame, variables: DataFrame) -> DataFrame:
    """Mean share of a shared variable's links that carry its dominant sign."""
    s = links.join(variables, links["cause"] == variables["variable"], "left_semi").select("cause", F.signum("beta").alias("s"))
    per = s.groupBy("cause").agg(F.signum(F.sum("s")).alias("dominant"), F.collect_list("s").alias("signs"))  # one entry per lag
    share = F.size(F.filter("signs", lambda x: x == F.col("dominant"))) / F.size("signs")
    return per.agg(F.coalesce(F.avg(share), F.lit(NO_CONCORDANCE)).alias("sign_concordance"))


def stability(links: DataFrame, parents: DataFrame, threshold: float = CONSENSUS_CONFIDENCE) -> DataFrame:
    """Overlap x sign concordance x (1 - variation of confidence), and the composite with lag persistence."""
    kept = parents.where(F.col("confidence") >= threshold)
    n_strata = parents.select("stratum").distinct().agg(F.count("*")).scalar()
    cv = kept.groupBy("variable").agg(F.count("*").alias("n"), (F.stddev_pop("confidence") / F.avg("confidence")).alias("cv"))
    steady = cv.where(F.col("n") >= 2).agg(F.coalesce(1 - F.avg("cv"), F.lit(NO_STABILITY)).alias("s"))
    shared = cv.where(F.col("n") == n_strata).select("variable")
    one = stratum_overlap(parents, threshold).agg(F.coalesce(F.avg("jaccard"), F.lit(0.0)).alias("jaccard_avg")).withColumns(
        {
            "sign_concordance": sign_concordance(links, shared).scalar(),
            "stability": steady.scalar(),
            "lag_persistence": lag_persistence(links).scalar(),
        }
    )
    score = F.col("jaccard_avg") * F.col("sign_concordance") * F.col("stability")
    return one.withColumn("stratified_stability", score).withColumn(
        "composite", F.pow("stratified_stability", F.lit(SPACE_WEIGHT)) * F.pow("lag_persistence", F.lit(TIME_WEIGHT))
    )


def lag_half_stability(links: DataFrame) -> DataFrame:
    """Fallback without strata: overlap of causes at early and late lags, times 0.7."""
    lags = F.sort_array(F.collect_set("lag"))  # a handful of lags
    cut = links.agg(lags.alias("l")).select(F.element_at("l", F.greatest((F.size("l") / 2).cast("int"), F.lit(1)))).scalar()
    per = links.withColumn("early", F.col("lag") <= cut).groupBy("cause").agg(F.max("early").alias("e"), F.max(~F.col("early")).alias("l"))
    j = F.count(F.when(F.col("e") & F.col("l"), 1)) / F.greatest(F.count("*"), F.lit(1))
    return per.agg(j.alias("jaccard_avg"), (j * 0.7).alias("stratified_stability"))


def average_rank(c: Column, w) -> Column:
    """Rank with ties averaged, over ``w`` (partitioned and ordered by ``c``)."""
    return F.rank().over(w) + (F.count("*").over(w.rangeBetween(0, 0)) - 1) / 2.0


def faithfulness(importance: DataFrame, links: DataFrame, parents: DataFrame, k: int = 10) -> DataFrame:
    """Grounding, coverage, their harmonic mean, rank agreement and the combined score.

    ``importance`` holds (variable, importance); all tables here have one row
    per variable.
    """
    top = importance.orderBy(F.abs("importance").desc(), "variable").limit(k).withColumn("base", strip_lag(F.col("variable")))
    strength = target_links(links).groupBy("cause").agg(F.max(F.abs("beta")).alias("strength"))
    causal = union_all([
        links.where(F.col("edge_type") == "GRANGER_CAUSES").select(F.col("cause").alias("base")),
        parents.where(F.col("confidence") >= GROUNDED_CONFIDENCE).select(F.col("variable").alias("base")),
    ]).distinct()
    grounded = top.join(causal, "base", "left_semi").agg(F.count("*")).scalar()
    strongest = strength.orderBy(F.desc("strength"), "cause").limit(k)
    covered = strongest.join(top.select(F.col("base").alias("cause")).distinct(), "cause", "left_semi").agg(F.count("*")).scalar()
    shared = top.join(strength.withColumnRenamed("cause", "base"), "base")
    one = W.partitionBy(F.lit(1))  # at most k rows
    ranks = shared.select(
        average_rank(F.abs("importance"), one.orderBy(F.abs("importance"))).alias("ri"),
        average_rank(F.col("strength"), one.orderBy("strength")).alias("rs"),
    )
    rho = ranks.agg(F.count("*").alias("n_shared"), F.when(F.count("*") >= 4, F.coalesce(F.nanvl(F.corr("ri", "rs"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0).alias("rho"))
    out = rho.withColumns({"grounding_ratio": grounded / F.lit(float(k)), "causal_coverage": covered / F.lit(float(k))})
    g, c = F.col("grounding_ratio"), F.col("causal_coverage")
    out = out.withColumn("f1_grounding", F.when(g + c > 0, 2 * g * c / (g + c)).otherwise(0.0))
    return out.withColumn("faithfulness", F.col("f1_grounding") * (F.col("rho") + 1) / 2)
