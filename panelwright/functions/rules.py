"""Ordered keyword rules turned into one CASE expression.

A rule table is a list of (label, tests); the first label with a matching
test wins. Tests are (kind, word, ...) tuples: ``has`` any word inside,
``is`` equality, ``starts`` a prefix, and ``starts_has`` a prefix together
with any of the following words. ``rules_sql`` prints the same table as SQL so that
checks in another engine share the wording but not the evaluation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sector names and their keywords, in priority order.
INDUSTRY_RULES = [
    ("OTHERS", [("is", "", "N.A.", "INDUSTRY", "NOT CLASSIFIED", "MISCELLANEOUS")]),
    ("DEBT & MONEY MARKET", [("has", "SOVEREIGN", "A1+", "TREASURY", "CBLO", "TREPS")]),
    ("INFORMATION TECHNOLOGY", [("has", "SOFTWARE", "IT ENABLED"), ("starts_has", "IT", "SERVICE", "HARDWARE")]),
    ("TELECOM", [("has", "TELECOM")]),
    ("HEALTHCARE", [("has", "PHARMA", "HEALTH", "BIOTECH", "HOSPITAL")]),
    ("FINANCIAL SERVICES", [("has", "BANK", "FINANC", "INSURANCE", "CAPITAL MARKET", "FINTECH")]),
    ("AUTOMOBILE", [("has", "AUTO", "VEHICLE", "MOTOR")]),
    ("FMCG", [("has", "CONSUMER NON", "FMCG", "FOOD", "BEVERAGE", "TOBACCO", "CIGARETTE",
               "PERSONAL PRODUCT", "HOUSEHOLD PRODUCT")]),
    ("CONSUMER DISCRETIONARY", [("has", "CONSUMER DURABLE", "CONSUMER SERVICE", "ENTERTAINMENT",
                                 "HOTEL", "LEISURE", "RETAIL")]),
    ("ENERGY", [("has", "PETROLEUM", "POWER", "CONSUMABLE FUEL", "UTILIT"), ("starts", "OIL", "GAS")]),
    ("METALS & MINING", [("has", "METAL", "MINING", "MINERAL", "FERROUS")]),
    ("CHEMICALS", [("has", "CHEMICAL", "PETROCHEMICAL")]),
    ("CEMENT & CONSTRUCTION", [("has", "CEMENT", "CONSTRUCT")]),
    ("INDUSTRIALS", [("has", "INDUSTRIAL", "CAPITAL GOOD", "ELECTRICAL EQUIP", "ENGINEERING")]),
    ("TEXTILES", [("has", "TEXTILE", "APPAREL")]),
    ("REALTY", [("has", "REALTY", "REAL ESTATE")]),
    ("AGRICULTURE", [("has", "AGRI", "FERTILI", "PESTICIDE", "PAPER", "FOREST", "JUTE")]),
    ("TRANSPORT", [("has", "TRANSPORT", "LOGISTICS", "SHIPPING")]),
    ("AEROSPACE & DEFENSE", [("has", "AEROSPACE", "DEFEN")]),
    ("MEDIA", [("has", "MEDIA")]),
    ("SERVICES", [("has", "SERVICE", "TRADING", "COMMERCIAL")]),
]

# Groups of explanatory variables by name, nine-way.
VARIABLE_GROUP_RULES = [
    ("price_momentum", [("has", "rsi", "macd", "bollinger", "momentum", "monthly_return", "sma", "alpha")]),
    ("position_size", [("has", "pct_nav", "holding_tenure", "allocation_change", "rank", "sector_weight")]),
    ("herding", [("has", "consensus")]),
    ("risk", [("has", "volatility", "volume_ratio", "beta")]),
    ("macro_rates", [("has", "repo_rate", "cpi", "us_10y", "real_interest")]),
    ("macro_equity", [("has", "nifty", "vix", "india")]),
    ("sentiment", [("has", "sentiment", "ratio")]),
    ("fundamentals", [("has", "pe", "pb", "eps", "market_cap", "bv_per", "profit", "income")]),
]

# The coarser naming used by the link views, six-way.
VARIABLE_FAMILY_RULES = [
    ("macro", [("has", "nifty", "vix", "crude", "gold", "usd", "sp500", "yield", "cpi", "repo", "gdp",
                "brent", "inflation")]),
    ("technical", [("has", "rsi", "macd", "momentum", "volatility", "return", "beta", "relative_strength")]),
    ("sentiment", [("has", "sentiment", "positive", "negative", "news")]),
    ("fund_action", [("has", "buy", "sell", "net_action", "alloc", "wt_", "flow_", "stock_count",
                      "avg_tenure", "avg_consensus", "fund_count")]),
    ("fundamental", [("has", "pe", "pb", "eps", "market_cap", "roe", "debt")]),
]

# Partial R2 bands.
EFFECT_BANDS = [(0.014, "large"), (0.006, "medium"), (0.002, "small")]


def _test(c: Column, test: tuple) -> Column:
    kind, words = test[0], test[1:]
    if kind == "has":
        return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])
    if kind == "is":
        return c.isin(*words)
    if kind == "starts":
        return reduce(lambda a, b: a | b, [F.startswith(c, F.lit(w)) for w in words])
    prefix, rest = words[0], words[1:]
    return F.startswith(c, F.lit(prefix)) & _test(c, ("has", *rest))


def classify(c: Column, rules: list, default: str) -> Column:
    """First matching label, else ``default``; NULL text gets ``default`` too."""
    out = None
    for label, tests in rules:
        cond = reduce(lambda a, b: a | b, [_test(c, t) for t in tests])
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def industry_sector(raw: Column) -> Column:
    """Sector of a free-text industry name."""
    text = F.upper(F.trim(F.trim(raw), F.lit('"')))
    return classify(text, INDUSTRY_RULES, "OTHERS")


def variable_group(name: Column) -> Column:
    return classify(F.lower(name), VARIABLE_GROUP_RULES, "other")


def variable_family(name: Column) -> Column:
    return classify(F.lower(name), VARIABLE_FAMILY_RULES, "unknown")


def effect_label(partial_r2: Column) -> Column:
    """Size word for a partial R2."""
    size = F.abs(partial_r2)
    out = F.when(partial_r2.isNull(), F.lit("unknown"))
    for cut, label in EFFECT_BANDS:
        out = out.when(size >= cut, F.lit(label))
    return out.otherwise(F.lit("negligible"))


def rules_sql(expr: str, rules: list, default: str) -> str:
    """The rule table as a SQL CASE over ``expr``."""

    def one(test):
        kind, words = test[0], test[1:]
        if kind == "has":
            return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"
        if kind == "is":
            return f"{expr} IN (" + ", ".join(f"'{w}'" for w in words) + ")"
        if kind == "starts":
            return "(" + " OR ".join(f"starts_with({expr}, '{w}')" for w in words) + ")"
        return f"(starts_with({expr}, '{words[0]}') AND {one(('has', *words[1:]))})"

    arms = " ".join(f"WHEN {' OR '.join(one(t) for t in tests)} THEN '{label}'" for label, tests in rules)
    return f"CASE {arms} ELSE '{default}' END"
