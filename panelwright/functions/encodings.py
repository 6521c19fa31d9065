"""Numeric encodings of decisions and graph types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwright.functions.cleaning import to_map

# Decision codes.
SIGNED_ACTION = {"BUY": 1, "INITIAL_POSITION": 1, "HOLD": 0, "SELL": -1}
ACTION_CLASS = {"BUY": 2, "INCREASE": 2, "INITIAL_POSITION": 2, "HOLD": 1, "DECREASE": 0, "SELL": 0}
CLASS_LABEL = {2: "BUY", 1: "HOLD", 0: "SELL"}

# Ids of node and edge types in encoded paths.
NODE_TYPE_IDS = {"Fund": 0, "Stock": 1, "Sector": 2, "MarketRegime": 3, "CausalVariable": 4, "TimePeriod": 5, "PAD": 6}
EDGE_TYPE_IDS = {
    "HOLDS": 1, "BELONGS_TO": 2, "IN_REGIME": 3, "GRANGER_CAUSES": 4, "CAUSES": 5, "CAUSAL_EFFECT": 6,
    "DRIVES_FUND_DECISION": 7, "PAD": 8,
}


def signed_action(c: Column) -> Column:
    return to_map(SIGNED_ACTION, c)


def action_class(c: Column) -> Column:
    return to_map(ACTION_CLASS, c)


def class_label(c: Column) -> Column:
    return to_map(CLASS_LABEL, c)


def is_buy(c: Column) -> Column:
    return (action_class(c) == 2).cast("double")


def is_sell(c: Column) -> Column:
    return (action_class(c) == 0).cast("double")
