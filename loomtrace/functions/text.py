"""Column helpers of the lineage model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far a hop of each confidence is trusted.
RANKS = {"exact": 5, "validated": 4, "parsed": 3, "declared": 3, "inferred": 2, "fuzzy": 1}
#: Ranks at which reach can differ, and the word for each in a flow.
STEPS = {1: "fuzzy", 2: "inferred", 3: "parsed", 4: "validated", 5: "exact"}
#: Node types in their order.
NODE_TYPES = ["source", "model", "column", "mb_field", "mb_card", "mb_dashboard"]


def rank(confidence: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv)), confidence)


def word(of_rank: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in STEPS.items() for x in kv)), of_rank)


def type_order(node_type: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, NODE_TYPES)), node_type)


def owner_of(node_id: Column) -> Column:
    """What stands before the last ``::``; null for an id that has none."""
    return F.when(node_id.contains("::"), F.regexp_extract(node_id, "(?s)^(.*)::.*$", 1))


def last_segment(name: Column, mark: str = ".") -> Column:
    return F.substring_index(name, mark, -1)


def short_hash(text: Column) -> Column:
    """The first twelve hex digits of a SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 12)


def relationship_id(from_model: Column, from_column: Column, to_model: Column, to_column: Column) -> Column:
    return short_hash(F.lower(F.concat(from_model, F.lit("."), from_column, F.lit("->"), to_model, F.lit("."), to_column)))


def joined(values: Column, mark: str = ", ") -> Column:
    """The distinct values of a group in order, as one text."""
    return F.array_join(F.array_sort(F.collect_set(values)), mark)


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {noun}")).otherwise(F.lit(f" {noun}s")))


def singular(name: Column) -> Column:
    """A name without its English plural, crudely."""
    two = reduce(lambda a, b: a | b, (name.endswith(e) for e in ("ses", "xes", "zes", "ches", "shes")))
    cut = lambda n: F.substring(name, F.lit(1), F.length(name) - n)
    return (
        F.when(name.endswith("ies") & (F.length(name) > 3), F.concat(cut(3), F.lit("y")))
        .when(two, cut(2))
        .when(name.endswith("s") & ~name.endswith("ss"), cut(1))
        .otherwise(name)
    )
