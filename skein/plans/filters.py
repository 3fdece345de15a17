"""Faceted filters as data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class FilterSpec:
    """AND across facets, OR within one. members: facet to ids, looked up in a table (node, value); values: column to allowed values; ranges: column to inclusive bounds (None: open)."""

    members: dict[str, list] = field(default_factory=dict)
    values: dict[str, list] = field(default_factory=dict)
    ranges: dict[str, tuple] = field(default_factory=dict)

    def apply(self, papers: DataFrame, membership: dict[str, DataFrame]) -> DataFrame:
        for column, allowed in self.values.items():
            papers = papers.filter(F.col(column).isin(allowed))
        for column, (low, high) in self.ranges.items():
            if low is not None:
                papers = papers.filter(F.col(column) >= low)
            if high is not None:
                papers = papers.filter(F.col(column) <= high)
        for facet, ids in self.members.items():
            papers = papers.join(membership[facet].filter(F.col("value").isin(ids)).select("node"), "node", "left_semi")
        return papers


def set_compare_side(view: dict, side: str, value: str | None) -> dict:
    """The view with one side (a or b) of its comparison set. With both sides set, the comparison takes the place of the organisation and author facets and of the selected paper."""
    pair = {"a": None, "b": None} | view.get("compare", {}) | {side: value}
    out = view | {"compare": pair}
    return _without(out, "org", "author", "paper") if None not in pair.values() else out


def compare_with(view: dict, value: str) -> dict:
    """The view with value in the first free side of its comparison, or in the first side if both are taken."""
    pair = {"a": None, "b": None} | view.get("compare", {})
    return set_compare_side(view, next((s for s in ("a", "b") if pair[s] is None), "a"), value)


def select_paper(view: dict, paper: int | None) -> dict:
    """The view with a paper selected, or none. A selection clears the organisation and author facets, which would hide what the paper is linked to."""
    return _without(view, "paper") if paper is None else _without(view, "org", "author") | {"paper": paper}


def _without(view: dict, *names: str) -> dict:
    return {k: v for k, v in view.items() if k not in names}
