"""Probability formulas as SQL text that Spark and DuckDB both read, and as columns.

Groups have up to three members. A member that is not there has zeros everywhere, so one formula serves all sizes:
``c{j}{i}`` is the probability from member j of the source group to member i of the target group, ``i{a}{b}`` within the
source group, ``h{j}`` a normalised in-heuristic.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEMBERS = (0, 1, 2)


def any_of(parts: list[str]) -> str:
    """Probability that at least one of independent events happens."""
    return "(1.0e0 - " + " * ".join(f"(1.0e0 - ({x}))" for x in parts) + ")"


def any_of_column(p: Column | str) -> Column:
    """The same as an aggregate."""
    return 1 - F.product(1 - (F.col(p) if isinstance(p, str) else p))


def others(j: int) -> tuple[int, int]:
    a, b = (k for k in MEMBERS if k != j)
    return a, b


def direct(j: int, cross: str = "c", to: tuple[int, ...] = MEMBERS) -> str:
    """From member j to any member of the target group by cross edges alone."""
    return any_of([f"{cross}{j}{i}" for i in to])


def simple_path(j: int, first_cross: str = "c", cross: str = "c", first_inner: str = "i", inner: str = "i") -> str:
    """From member j to any target: straight, over one other member, or over both, as if paths were independent.
    The first hop can use other columns (a seed's)."""
    a, b = others(j)
    each = []
    for i in MEMBERS:
        each.append(any_of([f"{first_cross}{j}{i}", f"{first_inner}{j}{a} * {cross}{a}{i}", f"{first_inner}{j}{b} * {cross}{b}{i}", f"{first_inner}{j}{a} * {inner}{a}{b} * {cross}{b}{i}", f"{first_inner}{j}{b} * {inner}{b}{a} * {cross}{a}{i}"]))
    return any_of(each)


def precise_path(start: tuple[int, ...], cross: str = "c", inner: str = "i") -> str:
    """From the set ``start`` of members to any target, exactly: what the start does not reach directly, it may reach
    over the members that it activates."""
    d = {j: direct(j, cross) for j in MEMBERS}
    rest = [j for j in MEMBERS if j not in start]
    here = any_of([d[j] for j in start])
    terms = []
    for n in range(1, len(rest) + 1):
        for hit in combinations(rest, n):
            chance = [any_of([f"{inner}{j}{k}" for j in start]) if k in hit else f"(1.0e0 - {any_of([f'{inner}{j}{k}' for j in start])})" for k in rest]
            left = [k for k in rest if k not in hit]
            onward = any_of([d[k] for k in hit])
            if left:
                k = left[0]
                onward = f"({onward} + (1.0e0 - {onward}) * {any_of([f'{inner}{j}{k}' for j in hit])} * {d[k]})"
            terms.append(f"{' * '.join(chance)} * {onward}")
    return f"({here} + (1.0e0 - {here}) * ({' + '.join(terms)}))" if terms else here


def merged(rule: str, cross: str = "c", inner: str = "i", h: str = "h") -> str:
    """Merged probability of an edge between groups of several members; h sums to 1."""
    simple = [simple_path(j, cross, cross, inner, inner) for j in MEMBERS]
    enter = any_of([f"{h}{j}" for j in MEMBERS])
    if rule == "SEPARATE_SIMPLE":
        return "(" + " + ".join(f"{h}{j} * {simple[j]}" for j in MEMBERS) + ")"
    if rule == "MERGED_SIMPLE":
        return f"({any_of([f'{h}{j} * {simple[j]}' for j in MEMBERS])} / {enter})"
    if rule == "SEPARATE_PRECISE":
        return "(" + " + ".join(f"{h}{j} * {precise_path((j,), cross, inner)}" for j in MEMBERS) + ")"
    if rule == "MERGED_PRECISE":
        terms = []
        for n in (1, 2, 3):
            for s in combinations(MEMBERS, n):
                factors = [f"{h}{j}" if j in s else f"(1.0e0 - {h}{j})" for j in MEMBERS]
                terms.append(f"{' * '.join(factors)} * {precise_path(s, cross, inner)}")
        return f"(({' + '.join(terms)}) / {enter})"
    raise ValueError(f"unknown edge weight rule {rule}")


def reach_within(j: int, k: int, first: str = "i", inner: str = "i") -> str:
    """From member j to member k of the same group, straight or over the third."""
    third = next(x for x in MEMBERS if x not in (j, k))
    return any_of([f"{first}{j}{k}", f"{first}{j}{third} * {inner}{third}{k}"])


def member_weight(k: int, h: str = "h", inner: str = "i") -> str:
    """Probability that member k is reached, if the group is entered by its in-heuristics."""
    a, b = others(k)
    return any_of([f"{h}{k}", f"{h}{a} * {inner}{a}{k}", f"{h}{a} * {inner}{a}{b} * {inner}{b}{k}", f"{h}{b} * {inner}{b}{k}", f"{h}{b} * {inner}{b}{a} * {inner}{a}{k}"])


def normalised(parts: list[str], unit: bool = False) -> list[str]:
    """Clipped at 0 (UNIT: to 0 or 1), divided by their sum; null where all are zero."""
    clipped = [f"(case when ({x}) < 1e-8 then 0e0 else 1e0 end)" if unit else f"greatest({x}, 0e0)" for x in parts]
    total = " + ".join(clipped)
    return [f"(case when {total} > 0e0 then {x} / ({total}) end)" for x in clipped]


def first_best(gains: list[str], size: str) -> str:
    """Index of the greatest gain among the first ``size`` members; the lowest of equals."""
    a, b, c = gains
    return f"(case when {size} >= 3 and ({c}) > ({a}) and ({c}) > ({b}) then 2 when {size} >= 2 and ({b}) > ({a}) then 1 else 0 end)"
