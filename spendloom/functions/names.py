"""Column-name helpers; they look at names only, never at data."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from difflib import SequenceMatcher

from pyspark.sql import DataFrame


def key_of(name: str) -> str:
    """Name reduced to lower-case letters and digits."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def standard_name(name: str) -> str:
    """'purchase_amount_eur' -> 'Purchase Amount Eur'; digits stay with their word."""
    words = re.findall(r"[A-Za-z]+\d*|\d+", name.replace("_", " "))
    return " ".join(w[0].upper() + w[1:] for w in words)


def standard_names(names: Iterable[str]) -> list[str]:
    """Standard names; a name whose digits or whole text would vanish stays as it is."""
    result = []
    for name in names:
        new = standard_name(name)
        lost_digits = re.search(r"\d", name) and not re.search(r"\d", new)
        result.append(name if lost_digits or not new else new)
    return result


def title_name(name: str) -> str:
    """'head_shape' -> 'Head Shape'."""
    return " ".join(part.capitalize() for part in name.strip().split("_") if part)


def distinct_names(names: Sequence[str], case_sensitive: bool = False) -> list[str]:
    """Later copies of a name get the suffix __dup1, __dup2, ..."""
    fold = (lambda n: n) if case_sensitive else str.lower
    taken: set[str] = set()
    copies: dict[str, int] = {}
    result = []
    for name in names:
        new = name
        while fold(new) in taken:
            copies[fold(name)] = copies.get(fold(name), 0) + 1
            new = f"{name}__dup{copies[fold(name)]}"
        taken.add(fold(new))
        result.append(new)
    return result


def similar_names(names: Sequence[str], threshold: float, protect: str) -> dict[str, list[str]]:
    """For each surviving name, the later names that are nearly the same."""
    guarded = re.compile(protect, re.IGNORECASE)
    free = [n for n in names if not guarded.match(n)]
    absorbed: set[str] = set()
    groups: dict[str, list[str]] = {}
    for i, name in enumerate(free):
        if name in absorbed:
            continue
        for other in free[i + 1 :]:
            if other not in absorbed and SequenceMatcher(None, name, other).ratio() > threshold:
                groups.setdefault(name, []).append(other)
                absorbed.add(other)
    return groups


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """The column that fits the candidates best; raises, naming the columns, when none does.

    Earlier candidates win; for one candidate the same name wins over one with the same letters and digits.
    """
    fits = [
        (place, column != candidate, column)
        for place, candidate in enumerate(candidates)
        for column in df.columns
        if column == candidate or key_of(column) == key_of(candidate)
    ]
    if not fits:
        raise ValueError(f"none of {list(candidates)} among the columns {df.columns}")
    return min(fits, key=lambda fit: fit[:2])[2]


def first_present(df: DataFrame, candidates: Iterable[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)
