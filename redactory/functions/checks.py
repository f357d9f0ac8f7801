"""Checksums of identifiers as expressions over a string of digits."""

from __future__ import annotations


def weighted(d, digits: str, weights: list[int]) -> str:
    """Sum of digit times weight, from the left."""
    return "(" + " + ".join(f"{w} * CAST({d.at(digits, i + 1)} AS INT)" for i, w in enumerate(weights)) + ")"


def _guarded(length_is: str, check: str) -> str:
    return f"(CASE WHEN {length_is} THEN {check} ELSE false END)"


def luhn(d, digits: str) -> str:
    """Every second digit from the right is doubled, and its own digits summed; the total must end in 0."""
    if d.name == "spark":
        return f"luhn_check({digits})"
    place = f"CAST({d.at(digits, 'i')} AS INT)"
    doubled = f"(CASE WHEN (length({digits}) - i) % 2 = 1 THEN ({place} * 2) % 10 + ({place} * 2) // 10 ELSE {place} END)"
    return f"(list_sum(list_transform(range(1, length({digits}) + 1), lambda i: {doubled})) % 10 = 0)"


def tfn(d, digits: str) -> str:
    """Tax file number, 8 or 9 digits."""
    weights = [1, 4, 3, 7, 5, 8, 6, 9, 10]
    return f"(CASE length({digits}) WHEN 9 THEN {weighted(d, digits, weights)} % 11 = 0 WHEN 8 THEN {weighted(d, digits, weights[:8])} % 11 = 0 ELSE false END)"


def medicare(d, digits: str) -> str:
    """Medicare number: ten digits, the first 2 to 6, the ninth a check digit."""
    check = f"{d.at(digits, 1)} BETWEEN '2' AND '6' AND {weighted(d, digits, [1, 3, 7, 9, 1, 3, 7, 9])} % 10 = CAST({d.at(digits, 9)} AS INT)"
    return _guarded(f"length({digits}) = 10", check)


def abn(d, digits: str) -> str:
    """Business number: 11 digits, the first less one, modulo 89."""
    return _guarded(f"length({digits}) = 11", f"({weighted(d, digits, [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19])} - 10) % 89 = 0")
