"""Names for helper columns that can't clash with a table's own."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with a number behind it if the table (names differ by more than case) has it already."""
    seen, found = {t.lower() for t in taken}, []
    for name in wanted:
        candidate, i = name, 0
        while candidate.lower() in seen:
            candidate, i = f"{name}_{i}", i + 1
        seen.add(candidate.lower())
        found.append(candidate)
    return found
