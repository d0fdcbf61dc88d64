"""Arrow batches cut by characters, so that very long texts don't add up in a worker."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def slices(texts: Sequence[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about ``chars`` characters; a longer text is alone in its range, whole."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > chars:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
