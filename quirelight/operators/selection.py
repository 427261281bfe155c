"""Range specifications: which passages of an ordered list a run takes."""

from __future__ import annotations


def parse_ranges(spec: str, n: int) -> list[int] | None:
    """Positions (from 1, sorted) of ``"1-3, 7, 9-"``; blank is everything (None); anything doubtful is refused."""
    if not spec.strip():
        return None
    out: set[int] = set()
    for part in spec.split(","):
        first, dash, last = (x.strip() for x in part.partition("-"))
        if not first.isascii() or not first.isdigit() or dash and last and not last.isdigit():
            raise ValueError(f"not a range: {part.strip()!r}")
        a = int(first)
        b = (int(last) if last else n) if dash else a
        if not 1 <= a <= n or not a <= b <= n:
            raise ValueError(f"out of 1-{n}: {part.strip()!r}")
        out.update(range(a, b + 1))
    return sorted(out)
