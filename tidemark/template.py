"""Templates: text with ``{}`` holes whose values are always bound as named parameters, never spliced in."""

from __future__ import annotations

from string import Formatter

from tidemark.errors import QueryError


def bind(text: str, values: tuple, first: int = 0, prefix: str = "p") -> tuple[str, dict[str, object]]:
    """SQL with ``:p<n>`` in place of holes, and the values by name. Holes may be empty, or numbered; a format given in
    a hole is ignored; ``{{`` and ``}}`` are braces. A hole without value, a value without hole, or a stray brace raises."""
    out, used, automatic = [], set(), 0
    try:
        parts = list(Formatter().parse(text))
    except ValueError as wrong:
        raise QueryError(f"malformed template {text!r}: {wrong}") from wrong
    numbered = {name.split(",")[0].strip() != "" for _, name, _, _ in parts if name is not None}
    if len(numbered) > 1:
        raise QueryError(f"numbered and unnumbered holes together: {text!r}")
    for literal, name, _, conversion in parts:
        out.append(literal)
        if name is None:
            continue
        name = name.split(",")[0].strip()
        if conversion or (name and not name.isdigit()):
            raise QueryError(f"a hole is empty or a number: {text!r}")
        at = int(name) if name else automatic
        automatic += 1
        if at >= len(values):
            raise QueryError(f"no value for hole {at} of {text!r}")
        used.add(at)
        out.append(f":{prefix}{first + at}")
    if len(used) < len(values):
        raise QueryError(f"{len(values)} values for {len(used)} holes: {text!r}")
    return "".join(out), {f"{prefix}{first + k}": v for k, v in enumerate(values)}
