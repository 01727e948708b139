"""Names: quoting, conversion, safety."""

from __future__ import annotations

import re

from tidemark.errors import QueryError


def quoted(name: str) -> str:
    """A name as an identifier, backticks doubled; control characters and empty names are refused."""
    if not name or re.search(r"[\x00-\x1f\x7f]", name):
        raise QueryError(f"not an identifier: {name!r}")
    return "`" + name.replace("`", "``") + "`"


def qualified(*parts: str) -> str:
    return ".".join(map(quoted, parts))


def converted(name: str, style: str = "none") -> str:
    """A property name as a column name: unchanged, in snake case, or in lower case."""
    if style == "none":
        return name
    if style == "lower":
        return name.lower()
    if style == "snake":
        return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()
    raise QueryError(f"unknown naming style {style!r}")


def safe_comment(text: str) -> str:
    if "/*" in text or "*/" in text or "\0" in text:
        raise QueryError("a tag can't hold comment marks")
    return text
