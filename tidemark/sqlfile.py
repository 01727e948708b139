"""SQL kept in files with dialect sections, and named templates."""

from __future__ import annotations

import re
from pathlib import Path, PurePosixPath

from tidemark.errors import QueryError

#: Dialects that a section may name; ``all`` goes to every one.
DIALECTS = ("spark", "pg", "mysql", "sqlite", "all")
TEMPLATES: dict[str, str] = {}


def sections(text: str, dialect: str = "spark") -> str:
    """The lines for one dialect, in the file's order: those before the first ``-- @name`` line, those of ``@all`` and
    those of the dialect. A file that names dialects, but neither this one nor all, is an error."""
    out, names, current = [], set(), "all"
    for line in text.splitlines():
        if mark := re.fullmatch(r"\s*--\s*@(\w+)\s*", line):
            current = mark[1].lower()
            if current not in DIALECTS:
                raise QueryError(f"unknown dialect {current!r}")
            names.add(current)
        elif current in ("all", dialect):
            out.append(line)
    if names and not names & {"all", dialect}:
        raise QueryError(f"no section for {dialect}")
    return "\n".join(out).strip()


def load_sql(root: str, path: str, dialect: str = "spark") -> str:
    """SQL from a file under ``root``. Absolute paths, drive letters and ``..`` are refused."""
    pure = PurePosixPath(path.replace("\\", "/"))
    if pure.is_absolute() or ".." in pure.parts or ":" in path or not path.strip():
        raise QueryError(f"not a relative path: {path!r}")
    found = (Path(root) / pure).resolve()
    if not found.is_relative_to(Path(root).resolve()):
        raise QueryError(f"{path!r} leaves its root")
    if not found.is_file():
        raise QueryError(f"no file {path!r}")
    return sections(found.read_text(encoding="utf-8"), dialect)


def sql_template(name: str, text: str) -> str:
    """Registers a template under a name of its own."""
    if TEMPLATES.setdefault(name, text) != text:
        raise QueryError(f"template {name!r} exists with other text")
    return text
