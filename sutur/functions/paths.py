"""Relative dataset paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sutur.functions.text import is_blank


def portable_path(path: Column) -> Column:
    """Portable form of a relative path, or null where the path is rejected.

    Rejected: null, blank, NUL, absolute or rooted (either slash), a drive or scheme (``:``),
    any ``..`` part, and paths that name no file. Backslashes become slashes; empty and ``.``
    parts vanish.
    """
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    rejected = (
        is_blank(path)
        | path.contains("\u0000")
        | path.contains(":")
        | path.startswith("/")
        | path.startswith("\\")
        | F.array_contains(parts, "..")
        | (F.size(parts) == 0)
    )
    return F.when(~rejected, F.array_join(parts, "/"))


def path_below(path: Column, root: str) -> Column:
    """A file's path below a folder, whatever scheme both are written with; a path outside it stays whole."""
    plain = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    base = "/" + root.split("://")[-1].removeprefix("file:").strip("/") + "/"
    return F.when(plain.startswith(base), F.substr(plain, F.lit(len(base) + 1))).otherwise(plain)
