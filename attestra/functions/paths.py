"""Paths as columns: normal form and the reasons why a path may not be written or read. Links are not followed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(path: Column) -> Column:
    """A POSIX path without empty, ``.`` and resolvable ``..`` parts, as the standard library gives it; null stays null.

    One pass over the parts with a stack: ``..`` takes the last part away unless that is ``..`` itself; at the root it
    is dropped. Two leading slashes stay two, more become one.
    """
    absolute = path.startswith("/")

    def step(stack: Column, part: Column) -> Column:
        up = (F.size(stack) > 0) & (F.try_element_at(stack, F.lit(-1)) != "..")
        return (
            F.when(part.isin("", "."), stack)
            .when(part != "..", F.concat(stack, F.array(part)))
            .when(up, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
            .when(absolute, stack).otherwise(F.concat(stack, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    head = F.when(path.rlike("^//(?!/)"), "//").when(absolute, "/").otherwise("")
    out = F.concat(head, F.array_join(parts, "/"))
    return F.when(out == "", ".").otherwise(out)


def join(root: Column, path: Column) -> Column:
    """``path`` below ``root``, in normal form; an absolute path stands for itself."""
    return normalise(F.when(path.startswith("/"), path).otherwise(F.concat(root, F.lit("/"), path)))


def inside(path: Column, root: Column) -> Column:
    """Whether a path lies below another one, both in normal form; nothing lies below itself."""
    return path.startswith(F.when(root == "/", root).otherwise(F.concat(root, F.lit("/")))) & (path != root)


def problem(path: Column, root: Column, forbidden: tuple[str, ...] = (), direct: bool = False) -> Column:
    """First reason why ``path`` may not be used below ``root``, null where it may.

    ``empty``, ``control`` (a character below space), ``relative_root``, ``escapes``, ``forbidden`` (the path lies in or
    at one of the named folders, relative to the root) and, with ``direct``, ``not_a_child`` where it lies deeper.
    """
    base = normalise(root)
    whole = join(base, path)
    named = F.lit(False)
    for folder in forbidden:
        at = join(base, F.lit(folder))
        named = named | (whole == at) | inside(whole, at)
    deep = F.substring(whole, F.length(base) + 2, F.length(whole)).contains("/")
    return (
        F.when(path.isNull() | (path == ""), "empty").when(path.rlike("[\\x00-\\x1f]"), "control")
        .when(root.isNull() | ~root.startswith("/"), "relative_root").when(~inside(whole, base), "escapes")
        .when(named, "forbidden").when(F.lit(direct) & deep, "not_a_child")
    )
