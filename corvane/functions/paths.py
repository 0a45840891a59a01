"""Paths with slashes as column expressions: normal forms, resolution against a folder, containment in one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(x: Column, use) -> Column:
    """use(x) where x is computed once, however often use refers to it."""
    return F.transform(F.array(x), use)[0]


def normal(path: Column) -> Column:
    """Without empty parts, "." and what ".." takes back. ".." at the root goes; before a relative path it stays; nothing is "."."""

    def of(x: Column) -> Column:
        absolute = x.startswith("/")
        parts = F.filter(F.split(x, "/", -1), lambda p: (p != "") & (p != "."))

        def step(held: Column, p: Column) -> Column:
            last = F.try_element_at(held, F.lit(-1))
            return F.when(p != "..", F.array_append(held, p)).when(last.isNotNull() & (last != ".."), F.slice(held, F.lit(1), F.size(held) - 1)).when(absolute, held).otherwise(F.array_append(held, p))

        kept = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
        return bind(kept, lambda k: F.when(absolute, F.concat(F.lit("/"), k)).when(k == "", ".").otherwise(k))

    return bind(path, of)


def resolved(folder: Column, path: Column) -> Column:
    """A path in normal form; a relative one starts in folder."""
    return normal(F.when(path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path)))


def within(folder: Column, path: Column) -> Column:
    """Whether a path, both in normal form, is the folder or lies in it."""
    return (path == folder) | path.startswith(F.when(folder == "/", folder).otherwise(F.concat(folder, F.lit("/"))))


def in_folder(folder: Column, path: Column) -> Column:
    """Where a listed path lies below an absolute folder ("." for itself); null for blank paths and those that leave it.

    A relative path may begin with the folder's own name.
    """

    def of(top: Column, raw: Column) -> Column:
        name = F.element_at(F.split(top, "/"), -1)
        own = F.when((name != "") & ((raw == name) | raw.startswith(F.concat(name, F.lit("/")))), F.concat(F.lit("."), F.substring(raw, F.length(name) + 1, F.length(raw)))).otherwise(raw)

        def below(full: Column) -> Column:
            rest = F.ltrim(F.substring(full, F.length(top) + 1, F.length(full)), F.lit("/"))
            return F.when((raw != "") & within(top, full), F.when(rest == "", ".").otherwise(rest))

        return bind(resolved(top, F.when(raw.startswith("/"), raw).otherwise(own)), below)

    return bind(normal(folder), lambda top: bind(F.trim(path), lambda raw: of(top, raw)))
