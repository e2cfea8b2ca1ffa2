"""Ids from file names and paths. Each parser gives (pid, cam) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).cast("int")


def market(name: Column) -> tuple[Column, Column]:
    """``0844_c3s2_107328_01.jpg``; junk files start with -1."""
    pattern = r"([-\d]+)_c(\d)"
    return _number(name, pattern, 1), _number(name, pattern, 2)


def underscore(name: Column) -> tuple[Column, Column]:
    """``0002_c15_f0044158.jpg``: cameras may have two digits."""
    pattern = r"([-\d]+)_c(\d+)"
    return _number(name, pattern, 1), _number(name, pattern, 2)


def augmented(name: Column) -> tuple[Column, Column, Column]:
    """``0589_c3s2_006893_03_623.jpg``: the last field has the source camera first and the target camera third."""
    stem = F.regexp_replace(name, r"\.jpg$", "")
    last = F.element_at(F.split(stem, "_"), -1)
    return F.split(stem, "_")[0].cast("int"), F.substring(last, 1, 1).cast("int"), F.substring(last, 3, 1).cast("int")


def split_fields(name: Column) -> tuple[Column, Column]:
    """``<pid>_c<cam>_...`` by its fields; the camera isn't shifted."""
    part = F.split(name, "_")
    return part[0].cast("int"), F.regexp_replace(part[1], r"^c0*", "").cast("int")


def by_place(path: Column) -> tuple[Column, Column]:
    """``.../cam3/0001/0001.jpg``: camera and identity stand at fixed places from the end."""
    n = F.length(path)
    return F.substring(path, n - 12, 4).cast("int"), F.substring(path, n - 14, 1).cast("int")


def padded(number: Column) -> Column:
    return F.lpad(number.cast("string"), 4, "0")
