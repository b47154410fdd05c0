"""Fetching files that are not there yet, from allowed places only."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable

from pyspark.sql import SparkSession

from quadrat.sources.files import file_system


def wanted(variables: list[str], allowed: list[str], years: range, template: str, *, strict: bool = True) -> dict[str, str]:
    """File name and URL of each variable and year; a variable that is not allowed raises an error, or is left out if not ``strict``."""
    wrong = sorted(set(variables) - set(allowed))
    if wrong and strict:
        raise ValueError(f"not among the allowed variables: {', '.join(wrong)}")
    return {f"{v}_{y}.nc": template.format(variable=v, year=y) for v in variables if v in allowed for y in years}


def months_of(variables: list[str], allowed: list[str], first: tuple[int, int], last: tuple[int, int], template: str) -> dict[str, str]:
    """File name and URL of each allowed variable and month from first to last (year, month)."""
    months = [(y, m) for y in range(first[0], last[0] + 1) for m in range(1, 13) if first <= (y, m) <= last]
    return {f"{v}_{y}_{m:02d}.nc": template.format(variable=v, year=y, month=f"{m:02d}") for v in variables if v in allowed for y, m in months}


def fetch_missing(spark: SparkSession, files: dict[str, str], folder: str, *, timeout: float = 300.0, opener: Callable = urllib.request.urlopen) -> list[str]:
    """Fetches the files that a folder lacks; the names that were fetched. A file is written under another name first, so a broken transfer leaves none."""
    fs, root = file_system(spark, folder)
    fs.mkdirs(root)
    done = []
    for name, url in sorted(files.items()):
        at, part = (file_system(spark, f"{folder}/{n}")[1] for n in (name, f".{name}.part"))
        if fs.exists(at):
            continue
        out = fs.create(part, True)
        try:
            with opener(url, timeout=timeout) as r:
                while chunk := r.read(1 << 20):
                    out.write(bytearray(chunk))
        finally:
            out.close()
        fs.rename(part, at)
        done.append(name)
    return done
