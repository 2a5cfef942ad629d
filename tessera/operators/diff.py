"""Line differences of two versions of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shipping import ship

# The largest table of a comparison, and the lines that a preview shows.
MAX_CELLS = 2_000_000
SHOWN = 200


def line_changes(old: str, new: str) -> list[str]:
    """`- ` and `+ ` lines in order, of a longest common subsequence; of two ways, the one that removes first."""
    names: dict[str, int] = {}
    a, b = (np.array([names.setdefault(s, len(names)) for s in t.split("\n")], dtype=np.int64) for t in (old, new))
    n, m = len(a), len(b)
    # common[i, j]: length of the longest one of a[i:] and b[j:]; a row follows from the one below by a running maximum
    common = np.zeros((n + 1, m + 1), dtype=np.int32)
    for i in range(n - 1, -1, -1):
        here = np.where(b == a[i], common[i + 1, 1:] + 1, common[i + 1, :-1])
        common[i, :-1] = np.maximum.accumulate(here[::-1])[::-1]
    x, y, out, i, j = old.split("\n"), new.split("\n"), [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            i, j = i + 1, j + 1
        elif j == m or (i < n and common[i + 1, j] >= common[i, j + 1]):
            out.append("- " + x[i])
            i += 1
        else:
            out.append("+ " + y[j])
            j += 1
    return out


def line_diff(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """pairs with changed, lines_added, lines_removed and preview.

    All changes are counted; the preview shows SHOWN of them. Pairs of more than
    MAX_CELLS cells (lines times lines) are told by their sizes alone, with null
    counts, so a task's memory is bounded. Null texts are empty.
    """
    ship(pairs.sparkSession)

    @F.pandas_udf("changed boolean, lines_added long, lines_removed long, preview string")
    def changes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for olds, news in batches:
            rows = []
            for x, y in zip(olds, news, strict=True):
                n, m = x.count("\n") + 1, y.count("\n") + 1
                if x == y:
                    rows.append((False, 0, 0, "(no changes)"))
                elif n * m > MAX_CELLS:
                    rows.append((True, None, None, f"(file too large to line-diff in full: {n} -> {m} lines; review the full new content before applying)"))
                else:
                    found = line_changes(x, y)
                    added = sum(s[0] == "+" for s in found)
                    text = "".join(s + "\n" for s in found[:SHOWN])
                    rows.append((True, added, len(found) - added, text + ("... (diff truncated — apply to see the full result)\n" if len(found) > SHOWN else "")))
            out = pd.DataFrame(rows, columns=["changed", "lines_added", "lines_removed", "preview"])
            yield out.astype({"lines_added": "Int64", "lines_removed": "Int64"})

    return pairs.withColumn("__d", changes(F.coalesce(old, F.lit("")), F.coalesce(new, F.lit("")))).select(*pairs.columns, "__d.*")
