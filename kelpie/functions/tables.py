"""Tab-separated lines of a text as markdown tables; a line's meaning depends on those before it, so it is a pandas UDF."""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def markdown(rows: list[list[str]]) -> str:
    width = max(map(len, rows))
    head, *body = ["| " + " | ".join((r + [""] * width)[:width]) + " |" for r in rows]
    return "\n".join(["", head, "| " + " | ".join(["---"] * width) + " |", *body, ""])


def _kinds(text: str):
    """(table number or None, line): each line's table, where it belongs to one."""
    table, open_ = 0, False
    for line in text.split("\n"):
        bare = line.strip()
        row = bool(bare) and "\t" in line
        more = open_ and not row and bare[:1] in ("-", "•", "*") and bare != ""
        table += row and not open_
        open_ = row or more
        yield (table if open_ else None), line


def tabs_to_tables(text: str) -> str:
    out: list[str] = []
    for table, group in groupby(_kinds(text), key=lambda x: x[0]):
        lines = [line for _, line in group]
        if table is None:
            out += lines
            continue
        rows: list[list[str]] = []
        for line in lines:
            if "\t" in line:
                rows.append([c.strip() for c in line.split("\t")])
            else:  # a bullet below a row goes on in its last cell
                rows[-1][-1] = "<br>".join(x for x in (rows[-1][-1], line.strip()) if x)
        out.append(markdown(rows))
    return "\n".join(out)


@F.pandas_udf(StringType())
def tables(text: pd.Series) -> pd.Series:
    return text.map(lambda t: tabs_to_tables(t) if t and "\t" in t else t)
