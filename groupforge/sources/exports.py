"""Files for people: spreadsheet CSV and a reproducible zip of small tables."""

from __future__ import annotations

import csv
import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupforge.functions.names import safe_cell

EPOCH = (1980, 1, 1, 0, 0, 0)


def spreadsheet_csv(df: DataFrame, path: str) -> None:
    """Semicolons, CRLF, a byte-order mark, and no cell that a spreadsheet runs. Written by the cluster, a part file each task."""
    cells = [safe_cell(F.col(c).cast("string")).alias(("﻿" if i == 0 else "") + c) for i, c in enumerate(df.columns)]
    df.select(*cells).write.option("header", True).option("sep", ";").option("lineSep", "\r\n").option("quoteAll", False).csv(path)


def csv_text(columns: list[str], rows: list[tuple]) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(columns)
    for r in rows:
        cells = ["" if v is None else str(v) for v in r]
        writer.writerow(["'" + c if c[:1] in ("=", "+", "-", "@", "\t", "\r") else c for c in cells])
    return out.getvalue()


def zipped(tables: dict[str, DataFrame], limit: int = 100_000) -> bytes:
    """A zip of CSV files that is the same for the same rows: sorted rows, fixed times. For one group's tables; larger ones are refused."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(tables):
            rows = tables[name].limit(limit + 1).collect()
            if len(rows) > limit:
                raise ValueError(f"{name} has more than {limit} rows")
            text = csv_text(tables[name].columns, sorted(map(tuple, rows), key=lambda r: [(v is None, str(v)) for v in r]))
            z.writestr(zipfile.ZipInfo(f"{name}.csv", EPOCH), text)
    return out.getvalue()
