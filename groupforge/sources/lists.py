"""Published lists of group companies: line formats as column expressions, and whole documents with their state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupforge.plans.storage import ship

#: Methods of consolidation in words and in short, and what they count as.
LONG = {"Intégration globale": "IG", "Mise en équivalence": "MEE", "Opération conjointe": "autre", "Intégration proportionnelle": "autre"}
SHORT = {"IG": "IG", "MEE": "MEE", "ME": "MEE", "IP": "autre", "JV": "autre"}
ROW_METHODS = SHORT | {"NC": "NC"}
#: Titles above lists of companies that are left out of the consolidation.
BARE_TITLES = ("non incluses dans la consolidation", "non comprises dans la consolidation", "non consolidées")
LOOK_BACK = 2


def _share(word: Column, decimal: str = ".,") -> Column:
    """A share as a number, or null: up to three digits, then perhaps a decimal sign and more."""
    return F.when(word.rlike(f"^[0-9]{{1,3}}([{decimal}][0-9]+)?$"), F.translate(word, ",", ".").try_cast("double"))


def _method(of: dict[str, str], text: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in of.items() for x in p])[text]


def _joined(words: Column, first: int | Column, n: Column) -> Column:
    """n words from the place on, counted from 1, with a space between; null if none are left."""
    return F.when(n > 0, F.array_join(F.slice(words, first, F.greatest(n, F.lit(0))), " "))


def _whole(**parts: Column) -> dict[str, Column]:
    """All parts, or none where one lacks."""
    there = F.lit(True)
    for p in parts.values():
        there = there & p.isNotNull() & (p.cast("string") != "")
    return {k: F.when(there, v) for k, v in parts.items()}


def rate_line(line: Column) -> dict[str, Column]:
    """`name country rate method in words`; null if the line has another form. The country is one capitalised word."""
    method, before = F.lit(None).cast("string"), F.lit(None).cast("string")
    for words, short in LONG.items():
        ends = line.endswith(" " + words)
        method, before = F.when(ends, short).otherwise(method), F.when(ends, F.substring(line, F.lit(1), F.length(line) - len(words) - 1)).otherwise(before)
    w = F.split(before, " ")
    country = F.get(w, F.size(w) - 2)
    country = F.when(country.rlike(r"^\p{Lu}[\p{L}'-]*$"), country)
    return _whole(name=_joined(w, 1, F.size(w) - 2), country=country, rate=_share(F.get(w, F.size(w) - 1), ","), method=method)


def _after_comma(line: Column) -> tuple[Column, Column]:
    """What stands before the last comma with a space, and the words after it; a last percent sign is no word."""
    tail = F.substring_index(line, ", ", -1)
    before = F.when(F.contains(line, F.lit(", ")) & line.endswith("%"), F.substring(line, F.lit(1), F.length(line) - F.length(tail) - 2))
    return before, F.split(F.rtrim(F.substring(tail, F.lit(1), F.length(tail) - 1)), " ")


def town_line(line: Column) -> dict[str, Column]:
    """`name and town, country method rate %`; the town stays in the name, which has to be tried as both."""
    name, w = _after_comma(line)
    n = F.size(w)
    return _whole(name=name, country=_joined(w, 1, n - 2), rate=_share(F.get(w, n - 1)), method=_method(SHORT, F.get(w, n - 2)))


def bare_line(line: Column) -> dict[str, Column]:
    """`name and town, country rate %`: companies left out of the consolidation, to be read after their title only."""
    name, w = _after_comma(line)
    return _whole(name=name, country=_joined(w, 1, F.size(w) - 1), rate=_share(F.get(w, F.size(w) - 1)), method=F.lit("NC"))


def report_row(line: Column) -> dict[str, Column]:
    """`name | country | control | interest | method`, and more cells of the year before."""
    cell = F.split(line, r" \| ")
    part = [F.get(cell, F.lit(i)) for i in range(5)]
    control, rate = _share(part[2]), _share(part[3])
    return _whole(name=part[0], country=part[1], rate=F.when(control.isNotNull(), rate), method=_method({k: v for k, v in ROW_METHODS.items() if k != "JV"}, part[4]))


def table_line(line: Column) -> dict[str, Column]:
    """`name | country | rate`; rows whose last cell is no share up to 100 are none."""
    cells = F.transform(F.split(line, r" \| "), lambda x: F.trim(x))
    rate = F.translate(F.translate(F.get(cells, F.size(cells) - 1), "% ", ""), ",", ".").try_cast("double")
    good = (F.size(cells) >= 3) & (rate >= 0) & (rate <= 100)
    return {"name": F.when(good, F.get(cells, F.lit(0))), "country": F.when(good, F.get(cells, F.lit(1))), "rate": F.when(good, rate)}


def clean(line: Column) -> Column:
    """Without invisible characters; all dashes are hyphens, all spaces plain and single."""
    line = F.regexp_replace(line, "[​‌‍⁠﻿­]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(line, "[‐‑]", "-"), "[\\s\u00a0\u202f\u2009]+", " "))


def _is_share(word: str, decimal: str = ".,") -> bool:
    whole, _, rest = word.translate(str.maketrans(decimal, "." * len(decimal))).partition(".")
    return 0 < len(whole) <= 3 and whole.isdecimal() and (rest.isdecimal() or rest == "" and whole == word)


def _in_words(line: str) -> tuple[list[str], str] | None:
    """The words before the rate and a method in words at the line's end, with the rate, and the method."""
    for words, short in LONG.items():
        if line.endswith(" " + words):
            before = line[: -len(words) - 1].split(" ")
            return (before, short) if len(before) > 1 and _is_share(before[-1], ",") else None
    return None


def _with_town(line: str, bare: bool) -> tuple[str, str, str, str] | None:
    """name, country, rate, method of a line whose country follows its last comma; without a method only if bare."""
    name, comma, tail = line.rpartition(", ")
    w = tail.removesuffix("%").rstrip().split(" ")
    if not (comma and name and tail.endswith("%") and _is_share(w[-1])):
        return None
    if len(w) > 2 and w[-2] in SHORT:
        return name, " ".join(w[:-2]), w[-1], SHORT[w[-2]]
    return (name, " ".join(w[:-1]), w[-1], "NC") if bare and len(w) > 1 else None


def _row(line: str) -> tuple[str, str, str, str] | None:
    """name, country, rate, method of a table row with both shares."""
    cell = line.split(" | ")
    if len(cell) < 5 or not (cell[0] and cell[1] and _is_share(cell[2]) and _is_share(cell[3])) or cell[4] == "JV":
        return None
    return (*cell[:2], cell[3], ROW_METHODS[cell[4]]) if cell[4] in ROW_METHODS else None


def _company(line: str, bare: bool) -> tuple[str, str, str, str] | None:
    """name, country, rate, method of one line that is no table row."""
    if found := _in_words(line):
        w, method = found
        if len(w) > 2 and w[-2][:1].isupper():
            return " ".join(w[:-2]), w[-2], w[-1], method
    return _with_town(line, bare)


def document_rows(text: str | None) -> Iterator[tuple[list[str], str, float, str]]:
    """names, country, rate, method of each company line.

    A name may be broken over lines: names are the line's own, then with one and with two lines of plain text right before it. A line that
    ends in a comma may go on in the next one or two. Rows of tables stand alone. Lines without methods count after their title only.
    """
    lines = [x for raw in (text or "").splitlines() if (x := " ".join(raw.split())) and not x.isdigit()]
    before: list[str] = []
    bare, at = False, 0
    while at < len(lines):
        line, used = lines[at], 1
        if found := _row(line):
            before = []
        else:
            line = " ".join(c.strip() for c in line.split("|") if c.strip())
            bare = bare or any(t in line.lower() for t in BARE_TITLES)
            found = _company(line, bare)
            for more in range(2, LOOK_BACK + 2) if line.endswith(",") else ():
                joined = _with_town(" ".join([line, *lines[at + 1 : at + more]]), False)
                if joined and joined[0] == line[:-1]:
                    found, used = joined, more
                    break
        if found:
            name, country, rate, method = found
            yield [name.strip(), *(" ".join([*before[-k:], name.strip()]) for k in range(1, len(before) + 1))], country.strip(), float(rate.replace(",", ".")), method
            before = []
        elif _in_words(line):
            before = []
        else:
            before = [*before, line][-LOOK_BACK:]
        at += used


def documents(docs: DataFrame, id_col: str = "doc", text_col: str = "text") -> DataFrame:
    """id, line, names, country, rate, method of each document; a document is read as a whole in one task."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, n, *r) for i, t in zip(f[id_col], f[text_col], strict=True) for n, r in enumerate(document_rows(t))]
            yield pd.DataFrame(rows, columns=[id_col, "line", "names", "country", "rate", "method"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(read, f"{id_col} {kind}, line int, names array<string>, country string, rate double, method string")
