"""Nested records, periods, page feeds, index files and documents."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from groupforge.plans.storage import ship
from groupforge.sources.html import page_lines

#: What is read of a company's formality; other fields are ignored, other types make the record invalid.
FORMALITY = """id string, siren string, updatedAt timestamp, formality struct<siren: string, typePersonne: string, diffusionCommerciale: boolean, content: struct<personneMorale: struct<
    identite: struct<entreprise: struct<siren: string, denomination: string, nombreSalarie: bigint>>, detailCessationEntreprise: struct<dateRadiation: date>,
    composition: struct<pouvoirs: array<struct<typeDePersonne: string, roleEntreprise: string, actif: boolean, entreprise: struct<siren: string>,
        individu: struct<descriptionPersonne: struct<nom: string, prenoms: array<string>, dateDeNaissance: string>>>>>>>>, broken string"""


def formalities(records: DataFrame, json_col: str = "json") -> DataFrame:
    """siren, denomination, commercial, staff, struck, valid, edges, seats of each record; records that don't parse, or without a company, are not valid.

    edges: (parent, role) of companies that hold a role; seats: (person, role), person being an opaque key that stays inside the register.
    """
    parsed = F.from_json(F.col(json_col), FORMALITY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    r = records.select(parsed.alias("r")).select("r.*")
    legal = F.col("formality.content.personneMorale")
    powers = F.filter(F.coalesce(legal["composition"]["pouvoirs"], F.array()), lambda p: F.coalesce(p["actif"], F.lit(True)))

    def person(p: Column) -> Column:
        who = p["individu"]["descriptionPersonne"]
        return F.concat_ws("|", F.upper(who["nom"]), F.upper(F.get(who["prenoms"], F.lit(0))), F.substring(who["dateDeNaissance"], 1, 7))

    edges = F.transform(F.filter(powers, lambda p: p["typeDePersonne"].eqNullSafe("ENTREPRISE") & p["entreprise"]["siren"].isNotNull()), lambda p: F.struct(p["entreprise"]["siren"].alias("parent"), p["roleEntreprise"].alias("role")))
    seats = F.transform(F.filter(powers, lambda p: p["typeDePersonne"].eqNullSafe("INDIVIDU")), lambda p: F.struct(person(p).alias("person"), p["roleEntreprise"].alias("role")))
    firm = legal["identite"]["entreprise"]
    return r.select(
        "siren", firm["denomination"].alias("denomination"), F.col("formality.diffusionCommerciale").alias("commercial"), firm["nombreSalarie"].alias("staff"),
        legal["detailCessationEntreprise"]["dateRadiation"].isNotNull().alias("struck"), (F.col("broken").isNull() & F.col("siren").isNotNull() & legal.isNotNull()).alias("valid"), edges.alias("edges"), seats.alias("seats"),
    )


def current_period(periods: Column, end: str = "ended") -> Column:
    """The period without an end, else the first one."""
    return F.coalesce(F.get(F.filter(periods, lambda p: p[end].isNull()), F.lit(0)), F.get(periods, F.lit(0)))


class PageFeed(DataSource):
    """A feed of JSON pages `<cursor>.json` = {"next": cursor or null, "rows": [...]}: the offset is the cursor, so a stopped stream goes on
    at the page it had not finished. Options: path (a folder every machine reads), first (the first cursor), columns of the schema."""

    @classmethod
    def name(cls) -> str:
        return "pagefeed"

    def schema(self) -> str:
        return "row string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _PageReader(self.options["path"], self.options.get("first", "0"))


class _PageReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, first: str):
        self.path, self.first = path, first

    def initialOffset(self) -> dict:
        return {"cursor": self.first}

    def _page(self, cursor: str) -> dict | None:
        try:
            with open(f"{self.path}/{cursor}.json", encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        page = self._page(start["cursor"])
        if page is None:
            return iter([]), start
        after = page.get("next") or f"{start['cursor']}-end"
        return iter([(json.dumps(r, sort_keys=True),) for r in page["rows"]]), {"cursor": after}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.read(start)[0]

    def commit(self, end: dict) -> None:
        pass


def read_csv(spark: SparkSession, path: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file whose first line says the separator (of comma, semicolon and tab the most frequent); names in lower case, no byte-order mark."""
    first = spark.read.text(path).first()
    head = (first[0] if first else "").lstrip("﻿")
    sep = max(",;\t", key=head.count)
    frame = spark.read.option("header", True).option("sep", sep).csv(path)
    frame = frame.toDF(*[c.lstrip("﻿").strip().lower() for c in frame.columns])
    if missing := [c for c in needed if c not in frame.columns]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return frame


MAX_BYTES, MAX_UNPACKED = 50 << 20, 300 << 20


def document_text(content: bytes) -> str:
    """Text of a plain, HTML or zipped-report document, told by its first bytes. A zip must hold one report, of a bounded size."""
    if len(content) > MAX_BYTES:
        raise ValueError("the document is too large")
    if content[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            reports = [i for i in z.infolist() if re.search(r"(?i)(^|/)reports/[^/]+\.x?html?$", i.filename)]
            if len(reports) != 1 or reports[0].file_size > MAX_UNPACKED:
                raise ValueError("the package holds no single report of a bounded size")
            with z.open(reports[0]) as f:
                content = f.read(MAX_UNPACKED + 1)
        if len(content) > MAX_UNPACKED:
            raise ValueError("the report is too large")
    if content[:5] == b"%PDF-":
        raise ValueError("PDF needs a text layer read elsewhere")
    text = content.decode("utf-8-sig", "replace")
    return "\n".join(page_lines(text)) if re.match(r"\s*<", text) else text


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, text, problem of each file under path: a document that can't be read says why, and stops no other."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, problems = [], []
            for c in f["content"]:
                try:
                    texts.append(document_text(c))
                    problems.append(None)
                except (ValueError, zipfile.BadZipFile) as e:
                    texts.append(None)
                    problems.append(str(e))
            yield pd.DataFrame({"path": f["path"], "sha256": f["sha256"], "text": texts, "problem": problems})

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")
    return files.mapInPandas(read, "path string, sha256 string, text string, problem string")
