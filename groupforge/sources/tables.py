"""Tables of companies in published documents whose columns are not known: each cell says what it is, and rows are believed by their table's shape.

Lines are (doc, line, text), cells stand between bars. Everything is a column expression; a document's titles reach its rows by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groupforge.functions import names

#: Methods in a cell and what they count as; words of a column title about shares; words of a branch; words without an initial.
METHODS = {"IG": "IG", "INTEGRATION GLOBALE": "IG", "MEE": "MEE", "ME": "MEE", "MISE EN EQUIVALENCE": "MEE", "IP": "autre", "JV": "autre"}
SHARE_WORDS = ("%", "POURCENTAGE", "INTERET", "CONTROLE", "DETENTION", "INTEREST", "OWNERSHIP")
BRANCH_WORDS = ("SUCCURSALE", "SUCC", "BRANCH", "NIEDERLASSUNG", "SUCURSAL")
SMALL_WORDS = ("DE", "DU", "DES", "D", "L", "LA", "LE", "LES", "ET", "EN", "A", "AU", "AUX")
MOST_SHARES, GAP, LONG_LINE = 4, 3, 80
FRANCE, COUNTRY, ZONE = "france", "country", "zone"


def cells(text: Column) -> Column:
    """The cells of a row without marks of notes and percent signs, and without the empty ones at both ends; those inside stay."""
    bare = F.transform(F.split(text, r"\|"), lambda c: F.trim(F.regexp_replace(F.trim(c), r"\s*(\([0-9]+\)|\*+|%)$", "")))
    filled = F.filter(F.transform(bare, lambda c, i: F.when(c != "", i)), lambda i: i.isNotNull())
    first, last = F.array_min(filled), F.array_max(filled)
    return F.when(F.size(filled) > 0, F.slice(bare, first + 1, last - first + 1)).otherwise(F.array().cast("array<string>"))


def _kind(cell: Column, key: Column, countries: Column) -> Column:
    """What a cell is: empty, number, share, amount, method, a kind of country, or text."""
    place = F.coalesce(countries[key], F.when(cell.contains(","), countries[names.norm(F.substring_index(cell, ",", 1))]))
    return (
        F.when(cell.isin("", "-", "—"), "empty").when(cell.rlike("^[0-9]{9}$"), "number").when(cell.rlike("^[0-9]{1,3}([.,][0-9]+)?$"), "share")
        .when(cell.rlike("^[0-9][0-9 .,]*$"), "amount").when(key.isin(list(METHODS)), "method").otherwise(F.coalesce(place, F.lit("text")))
    )


def country_map(countries: dict[str, str]) -> Column:
    """Normalised names of countries and zones to france, country or zone."""
    return F.create_map(*[F.lit(x) for pair in sorted(countries.items()) for x in pair])


def table_rows(lines: DataFrame, countries: dict[str, str]) -> DataFrame:
    """doc, line, name, country, method, rate of the rows of companies in France.

    A row has a name of two letters or more that is no branch's, a country and one to four shares of at most 100, and no amount; the first share counts. The country is a cell, or the
    table's title (`France | shares | ...`, until the next title, a line that is a country, or a long line of text; as many cells as the
    row). A row that three empty cells part from its first share has left the group. A row without a method needs two shares or one with
    decimals, and is believed below a title, or if the document has a row of another country in the same shape.
    """
    known = country_map(countries)
    rows = lines.select("doc", "line", "text", F.contains("text", F.lit("|")).alias("row"), cells(F.col("text")).alias("cells"))
    rows = rows.withColumn("c", F.transform("cells", lambda c: F.struct(c.alias("cell"), names.norm(c).alias("key"))))
    rows = rows.withColumn("c", F.transform("c", lambda x: F.struct(x["cell"].alias("cell"), x["key"].alias("key"), _kind(x["cell"], x["key"], known).alias("kind"))))
    places = (FRANCE, COUNTRY, ZONE)
    first = F.get("c", F.lit(0))
    about = F.forall(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(1))), lambda x: F.reduce(F.array(*[F.lit(w) for w in SHARE_WORDS]), F.lit(False), lambda a, w: a | F.contains(F.upper(names.plain(x["cell"])), w)))
    title = F.col("row") & (F.size("c") > 1) & first["kind"].isin(*places) & about
    ends = ~F.col("row") & ((F.length("text") > LONG_LINE) | known[names.norm(F.col("text"))].isNotNull())
    event = F.when(title, F.struct(first["kind"].alias("kind"), F.size("c").alias("size"))).when(ends, F.struct(F.lit("").alias("kind"), F.lit(-1).alias("size")))
    rows = rows.withColumn("above", F.last(event, ignorenulls=True).over(W.partitionBy("doc").orderBy("line").rowsBetween(W.unboundedPreceding, -1))).where(F.col("row") & ~title)
    kinds = F.transform("c", lambda x: x["kind"])
    rows = rows.withColumn("kinds", kinds).withColumn("named", F.array_position("kinds", "text").cast("int"))
    after = F.filter("c", lambda x, i: (x["kind"] == "share") & (i >= F.col("named")))
    at = F.array_min(F.filter(F.transform("kinds", lambda k, i: F.when(k.isin(*places), i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("shares", after).withColumn("at", at).withColumn("first_share", F.array_min(F.filter(F.transform("kinds", lambda k, i: F.when((k == "share") & (i >= F.col("named")), i)), lambda i: i.isNotNull())))
    gap = F.array_join(F.transform(F.slice("kinds", F.col("named") + 1, F.greatest(F.coalesce("first_share", "named") - F.col("named"), F.lit(0))), lambda k: F.when(k == "empty", "_").otherwise("x")), "")
    too_much = F.exists("c", lambda x: (x["kind"] == "share") & (F.translate(x["cell"], ",", ".").cast("double") > 100))
    good = (F.col("named") > 0) & F.size("shares").between(1, MOST_SHARES) & ~F.array_contains("kinds", "amount") & ~too_much & ~gap.contains("_" * GAP)
    name = F.get("cells", F.col("named") - 1)
    good = good & (F.length(F.regexp_replace(name, r"\P{L}", "")) >= 2) & ~F.arrays_overlap(F.split(names.norm(name), " "), F.array(*[F.lit(w) for w in BRANCH_WORDS]))
    method = F.create_map(*[F.lit(x) for p in METHODS.items() for x in p])[F.get(F.filter("c", lambda x: x["kind"] == "method"), F.lit(0))["key"]]
    decimals = F.exists("shares", lambda x: x["cell"].rlike("[.,]")) | F.coalesce(F.get("cells", F.col("at")).contains(","), F.lit(False))
    rows = rows.where(good).withColumn("method", method).withColumn("own", F.get("kinds", F.col("at")))
    titled = F.coalesce(F.col("above.size") == F.size("c"), F.lit(False))
    rows = rows.where(F.when(F.col("own").isNull(), titled).otherwise(F.col("method").isNotNull() | (F.size("shares") > 1) | decimals))
    rows = rows.select(
        "doc", "line", F.get("cells", F.col("named") - 1).alias("name"), F.coalesce("own", "above.kind").alias("country"), F.coalesce("method", F.lit("inconnue")).alias("method"),
        F.translate(F.get("shares", F.lit(0))["cell"], ",", ".").cast("double").alias("rate"), F.col("method").isNotNull().alias("told"), titled.alias("titled"), "own", F.size("c").alias("size"), F.coalesce("at", F.lit(-1)).alias("at"),
    )
    lists = rows.where(F.col("own") == COUNTRY).select("doc", "size", "at").distinct().withColumn("listed", F.lit(True))
    met = rows.where(F.col("country") == FRANCE).join(lists, ["doc", "size", "at"], "left")
    return met.where(F.col("told") | F.col("titled") | F.col("listed")).select("doc", "line", "name", "country", "method", "rate")


def town_candidates(name: Column, before: Column) -> Column:
    """Names and towns that `name and town` may mean, in the order to be tried: structs of name, town, needs_town, fallback.

    before: the lines that may hold the beginning of a broken name; the longest beginnings come first. A town has one to three words.
    """
    w = F.split(name, " ")
    n = F.size(w)

    def parted(k: int, head: Column, needs: bool, fallback: bool = False) -> Column:
        own = F.array_join(F.slice(w, 1, F.greatest(n - k, F.lit(0))), " ")
        whole = F.trim(F.concat_ws(" ", head, F.lit(None).cast("string") if fallback else own))
        return F.struct((F.concat_ws(" ", head, name) if fallback else whole).alias("name"), F.array_join(F.slice(w, F.greatest(n - k + 1, F.lit(1)), F.least(F.lit(k), n)), " ").alias("town"), F.lit(needs).alias("needs_town"), F.lit(fallback).alias("fallback"))

    none = F.lit(None).cast("string")
    heads = F.transform(before, lambda _, i: F.array_join(F.slice(before, i + 1, F.size(before)), " "))
    joined = F.flatten(F.transform(heads, lambda h: F.filter(F.array(*[F.struct(F.lit(k).alias("k"), parted(k, h, True).alias("c")) for k in (1, 2, 3)]), lambda x: x["k"] <= n)))
    joined = F.transform(joined, lambda x: x["c"])
    alone = F.array(*[F.struct(F.lit(k).alias("k"), parted(k, none, k > 1).alias("c")) for k in (1, 2, 3)], F.struct(F.lit(1).alias("k"), parted(1, none, True, True).alias("c")))
    return F.concat(joined, F.transform(F.filter(alone, lambda x: x["k"] < n), lambda x: x["c"]))


def acronym_sides(name: Column) -> Column:
    """[name, acronym] of `name - ACRONYM` or `ACRONYM - name`, else null: the acronym's three or more signs are read, in their order, in the
    initials of the name's words (small words have none), and both begin alike."""
    side = F.split(name, " [-–] ")

    def reads(short: Column, long: Column) -> Column:
        signs = F.regexp_replace(short, "[^A-Z0-9]", "")
        initials = F.array_join(F.transform(F.filter(F.split(names.norm(long), " "), lambda x: ~x.isin(*SMALL_WORDS)), lambda x: F.substring(x, 1, 1)), "")
        pattern = F.concat(F.lit("^"), F.array_join(F.split(signs, ""), ".*"))
        return short.rlike("^[A-Z0-9.& ]{3,12}$") & (F.length(signs) >= 3) & (initials != "") & F.regexp_like(initials, pattern)

    a, b = F.get(side, F.lit(0)), F.get(side, F.lit(1))
    return F.when(F.size(side) == 2, F.when(reads(b, a), F.array(a, b)).when(reads(a, b), F.array(b, a)))
