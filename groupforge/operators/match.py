"""Matching the lines of published lists to registered companies by name key, town and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groupforge.functions import names
from groupforge.operators.closure import closure
from groupforge.operators.rules import MEDIUM, STRONG
from groupforge.operators.tree import open_links

COMPACT_LEAST, CODE_LEAST, START_WORDS = 6, 10, 3
DESCENT_ROLES = sorted({*STRONG, *MEDIUM, "53"})
FOUND = ("unique", "commune", "registre", "compacte", "usuelle", "debut")


def _companies(units: DataFrame) -> DataFrame:
    return units.where(F.col("closed").isNull() & (F.col("cj").isNull() | ~F.col("cj").between(1000, 1999)))


def carriers(units: DataFrame, offices: DataFrame) -> DataFrame:
    """kind, key, siren, town: every key a company can be found by. Kinds: name, acronym, compact, usual, closed."""
    towns = offices.select("siren", names.norm(F.col("town")).alias("town"))
    base = _companies(units).join(towns, "siren", "left").withColumn("town", F.coalesce("town", F.lit("")))
    active = base.where("state = 'A'")

    def keyed(rows: DataFrame, kind: str, column: str, make=names.key) -> DataFrame:
        return rows.where(F.col(column).isNotNull()).select(F.lit(kind).alias("kind"), make(F.col(column)).alias("key"), "siren", "town").where("key <> ''")

    out = keyed(active, "name", "denomination").unionByName(keyed(active, "acronym", "acronym")).unionByName(keyed(active, "usual", "usual_name"))
    out = out.unionByName(keyed(active, "compact", "denomination", lambda c: names.compact(names.key(c))))
    out = out.unionByName(keyed(base.where("state <> 'A'"), "closed", "denomination"))
    # dealt by number, as small shuffles of names are large rows in memory, which would be put into a few tasks
    return out.repartition(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")), "siren").distinct()


def controlled() -> F.col:
    """The line's company is controlled: fully consolidated, or above half without a method."""
    return (F.col("method") == "IG") | (F.col("method").isin("NC", "inconnue") & (F.col("rate") > 50))


def _counted(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows, low, high of each (kind, key), and rows_here, low_here, high_here of each (kind, key, city): how many carriers, the smallest and the
    largest. Lines meet these, one row each, and never the carriers, as many lines and many carriers may share a key."""
    all_ = table.groupBy("kind", "key").agg(F.count("siren").alias("rows"), F.min("siren").alias("low"), F.max("siren").alias("high"))
    towns = table.groupBy("kind", "key", F.col("town").alias("commune")).agg(F.count("siren").alias("n"), F.min("siren").alias("l"), F.max("siren").alias("h"))
    towns = towns.select("kind", "key", F.explode(names.cities_of(F.col("commune"))).alias("city"), "n", "l", "h")
    return all_, towns.groupBy("kind", "key", "city").agg(F.sum("n").alias("rows_here"), F.min("l").alias("low_here"), F.max("h").alias("high_here"))


def _tied(carriers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """low, high of each (doc, kind, key), and low_here, high_here of each (doc, kind, key, city). carriers: doc, kind, key, siren, town."""
    all_ = carriers.groupBy("doc", "kind", "key").agg(F.min("siren").alias("low"), F.max("siren").alias("high"))
    towns = carriers.groupBy("doc", "kind", "key", F.col("town").alias("commune")).agg(F.min("siren").alias("l"), F.max("siren").alias("h"))
    towns = towns.select("doc", "kind", "key", F.explode(names.cities_of(F.col("commune"))).alias("city"), "l", "h")
    return all_, towns.groupBy("doc", "kind", "key", "city").agg(F.min("l").alias("low_here"), F.max("h").alias("high_here"))


def by_name(lines: DataFrame, table: DataFrame) -> DataFrame:
    """doc, line, name, key, reason, siren, carriers: steps 1 and 2, for lists of candidate names in order of `position`.

    lines: doc, line, position, name, town, needs_town, fallback, acronym. The first candidate that decides wins: a single carrier,
    or a single carrier in the line's town. Homonyms wait, those of a surer name before those of a fallback name.
    """
    wanted = lines.withColumn("key", names.key(F.col("name"))).withColumn("city", names.norm(F.col("town")))
    wanted = wanted.withColumn("kind", F.when(F.col("acronym"), "acronym").otherwise("name"))
    all_, here = _counted(table)
    met = wanted.join(all_, ["kind", "key"], "left").join(here, ["kind", "key", "city"], "left")
    counts = met.groupBy("doc", "line", "position", "name", "key", "needs_town", "fallback").agg(
        F.sum(F.coalesce("rows", F.lit(0))).alias("carriers"), F.min("low").alias("any"), F.sum(F.coalesce("rows_here", F.lit(0))).alias("here"), F.min("low_here").alias("local"),
    )
    unique = (F.col("carriers") == 1) & ~F.col("needs_town")
    local = (F.col("here") == 1) & (F.col("carriers") > 0)
    waiting = (F.col("carriers") > 0) & ~F.col("needs_town")
    state = counts.withColumn("reason", F.when(unique, "unique").when(local, "commune").when(waiting, "homonymes"))
    state = state.withColumn("siren", F.when(unique, F.col("any")).when(local, F.col("local")))
    order = W.partitionBy("doc", "line").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    surely_waiting = F.coalesce(F.max(((F.col("reason") == "homonymes") & ~F.col("fallback")).cast("int")).over(order), F.lit(0)) == 1
    state = state.withColumn("skipped", F.col("fallback") & surely_waiting)
    rank = F.when(F.col("skipped") | F.col("reason").isNull(), 3).when(F.col("reason") == "homonymes", 2).otherwise(1)
    best = state.withColumn("rank", rank).groupBy("doc", "line").agg(F.min(F.struct("rank", "position", "name", "key", "reason", "siren", "carriers")).alias("b"))
    none = F.col("b.rank") == 3
    return best.select("doc", "line", F.when(~none, F.col("b.name")).alias("name"), F.when(~none, F.col("b.key")).alias("key"), F.when(none, "introuvable").otherwise(F.col("b.reason")).alias("reason"), F.when(~none, F.col("b.siren")).alias("siren"), F.when(none, F.lit(0)).otherwise(F.col("b.carriers")).cast("long").alias("carriers"))


def conflicts(found: DataFrame) -> DataFrame:
    """A company found for lines of different name keys is found for none of them."""
    several = found.where("siren is not null").groupBy("doc", "siren").agg(F.count_distinct("key").alias("keys")).where("keys > 1").select("doc", "siren", F.lit(True).alias("clash"))
    met = found.join(several, ["doc", "siren"], "left")
    return met.select("doc", "line", "name", "key", F.when(F.col("clash"), "conflit").otherwise(F.col("reason")).alias("reason"), F.when(F.col("clash").isNull(), F.col("siren")).alias("siren"), "carriers")


def group_of(links: DataFrame, found: DataFrame, lines: DataFrame) -> DataFrame:
    """doc, siren: what open links reach from a document's head and its controlled companies found so far."""
    held = found.where("siren is not null").join(lines.where(controlled()).select("doc", "line").distinct(), ["doc", "line"], "left_semi")
    seeds = held.select(F.col("doc").alias("start"), F.col("siren").alias("node")).unionByName(lines.select(F.col("doc").alias("start"), F.col("doc").alias("node")).distinct())
    edges = open_links(links).where(F.col("role").isin(DESCENT_ROLES)).select("parent", "child").distinct()
    return closure(edges, seeds).select(F.col("start").alias("doc"), F.col("node").alias("siren"))


def by_register(lines: DataFrame, found: DataFrame, table: DataFrame, links: DataFrame) -> DataFrame:
    """Step 3: of homonyms, the only one (in the line's town where any is there) that the register ties to the group."""
    inside = group_of(links, found, lines)
    waiting = found.where("reason = 'homonymes'").select("doc", "line", "key", "name")
    city = lines.select("doc", "line", "name", names.norm(F.col("town")).alias("city"), F.when(F.col("acronym"), "acronym").otherwise("name").alias("kind"))
    met = waiting.join(city, ["doc", "line", "name"])
    # what a line needs of the carriers inside, of all and of those in its town: the smallest and the largest, which are one if there is one
    tied_all, tied_here = _tied(inside.join(table.select("kind", "key", "siren", "town"), "siren"))
    some = met.join(_counted(table)[1].select("kind", "key", "city", "rows_here"), ["kind", "key", "city"], "left").groupBy("doc", "line").agg(F.max(F.coalesce("rows_here", F.lit(0))).alias("some"))
    met = met.join(some, ["doc", "line"]).join(tied_all, ["doc", "kind", "key"], "left").join(tied_here, ["doc", "kind", "key", "city"], "left")
    low, high = (F.when(F.col("some") == 0, F.col(c)).otherwise(F.col(f"{c}_here")) for c in ("low", "high"))
    one = met.groupBy("doc", "line").agg(F.min(low).alias("chosen"), F.max(high).alias("last")).where("chosen = last").select("doc", "line", "chosen")
    out = found.join(one, ["doc", "line"], "left")
    chosen = F.col("chosen").isNotNull()
    return conflicts(out.select("doc", "line", "name", "key", F.when(chosen, "registre").otherwise(F.col("reason")).alias("reason"), F.coalesce("chosen", "siren").alias("siren"), "carriers"))


def last_resort(lines: DataFrame, found: DataFrame, table: DataFrame, links: DataFrame, units: DataFrame) -> DataFrame:
    """Step 6 for lines not found: closed companies, compact keys, usual names, then a name that begins a group company's name."""
    inside = group_of(links, found, lines)
    todo = found.where("reason = 'introuvable'").select("doc", "line")
    first = lines.join(todo, ["doc", "line"], "left_semi").groupBy("doc", "line").agg(F.min_by("name", "position").alias("name"))
    funds = first.where(F.col("name").rlike(names.FUNDS)).select("doc", "line")
    todo = todo.join(funds, ["doc", "line"], "left_anti")
    sure = lines.where("not needs_town and not fallback and not acronym").join(todo, ["doc", "line"], "left_semi")
    sure = sure.select("doc", "line", "position", "name", names.key(F.col("name")).alias("key"), names.norm(F.col("town")).alias("city")).where("key <> ''")
    shut = sure.join(table.where("kind = 'closed'").select("key"), "key", "left_semi").select("doc", "line").distinct()
    left = sure.join(shut, ["doc", "line"], "left_anti")
    packed = left.withColumn("look", names.compact(F.col("key"))).where(F.length("look") >= COMPACT_LEAST).withColumn("kind", F.lit("compact"))
    asked = packed.unionByName(left.withColumn("look", F.col("key")).withColumn("kind", F.lit("usual")))
    own = table.where(F.col("kind").isin("compact", "usual"))
    distinct = own.groupBy("kind", "key").agg(F.count_distinct("siren").alias("n"))
    all_, here = _counted(own)
    tied = _tied(inside.join(own.select("kind", "key", "siren", "town"), "siren"))[0].select("doc", "kind", F.col("key").alias("look"), F.col("low").alias("low_in"), F.col("high").alias("high_in"))
    met = asked.join(all_.join(distinct, ["kind", "key"]).withColumnRenamed("key", "look"), ["kind", "look"]).join(here.withColumnRenamed("key", "look"), ["kind", "look", "city"], "left").join(tied, ["doc", "kind", "look"], "left")
    one = met.groupBy("doc", "line", "kind", "look", "position", "name", "key").agg(
        F.max("n").alias("n"), F.min("low").alias("any"), F.min("low_in").alias("in_"), F.max("high_in").alias("last_in"), F.min("low_here").alias("here"), F.max("high_here").alias("last_here"),
    )
    code = (F.col("kind") == "compact") & ((F.length("look") >= CODE_LEAST) | F.col("look").rlike("[0-9]"))
    chosen = F.when(F.col("in_") == F.col("last_in"), F.col("in_")).when(F.col("here") == F.col("last_here"), F.col("here")).when(code & (F.col("n") == 1), F.col("any"))
    one = one.withColumn("chosen", chosen).where("chosen is not null")
    step = F.when(F.col("kind") == "compact", 1).otherwise(2)
    picks = one.select("doc", "line", F.struct(step.alias("step"), "position", "name", "key", F.col("chosen").alias("siren"), F.col("n").cast("long").alias("carriers")).alias("p"))
    begins = units.where("state = 'A' and closed is null and denomination is not null").select("siren", names.key(F.col("denomination")).alias("full"))
    begins = inside.where("doc <> siren").join(begins, "siren").withColumn("words", F.split("full", " ")).where(F.size("words") > START_WORDS)
    begins = begins.withColumn("key", F.explode(F.transform(F.sequence(F.lit(START_WORDS), F.size("words") - 1), lambda k: F.array_join(F.slice("words", 1, k), " "))))
    begins = begins.groupBy("doc", "key").agg(F.min("siren").alias("siren"), F.max("siren").alias("last")).where("siren = last")
    started = left.select("doc", "line", "position", "name", "key").distinct().join(begins.select("doc", "key", "siren"), ["doc", "key"])
    picks = picks.unionByName(started.select("doc", "line", F.struct(F.lit(3).alias("step"), "position", "name", "key", "siren", F.lit(1).cast("long").alias("carriers")).alias("p")))
    best = picks.groupBy("doc", "line").agg(F.min("p").alias("p"))
    before = found.where("siren is not null").select("doc", F.col("siren").alias("taken")).distinct()
    best = best.join(before, (best["doc"] == before["doc"]) & (best["p.siren"] == before["taken"]), "left_anti")
    reasons = F.create_map(F.lit(1), F.lit("compacte"), F.lit(2), F.lit("usuelle"), F.lit(3), F.lit("debut"))
    fresh = conflicts(best.select("doc", "line", "p.name", "p.key", reasons[F.col("p.step")].alias("reason"), "p.siren", "p.carriers"))
    none = F.lit(None).cast("string")
    for rows, reason in ((shut, "fermee"), (funds, "fonds")):
        fresh = fresh.unionByName(rows.select("doc", "line", none.alias("name"), none.alias("key"), F.lit(reason).alias("reason"), none.alias("siren"), F.lit(0).cast("long").alias("carriers")))
    return found.join(fresh.select("doc", "line"), ["doc", "line"], "left_anti").unionByName(fresh)


def brand_hits(named: DataFrame, brands: DataFrame) -> DataFrame:
    """siren, brand, kind: names that begin with a brand, after any number of prefix words; the longest brand wins, then the first.

    named: siren, name (normalised). brands: brand (normalised), kind, seq. Beginnings of names are generated up to the longest brand's
    number of words, so the match is an equal join.
    """
    words = named.withColumn("words", F.split("name", " "))
    skipped = "^(?:(?:" + "|".join(names.PREFIXES) + ") )*$"
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda k: (k == 0) | F.concat(F.array_join(F.slice("words", 1, k), " "), F.lit(" ")).rlike(skipped))
    words = words.withColumn("skip", F.explode(starts))
    most = brands.agg(F.max(F.size(F.split("brand", " ")))).first()[0] or 1
    lengths = F.sequence(F.lit(1), F.least(F.size("words") - F.col("skip"), F.lit(most)))
    begun = words.withColumn("k", F.explode(lengths))
    begun = begun.select("siren", F.array_join(F.slice("words", F.col("skip") + 1, F.col("k")), " ").alias("brand")).distinct()
    met = begun.join(brands, "brand")
    best = met.groupBy("siren").agg(F.min(F.struct((-F.length("brand")).alias("len"), "seq", "brand", "kind")).alias("b"))
    return best.select("siren", F.col("b.brand").alias("brand"), F.col("b.kind").alias("kind"))
