"""Serving: ranked search, export tables, validation, and levels for a customer system."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groupforge.functions import names
from groupforge.operators.closure import closure
from groupforge.operators.rules import LABELS, label
from groupforge.operators.tree import open_links, roots
from groupforge.plans.storage import cut

LIMIT = 20
LEAST, MOST, SUBSIDIARIES = 2, 100, 150


def prepared(text: str) -> str:
    """What was typed into the search, as it is looked for: upper case, no accents, single spaces; a company number without its spaces."""
    found = " ".join("".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x)).upper().split())
    number = found.replace(" ", "")
    if len(number) == 9 and number.isascii() and number.isdigit():
        return number
    if not LEAST <= len(found) <= MOST:
        raise ValueError(f"a search has {LEAST} to {MOST} characters")
    return found


def name_rank(name: Column, asked: str, family: int) -> Column:
    """family if equal, family + 1 if it begins so, 30 + family / 10 if it holds it, else null."""
    n = F.upper(names.plain(name))
    return F.when(n == asked, family).when(n.startswith(asked), family + 1).when(n.contains(asked), 30 + family // 10)


def search(companies: DataFrame, units: DataFrame, offices: DataFrame, asked: str, limit: int = LIMIT) -> DataFrame:
    """siren, name, acronym, town, status, rank: names before acronyms before parts of names; active first, then the largest.

    A company number finds that company, at rank 0.
    """
    asked = prepared(asked)
    by_name = companies.select("siren", name_rank(F.col("denomination"), asked, 10).alias("rank"))
    legal = units.where(F.col("cj").isNull() | ~F.col("cj").between(1000, 1999))
    by_unit = legal.select("siren", F.least(name_rank(F.col("denomination"), asked, 10), name_rank(F.col("acronym"), asked, 20)).alias("rank"))
    if asked.isdigit() and len(asked) == 9:
        own = F.when(F.col("siren") == asked, 0).alias("rank")
        by_name, by_unit = companies.select("siren", own), legal.select("siren", own)
    best = by_name.unionByName(by_unit).where("rank is not null").groupBy("siren").agg(F.min("rank").alias("rank"))
    met = best.join(companies.select("siren", "denomination", "closed", "state"), "siren", "left")
    met = met.join(units.select("siren", F.col("denomination").alias("u_name"), "acronym", F.col("cj").alias("u_cj"), F.col("band").alias("u_band"), F.col("state").alias("u_state"), F.col("closed").alias("u_closed")), "siren", "left")
    met = met.join(offices.select("siren", "name", F.col("cj").alias("o_cj"), F.col("band").alias("o_band"), "town"), "siren", "left")
    name, cj, closed = F.coalesce("denomination", "u_name", "name"), F.coalesce("u_cj", "o_cj"), F.coalesce("closed", "u_closed")
    state = F.coalesce("state", "u_state")
    met = met.withColumn("shown", name).where(name.isNotNull() & (cj.isNull() | ~cj.between(1000, 1999)))
    active = closed.isNull() & (F.coalesce(state, F.lit("A")) != "C")
    size = F.coalesce("u_band", "o_band").try_cast("int")
    top = met.orderBy(F.floor(F.col("rank") / 10), F.desc(active), F.desc_nulls_last(size), "rank", "shown", "siren").limit(limit)
    status = F.when(closed.isNotNull(), "radiee").when(state == "C", "cessee").otherwise("active")
    return top.select("siren", F.col("shown").alias("name"), "acronym", "town", status.alias("status"), F.col("rank").cast("long").alias("rank"))


def export_companies(group: DataFrame, offices: DataFrame) -> DataFrame:
    """The company table of an export: cells safe for spreadsheets, identifiers grouped."""
    met = group.join(offices.select("siren", "siret", "name", "town", "naf"), "siren", "left")
    return met.select("siren", names.grouped_siren(F.col("siren")).alias("shown_siren"), "siret", names.safe_cell(F.col("name")).alias("name"), names.unmasked(F.col("town")).alias("town"), "naf", "head", "level")


def export_links(group: DataFrame, links: DataFrame) -> DataFrame:
    """parent, child, role, proof of open links inside a group, in words."""
    inside = cut(group.select("siren", "head"))
    met = open_links(links).where(F.col("role").isin(list(LABELS))).select("parent", "child", "role").distinct()
    met = met.join(inside.withColumnRenamed("siren", "parent"), "parent").join(inside.select(F.col("siren").alias("child"), F.col("head").alias("child_head")), "child").where("head = child_head")
    return met.select("parent", "child", label(F.col("role")).alias("role"), F.concat(F.lit("Mandat au registre : "), label(F.col("role"))).alias("proof"))


def export_coverage(group: DataFrame, links: DataFrame, offices: DataFrame) -> DataFrame:
    """metric, value: counts of a map, one row each."""
    met = group.join(offices.select("siren", F.lit(True).alias("office")), "siren", "left")
    counts = met.agg(
        F.count("*").alias("companies"), F.count_if(F.col("level") == 0).alias("heads"), F.count_if("targetable").alias("targetable"),
        F.count_if(F.col("mother").isNull() & (F.col("level") > 0)).alias("orphans"), F.count_if(F.col("office").isNull()).alias("without_office"), F.max("level").alias("deepest"),
    )
    names_ = ["companies", "heads", "targetable", "orphans", "without_office", "deepest"]
    return counts.unpivot([], [F.col(n).cast("long").alias(n) for n in names_], "metric", "value")


def validate(companies: DataFrame, relations: DataFrame) -> DataFrame:
    """problem, n: duplicate ids, links to unknown companies, links to oneself, links without a proof."""
    ids = companies.select("siren").distinct()
    twice = companies.groupBy("siren").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate id").alias("problem"), "n")
    ends = relations.select(F.col("parent").alias("siren")).unionByName(relations.select(F.col("child").alias("siren")))
    orphan = ends.join(ids, "siren", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown company").alias("problem"), "n")
    own = relations.where("parent = child").agg(F.count("*").alias("n")).select(F.lit("link to itself").alias("problem"), "n")
    bare = relations.where("proof is null or proof = ''").agg(F.count("*").alias("n")).select(F.lit("no proof").alias("problem"), "n")
    return twice.unionByName(orphan).unionByName(own).unionByName(bare)


def primary_parents(holdings: DataFrame) -> DataFrame:
    """child, parent, basis: a strict majority by control share, else by ownership share; each counts only if known for all parents."""
    met = holdings.groupBy("child").agg(
        F.count("*").alias("n"), F.count("control").alias("n_control"), F.count("owned").alias("n_owned"),
        F.max_by("parent", F.struct("control", "parent")).alias("by_control"), F.max("control").alias("control"), F.max_by("parent", F.struct("owned", "parent")).alias("by_owned"), F.max("owned").alias("owned"),
    )
    control, owned = (F.col("n_control") == F.col("n")) & (F.col("control") > 50), (F.col("n_owned") == F.col("n")) & (F.col("owned") > 50)
    return met.select("child", F.when(control, F.col("by_control")).when(owned, F.col("by_owned")).alias("parent"), F.when(control, "control").when(owned, "ownership").alias("basis"))


def import_levels(edges: DataFrame) -> DataFrame:
    """node, level: 1 + the largest level of a parent, 0 without parents. Nodes below or in a loop of holdings have level null."""
    edges = cut(edges.select("parent", "child").distinct())
    nodes = edges.select(F.col("parent").alias("node")).unionByName(edges.select(F.col("child").alias("node"))).distinct()
    left, done, level = cut(nodes), None, 0
    while True:
        blocked = edges.join(left.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        ready = cut(left.join(blocked, "node", "left_anti").withColumn("level", F.lit(level).cast("long")))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = cut(left.join(ready.select("node"), "node", "left_anti"))
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("long"))
    return rest if done is None else done.unionByName(rest)


def outline(group: DataFrame) -> DataFrame:
    """siren, head, place, below: companies in the order of an outline (a company, then what is below it, by id), with the number below.

    group: siren, head, mother. A company whose mother is not in its group hangs below the head, and so does the smallest company of a
    loop of mothers, with the others of the loop below it.
    """
    inside = group.select(F.col("siren").alias("mother"), F.col("head").alias("mother_head"))
    rows = group.select("siren", "head", "mother").join(inside, "mother", "left")
    up = F.when(F.col("siren") == F.col("head"), F.lit(None)).when(F.col("mother_head") == F.col("head"), F.col("mother")).otherwise(F.col("head"))
    rows = cut(rows.select("siren", "head", up.alias("mother")))
    loops = roots(rows.where("mother is not null").select(F.col("siren").alias("child"), "mother")).where("loop and depth = 0").select(F.col("child").alias("siren"), F.lit(True).alias("opens"))
    rows = cut(rows.join(loops, "siren", "left").select("siren", "head", F.when(F.col("opens"), F.col("head")).otherwise(F.col("mother")).alias("mother")))
    # node, the place it points at, and the path from below that place down to it: pointers double, so the rounds grow with the logarithm of the depth
    state = cut(rows.select(F.col("siren").alias("node"), "head", F.col("mother").alias("at"), F.col("siren").alias("path")))
    while not state.where("at is not null").isEmpty():
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("path").alias("before"))
        moved = state.where("at is not null").join(ahead, "at").select("node", "head", F.col("next").alias("at"), F.concat("before", F.lit("/"), "path").alias("path"))
        state = cut(moved.unionByName(state.where("at is null")))
    done = state.select(F.col("node").alias("siren"), "head", "path")
    above = done.select("head", F.explode(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)).alias("siren"))
    below = above.groupBy("head", "siren").agg(F.count("*").alias("below"))
    place = F.row_number().over(W.partitionBy("head").orderBy("path"))
    return done.withColumn("place", place.cast("long")).join(below, ["head", "siren"], "left").select("siren", "head", "place", F.coalesce("below", F.lit(0)).alias("below"))


def lifted_parents(edges: DataFrame, imported: DataFrame) -> DataFrame:
    """child, parent, share, skipped: of each imported company the nearest imported companies above it, with the share of the first step and the
    companies that were skipped on the way. edges: parent, child, share (of an edge that is given twice, the larger).

    Of several ways between two companies the shortest counts, then the one whose skipped companies come first. A frontier loop in which
    each place above a company is reached once: its work is the places, not the ways, which may double with each level.
    """
    up = cut(edges.groupBy(F.col("child").alias("at"), F.col("parent").alias("next")).agg(F.max("share").alias("share")).repartition("at"))
    keep = imported.select(F.col("siren").alias("at")).distinct().withColumn("kept", F.lit(True))
    front = keep.select(F.col("at").alias("child"), "at", F.lit(None).cast("double").alias("first"), F.array().cast("array<string>").alias("skipped"), F.lit(0).alias("level"))
    seen, found, level = cut(front.select("child", "at")), None, 0
    while True:
        step = front.join(up, "at").select("child", F.col("next").alias("at"), F.when(F.col("level") > 0, F.col("first")).otherwise(F.col("share")).alias("first"), F.when(F.col("level") > 0, F.concat("skipped", F.array("at"))).otherwise(F.col("skipped")).alias("skipped"))
        best = step.groupBy("child", "at").agg(F.min(F.struct("skipped", "first")).alias("b")).join(seen, ["child", "at"], "left_anti").join(keep, "at", "left")
        reached = cut(best.select("child", "at", "b.first", "b.skipped", "kept"))
        hits = reached.where("kept").select("child", F.col("at").alias("parent"), F.col("first").alias("share"), F.array_join("skipped", ">").alias("skipped"))
        found = hits if found is None else found.unionByName(hits)
        level += 1
        front = reached.where("kept is null").select("child", "at", "first", "skipped", F.lit(level).alias("level"))
        if front.isEmpty():
            return found
        seen = seen.unionByName(reached.select("child", "at"))
        if level % 8 == 0:
            seen = cut(seen)


def lifted_ways(edges: DataFrame, imported: DataFrame) -> DataFrame:
    """child, parent, share, skipped: every way from an imported company to the nearest imported ones above it, where lifted_parents gives one for each
    pair. A way never comes back to a company. edges: parent, child, share; edges alike count once, those with other shares are other ways.

    Only steps to companies from which an imported one can be reached are taken, so the work follows the ways that are given.
    """
    keep = cut(imported.select(F.col("siren").alias("at")).distinct().withColumn("kept", F.lit(True)))
    known = edges.where("parent <> child").select(F.col("child").alias("at"), F.col("parent").alias("next"), "share").distinct().join(keep, "at", "left")
    known = cut(known.repartition("at"))
    between = known.where("kept is null").select(F.col("next").alias("parent"), F.col("at").alias("child")).distinct()
    leading = closure(between, keep.select(F.lit("").alias("start"), F.col("at").alias("node"))).select(F.col("node").alias("next"))
    first = known.join(leading, "next", "left_semi")
    up = cut(first.where("kept is null").select("at", "next").distinct())
    step = first.where("kept").select(F.col("at").alias("child"), F.col("next").alias("at"), F.col("share").alias("first"), F.array().cast("array<string>").alias("skipped"))
    found = None
    while True:
        step = cut(step.join(keep, "at", "left"))
        hits = step.where("kept").select("child", F.col("at").alias("parent"), F.col("first").alias("share"), F.array_join("skipped", ">").alias("skipped"))
        found = hits if found is None else found.unionByName(hits)
        front = step.where("kept is null").select("child", "at", "first", F.concat("skipped", F.array("at")).alias("skipped"))
        if front.isEmpty():
            return found
        step = front.join(up, "at").where((F.col("next") != F.col("child")) & ~F.array_contains("skipped", F.col("next"))).select("child", F.col("next").alias("at"), "first", "skipped")


def compare(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """metric, value: companies found, extra and missed against a reference list, and how many have the same mother. Both: siren, mother."""
    a, b = ours.select("siren", F.col("mother").alias("ours"), F.lit(True).alias("a")), theirs.select("siren", F.col("mother").alias("theirs"), F.lit(True).alias("b"))
    met = a.join(b, "siren", "full_outer")
    both = F.col("a") & F.col("b")
    out = met.agg(F.count_if(both).alias("found"), F.count_if(F.col("b").isNull()).alias("extra"), F.count_if(F.col("a").isNull()).alias("missed"), F.count_if(both & F.col("ours").eqNullSafe(F.col("theirs"))).alias("same_mother"))
    return out.unpivot([], [F.col(c).cast("long").alias(c) for c in out.columns], "metric", "value")


def record_key(siret: Column, siren: Column, own: Column) -> Column:
    """The first valid of office id, company id and own id."""
    return F.coalesce(F.when(siret.rlike("^[0-9]{14}$"), siret), F.when(siren.rlike("^[0-9]{9}$"), siren), own)


def groups_of(hits: DataFrame, assigned: DataFrame, offices: DataFrame) -> DataFrame:
    """siren, head, head_name, size of each search hit; nulls where no group holds it. assigned: siren, head."""
    wanted = assigned.join(hits.select("siren"), "siren", "left_semi")
    sizes = assigned.groupBy("head").agg(F.count("*").alias("size")).join(wanted.select("head").distinct(), "head", "left_semi")
    names_ = offices.select(F.col("siren").alias("head"), F.col("name").alias("head_name"))
    return hits.select("siren").join(wanted.select("siren", "head"), "siren", "left").join(sizes, "head", "left").join(names_, "head", "left").select("siren", "head", "head_name", "size")


def largest_subsidiaries(group: DataFrame, offices: DataFrame, limit: int = SUBSIDIARIES) -> DataFrame:
    """siren, head, band: the largest companies below heads, by band of staff, then by id."""
    size = F.col("band").try_cast("int")
    met = group.where("siren <> head").select("siren", "head").join(offices.select("siren", "band"), "siren")
    return met.orderBy(F.desc_nulls_last(size), "siren").limit(limit)


def map_order(group: DataFrame, offices: DataFrame) -> DataFrame:
    """siren, head, place: a group's companies by level, those without a name last, then by name and id."""
    met = group.select("siren", "head", "level").join(offices.select("siren", "name"), "siren", "left")
    return met.select("siren", "head", F.row_number().over(W.partitionBy("head").orderBy("level", F.col("name").isNull(), "name", "siren")).cast("long").alias("place"))


def most_common(words: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """The most common values and their number; of equals the smaller value."""
    return words.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit)


def same_judgement(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """found, same: companies in both lists, and how many of them both call targetable or both don't. Both: siren, targetable."""
    met = ours.select("siren", F.col("targetable").alias("a")).join(theirs.select("siren", F.col("targetable").alias("b")), "siren")
    return met.agg(F.count("*").alias("found"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


#: What a confidence means in an export.
LINK_STATES = {"A": ("confirmed", "high", "yes"), "B": ("confirmed", "medium", "no"), "C": ("to_verify", "low", "no")}


def entity_type(siren: Column, head: Column, reason: Column) -> Column:
    """The kind of company in an export, from why it can or can't be targeted."""
    said = F.coalesce(reason, F.lit(""))
    return F.when(siren == head, "holding_operating_group").when(said.contains("civile"), "sci").when(said.contains("GIE"), "shared_service").when(said.contains("Holding"), "holding").otherwise("operating_company")


def relation_rows(rows: DataFrame) -> DataFrame:
    """parent_id, child_id, status, confidence, verified: one row for each mother; rows: siren, head, mother, confidence."""
    said = F.create_map(*[x for k, v in LINK_STATES.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])[F.col("confidence")]
    of = F.coalesce(said, F.array(*[F.lit(y) for y in LINK_STATES["C"]]))
    return rows.where("mother is not null and siren <> head").select(F.col("mother").alias("parent_id"), F.col("siren").alias("child_id"), *[F.get(of, F.lit(i)).alias(n) for i, n in enumerate(("status", "confidence", "verified"))])


def brand_entities(houses: list[str], heads: DataFrame) -> DataFrame:
    """brand_id, brand, entity: of the companies that head a house (siren, name) the smallest whose name holds the brand's; null if none does."""
    def plain(c: Column) -> Column:
        return F.translate(F.upper(c), "'", " ")

    brands = heads.sparkSession.createDataFrame([(f"B{i}", h) for i, h in enumerate(houses, 1)], "brand_id string, brand string")
    wanted = F.array(*[F.lit(h) for h in houses])
    met = heads.select("siren", F.explode(F.filter(wanted, lambda h: F.contains(plain(F.col("name")), plain(h)))).alias("brand"))
    return brands.join(met.groupBy("brand").agg(F.min("siren").alias("entity")), "brand", "left").select("brand_id", "brand", "entity")
