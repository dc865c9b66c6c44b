"""Maps: one group from its head to its tables, and what a reader of the country's map sees of one company."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupforge.functions import names
from groupforge.operators import closure, growth, rules, tree
from groupforge.operators.assign import levels_within
from groupforge.operators.rules import LABELS, MEDIUM, STRONG, WEAK, Settings, label
from groupforge.plans.storage import cut, settled, shuffled

LOOP_CUT, BELOW_HEAD = "Déduit : boucle de mandats coupée", "Déduit : rattachée à la tête du groupe"


class GroupMap:
    """companies, links, participations (not controlled, but with a mandate), foreign, cases: the tables of one group. Each is worked out when it
    is first asked for, where no join broadcasts a table that grows with the register, and written."""

    def __init__(self, spark: SparkSession, **made: Callable[[], DataFrame]):
        self._spark, self._made = spark, made

    def _settled(self, name: str) -> DataFrame:
        return settled(self._spark, self._made[name])

    companies = cached_property(lambda self: self._settled("companies"))
    links = cached_property(lambda self: self._settled("links"))
    participations = cached_property(lambda self: self._settled("participations"))
    foreign = cached_property(lambda self: self._settled("foreign"))
    cases = cached_property(lambda self: self._settled("cases"))


def house_heads(kept: DataFrame, brands: DataFrame, offices: DataFrame, companies: DataFrame) -> DataFrame:
    """brand, house_head: of a brand's retained companies the one with most staff, then the highest band, then the first that entered."""
    met = brands.select("siren", "brand").distinct().join(kept.select("siren", "round"), "siren").join(companies.select("siren", "staff"), "siren", "left").join(offices.select("siren", "band"), "siren", "left")
    first = F.struct(F.coalesce("staff", F.lit(0)).alias("staff"), F.coalesce("band", F.lit("")).alias("band"), (-F.col("round")).alias("round"))
    best = met.groupBy("brand").agg(F.max(first).alias("best"))
    return met.withColumn("own", first).join(best, "brand").where("own = best").groupBy("brand").agg(F.min("siren").alias("house_head"))


def mothers(links: DataFrame, kept: DataFrame, wide: DataFrame, brands: DataFrame, heads: DataFrame, head: str, priority: tuple[str, ...] = ()) -> DataFrame:
    """siren, mother, proof, confidence: the strongest mandate inside the group; else the head of its brand's house; else the group's head.

    kept: siren, reason, round. wide: evidence() of the retained companies. Of mandates alike the head's comes first, then the priority's in
    their order. A loop of mothers opens where the company that entered first meets it.
    """
    order = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in (head, *priority)]), F.col("parent")), F.lit(0))
    place = F.when(order > 0, order).otherwise(len(priority) + 2)
    rank = F.when(F.col("role").isin(list(STRONG)), 0).when(F.col("role").isin(list(WEAK)), 1).otherwise(2)
    inside = tree.open_links(links).join(kept.select(F.col("siren").alias("parent")), "parent", "left_semi").join(kept.select(F.col("siren").alias("child")), "child", "left_semi")
    best = inside.groupBy(F.col("child").alias("siren")).agg(F.min(F.struct(rank.alias("rank"), place.alias("place"), "parent", "role")).alias("m"))
    house = brands.select("siren", "brand").join(heads, "brand").where("siren <> house_head").groupBy("siren").agg(F.min_by(F.struct("brand", "house_head"), F.struct(-F.length("brand"), "brand")).alias("h"))
    met = kept.where(F.col("siren") != head).select("siren", "reason", "round").join(best, "siren", "left").join(house, "siren", "left")
    met = met.join(wide.select("siren", "brand", "at_group", "charted", "controlled"), "siren", "left").fillna(False, ["brand", "at_group", "charted", "controlled"])
    kinds = sum((F.col(k).cast("int") for k in ("brand", "at_group", "charted", "controlled")), F.lit(0)) + F.col("reason").endswith("indice").cast("int")
    sure = F.when((kinds >= 2) | F.col("controlled") | F.col("reason").contains("second indice"), "B").otherwise("C")
    linked, housed = F.col("m").isNotNull(), F.col("h").isNotNull()
    chosen = cut(met.select(
        "siren", "round", F.when(linked, F.col("m.parent")).when(housed, F.col("h.house_head")).otherwise(F.lit(head)).alias("mother"),
        F.when(linked, F.concat(F.lit("Mandat au registre : "), F.coalesce(label(F.col("m.role")), F.col("m.role")))).when(housed, F.concat(F.lit("Déduit : même maison ("), F.col("h.brand"), F.lit(")"))).otherwise(BELOW_HEAD).alias("proof"),
        F.when(linked, "A").otherwise(sure).alias("confidence"),
    ))
    opens = first_met(chosen.select("siren", "mother", "round")).withColumn("opens", F.lit(True))
    chosen = chosen.join(opens, "siren", "left")
    return chosen.select("siren", *[F.when(F.col("opens"), new).otherwise(F.col(c)).alias(c) for c, new in (("mother", F.lit(head)), ("proof", F.lit(LOOP_CUT)), ("confidence", F.lit("C")))])


def first_met(chosen: DataFrame) -> DataFrame:
    """siren of the one company of each loop of mothers that the first one (by round, then id) on a way into the loop meets.

    chosen: siren, mother, round. One way a loop is walked, so the walks are few and end in the loop.
    """
    up = cut(chosen.select(F.col("siren").alias("child"), "mother"))
    loops = cut(tree.roots(up).where("loop"))
    if loops.isEmpty():
        return loops.select(F.col("child").alias("siren"))
    member = cut(tree.loop_members(up).withColumn("member", F.lit(True)))
    starts = loops.join(chosen.select(F.col("siren").alias("child"), "round"), "child").groupBy("root").agg(F.min_by("child", F.struct("round", "child")).alias("at"))
    front, done = starts.select("at"), None
    while True:
        met = cut(front.join(member.withColumnRenamed("node", "at"), "at", "left"))
        hits = met.where("member").select(F.col("at").alias("siren"))
        done = hits if done is None else done.unionByName(hits)
        front = met.where("member is null").join(up.withColumnRenamed("child", "at"), "at").select(F.col("mother").alias("at"))
        if front.isEmpty():
            return done


def group_map(offices: DataFrame, companies: DataFrame, links: DataFrame, persons: DataFrame, head: str, brands: DataFrame, listed: DataFrame, decisions: DataFrame | None = None, settings: Settings = rules.PLAIN, in_turn: bool = False) -> GroupMap:
    """One group from its head to its tables: growth by the rules, mothers, levels, accounts, mandates, cases.

    companies: siren, reason, round, mother, proof, confidence, level, targetable, account (the nearest company above, or itself, that can
    be targeted). in_turn: candidates of a round see those that entered before them.
    """
    spark = offices.sparkSession
    if in_turn:
        kept = growth.expand_in_turn(offices, companies, links, persons, head, brands, listed, decisions, settings=settings)
        refused = None if decisions is None else decisions.where("decision = 'ecarter'")
        seats = rules.without_families(persons, settings.families)
        with shuffled(spark):
            wide = cut(rules.evidence(offices, companies, links, seats, kept, brands, listed, settings, rules.charted(offices, settings), refused))
    else:
        found = rules.grown(offices, companies, links, persons, head, brands, listed, decisions, settings=settings)
        kept, wide = found.kept, found.wide

    @cache
    def chosen() -> DataFrame:
        own = wide.join(kept.select("siren"), "siren", "left_semi")
        return cut(mothers(links, kept, own, brands, house_heads(kept, brands, offices, companies), head, settings.priority))

    def rows() -> DataFrame:
        level = tree.roots(chosen().select(F.col("siren").alias("child"), "mother")).select(F.col("child").alias("siren"), F.col("depth").alias("level"))
        target = cut(rules.targetable(offices, companies).join(kept.select("siren"), "siren", "left_semi"))
        up = cut(kept.select("siren").join(chosen(), "siren", "left").select(F.col("siren").alias("node"), F.col("mother").alias("parent")))
        account = closure.nearest(up, target.where("targetable").select(F.col("siren").alias("node"))).select(F.col("node").alias("siren"), F.col("found").alias("account"))
        met = kept.join(chosen(), "siren", "left").join(level, "siren", "left").join(target.select("siren", "targetable"), "siren", "left").join(account, "siren", "left")
        return met.select(
            "siren", "reason", F.col("round").cast("long").alias("round"), "mother", F.coalesce("proof", F.lit("Tête du groupe")).alias("proof"), F.coalesce("confidence", F.lit("A")).alias("confidence"),
            F.coalesce("level", F.lit(0)).cast("long").alias("level"), F.coalesce("targetable", F.lit(False)).alias("targetable"), "account",
        )

    from_kept = tree.open_links(links).join(kept.select(F.col("siren").alias("parent")), "parent", "left_semi").select("parent", "child", "role").distinct()
    apart = wide.join(kept.select("siren"), "siren", "left_anti").select("siren", "controlled", "cj", "sure", "barred")

    def inside() -> DataFrame:
        held = from_kept.join(kept.select(F.col("siren").alias("child")), "child", "left_semi").where(F.col("role").isin(list(LABELS)))
        return held.select("parent", "child", label(F.col("role")).alias("role"), F.concat(F.lit("Mandat au registre : "), label(F.col("role"))).alias("proof"))

    def shares() -> DataFrame:
        stated = F.coalesce(~F.col("controlled"), F.lit(False))
        held = apart.join(from_kept.select(F.col("child").alias("siren"), "parent", "role"), "siren", "left").groupBy("siren", stated.alias("stated")).agg(
            F.sort_array(F.collect_list(F.when(F.col("role").isin(list(MEDIUM)) | (F.col("role").isin(list(STRONG)) & stated), F.concat("parent", F.lit(" "), label(F.col("role")))))).alias("mandates"),
            F.count_if(F.col("role").isin(list(MEDIUM))).alias("medium"),
        )
        return held.where("medium > 0 or stated").select("siren", F.array_join("mandates", "; ").alias("mandates"))

    def foreign() -> DataFrame:
        met = apart.where(F.col("cj").cast("string").startswith("3") & ~F.col("barred") & (F.col("sure") | F.coalesce("controlled", F.lit(False)))).select("siren")
        return met.join(offices.select("siren", "name"), "siren")

    return GroupMap(spark, companies=rows, links=inside, participations=shares, foreign=foreign, cases=lambda: rules.doubtful(links, kept, chosen()))


def warnings_of(companies: DataFrame, data_day: DataFrame, today: str, most: int = 7) -> DataFrame:
    """warning: what a reader has to know: the group is its head alone, or the register's day (data_date, one row) is more than `most` days ago."""
    lonely = companies.agg(F.count("*").alias("n")).where("n <= 1").select(F.lit("Tête seule : aucune société rattachée.").alias("warning"))
    old = data_day.where(F.datediff(F.lit(today).cast("date"), F.col("data_date")) > most)
    return lonely.unionByName(old.select(F.concat(F.lit("Données du registre au "), names.shown_date(F.col("data_date")), F.lit(f" : plus de {most} jours de retard.")).alias("warning")))


# --- the country's map


def own_heads(won: DataFrame, heads: DataFrame) -> DataFrame:
    """siren, head: companies after arbitration, where the head of each document's group stays in its own."""
    mine = heads.select(F.col("head").alias("siren"), "head").distinct()
    return won.select("siren", "head").join(mine.select("siren"), "siren", "left_anti").unionByName(mine)


def claims_of(members: DataFrame, inscribed: DataFrame) -> DataFrame:
    """head, siren, manner, rate, level: what each group's map claims, by its published list or by descent.

    members: head, siren, level. inscribed: head, siren, rate; of several lines for a company the highest rate counts.
    """
    rates = inscribed.groupBy("head", "siren").agg(F.max("rate").alias("rate"), F.lit(True).alias("told"))
    met = members.select("head", "siren", "level").join(rates, ["head", "siren"], "left")
    return met.select("head", "siren", F.when(F.col("told"), "inscription").otherwise("descente").alias("manner"), "rate", F.when(F.col("told").isNull(), F.col("level")).cast("int").alias("level"))


def with_banks(members: DataFrame, banks: DataFrame) -> DataFrame:
    """members (head, siren, mother, level, proof, confidence) and the local banks (head, siren, proof) that they lack: at level 1 below the head, confidence B."""
    new = banks.select("head", "siren", "proof").join(members.select("head", "siren"), ["head", "siren"], "left_anti")
    return members.unionByName(new.select("head", "siren", F.col("head").alias("mother"), F.lit(1).cast("long").alias("level"), "proof", F.lit("B").alias("confidence")))


def document_rows(won: DataFrame, members: DataFrame, parents: DataFrame) -> DataFrame:
    """siren, head, mother, proof, confidence, level: the rows of document groups after arbitration.

    won: siren, head (heads of documents in their own group). members: head, siren, mother, proof, confidence of each group's map. parents:
    head, parent of groups. The mother is the nearest company above, in the map of the group, that stayed in it; of a group's head, in the
    map of the parent group, if that lists it. One that isn't the direct mother is a deduction, and so is the head, where none stayed.
    """
    won = cut(won.select("siren", "head"))
    top = F.col("siren") == F.col("head")
    within = won.join(parents.select("head", "parent"), "head", "left").select("siren", "head", F.when(top, F.col("parent")).otherwise(F.col("head")).alias("map"))
    shown = cut(members.select(F.col("head").alias("map"), "siren", "mother", "proof", "confidence").repartition("map", "siren"))
    placed = won.select(F.col("siren").alias("at"), F.col("head").alias("at_head"))
    rows = cut(within.join(shown, ["map", "siren"], "left"))
    front = rows.where("mother is not null").select("siren", "map", F.col("mother").alias("at"), F.array("siren").alias("way"))
    done, step = None, 0
    while True:
        met = cut(front.join(placed, "at", "left"))
        here = F.coalesce(F.col("at_head") == F.col("map"), F.lit(False))
        hits = met.where(here).select("siren", F.col("at").alias("found"), F.lit(step == 0).alias("direct"))
        done = hits if done is None else done.unionByName(hits)
        ways = met.where(~here).select("siren", "map", "at", F.concat("way", F.array("at")).alias("way"))
        front = ways.join(shown.select("map", F.col("siren").alias("at"), F.col("mother").alias("next")), ["map", "at"]).where("next is not null").where(~F.array_contains("way", F.col("next")))
        front = front.select("siren", "map", F.col("next").alias("at"), "way")
        if front.isEmpty():
            break
        step += 1
    rows = rows.join(done, "siren", "left").join(placed.select(F.col("at").alias("mother"), F.col("at_head").alias("mother_head")), "mother", "left")
    lists = F.col("proof").isNotNull()
    direct = F.coalesce("direct", F.lit(False))
    deduced = F.when(F.col("mother_head").isNotNull(), F.concat(F.lit("Déduit : maison mère directe "), F.col("mother"), F.lit(" rangée dans le groupe "), F.col("mother_head"))).otherwise(BELOW_HEAD)
    rows = cut(rows.select(
        "siren", "head", F.when(~top | lists, F.coalesce("found", "map")).alias("mother"),
        F.when(top & ~lists, "Tête du groupe").when(direct, F.col("proof")).otherwise(deduced).alias("proof"), F.when(top & ~lists, "A").when(direct, F.col("confidence")).otherwise("C").alias("confidence"),
    ))
    return rows.join(levels_within(rows).select("siren", "level"), "siren")


def groups_table(rows: DataFrame, offices: DataFrame, parents: DataFrame, documents: DataFrame) -> DataFrame:
    """head, name, size, parent, document: one row for each group. rows: siren, head. parents: head, parent. documents: head, document."""
    sizes = rows.groupBy("head").agg(F.count("*").alias("size"))
    met = sizes.join(offices.select(F.col("siren").alias("head"), "name"), "head", "left").join(parents.select("head", "parent"), "head", "left").join(documents.select("head", "document"), "head", "left")
    return met.select("head", "name", "size", "parent", "document")


def read_map(rows: DataFrame, groups: DataFrame, siren: str) -> DataFrame:
    """siren, level: a company of the country's map and all below it, in its group and the groups nested in that; no rows where no group holds it.

    rows: siren, head, mother. groups: head, parent. Of several ways down the shortest gives the level.
    """
    at = rows.where(F.col("siren") == siren).select("head")
    nested = groups.where("parent is not null").select("parent", F.col("head").alias("child"))
    allowed = cut(closure.closure(nested, at.select(F.lit(siren).alias("start"), F.col("head").alias("node"))).select(F.col("node").alias("head")))
    inside = cut(rows.join(allowed, "head", "left_semi").select("siren", "mother"))
    seed = inside.where(F.col("siren") == siren).select(F.col("siren").alias("start"), F.col("siren").alias("node"))
    found = closure.descent(inside.where("mother is not null").select(F.col("mother").alias("parent"), F.col("siren").alias("child")), seed)
    return found.select(F.col("node").alias("siren"), F.col("level").cast("long").alias("level"))


def alone(asked: DataFrame, rows: DataFrame, offices: DataFrame, companies: DataFrame) -> DataFrame:
    """siren, name, targetable, reason: asked companies that no group holds, if they have an active office, aren't sole traders and aren't closed."""
    legal = offices.where("cj is null or cj not between 1000 and 1999").join(companies.where("closed is not null").select("siren"), "siren", "left_anti")
    own = legal.join(asked.select("siren"), "siren", "left_semi").join(rows.select("siren"), "siren", "left_anti")
    return own.select("siren", "name").join(rules.targetable(offices, companies).select("siren", "targetable", "reason"), "siren")


def below_traders(mothers: DataFrame, offices: DataFrame, units: DataFrame) -> DataFrame:
    """siren, mother: companies whose mother at the register is a sole trader: one that is neither an office nor a legal unit."""
    known = offices.where("cj is null or cj not between 1000 and 1999").select("siren").unionByName(units.select("siren")).distinct()
    return mothers.select(F.col("child").alias("siren"), "mother").join(known.withColumnRenamed("siren", "mother"), "mother", "left_anti").select("siren", "mother")


def map_rows(rows: DataFrame, offices: DataFrame) -> DataFrame:
    """The lines of a country map's export: identifiers grouped, cells safe for spreadsheets, `oui` or `non`, the mother with her name."""
    named = offices.select("siren", names.safe_cell(F.col("name")).alias("name"))
    met = rows.select("siren", "head", "mother", "level", "targetable").join(named, "siren", "left").join(named.toDF("mother", "mother_name"), "mother", "left")
    return met.select(names.grouped_siren(F.col("siren")).alias("siren"), "name", names.grouped_siren(F.col("head")).alias("head"), names.grouped_siren(F.col("mother")).alias("mother"), "mother_name", "level", F.when(F.col("targetable"), "oui").otherwise("non").alias("targetable"))


def listed_by_group(assigned: DataFrame, asked: DataFrame, documents: DataFrame) -> DataFrame:
    """head, listed, document: how many listed companies each group holds, and whether it has a document. documents: head."""
    met = assigned.join(asked.select("siren").distinct(), "siren", "left_semi").groupBy("head").agg(F.count("*").alias("listed"))
    return met.join(documents.select("head").distinct().withColumn("document", F.lit(True)), "head", "left").select("head", "listed", F.coalesce("document", F.lit(False)).alias("document"))
