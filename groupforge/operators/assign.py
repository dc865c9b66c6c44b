"""One group for each company: arbitration between claims, mutual groups, groups from trees, sizes and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupforge.operators import rules, tree
from groupforge.operators.closure import closure
from groupforge.operators.tree import open_links
from groupforge.plans.storage import cut

MANNERS = {"inscription": 0, "descente": 1, "arbre": 2}
BANK_GROUP = 20
#: Legal categories of cooperatives.
BANK_CJ = [5194, 5195, 5460, 5560, 5660, 6560, 6595, 6596]


def arbitrate(claims: DataFrame, groups: DataFrame) -> DataFrame:
    """siren, head, manner, contested: the one group that keeps each claimed company.

    claims: head, siren, manner, rate, level. groups: head, parent, size. Trees lose to documents; an enclosing group yields to a group
    nested in it; then inscription before descent, the higher rate and larger size or the lower level, and the smallest head.
    """
    rank = F.create_map(*[F.lit(x) for p in MANNERS.items() for x in p])[F.col("manner")]
    own = claims.withColumn("rank", rank).groupBy("siren", "head").agg(F.min(F.struct("rank", (-F.coalesce("rate", F.lit(0.0))).alias("rate"), F.coalesce("level", F.lit(0)).alias("level"))).alias("c"))
    best = own.groupBy("siren").agg(F.min("c.rank").alias("least"), F.count("*").alias("claimants"))
    left = own.join(best, "siren").where((F.col("c.rank") < 2) | (F.col("least") == 2))
    edges = groups.where("parent is not null").select(F.col("head").alias("parent"), F.col("parent").alias("child"))
    above = closure(edges, groups.select(F.col("head").alias("start"), F.col("head").alias("node"))).where("start <> node")
    yields = left.select("siren", F.col("head").alias("start")).join(above, "start").select("siren", F.col("node").alias("head")).distinct()
    left = left.join(yields, ["siren", "head"], "left_anti").join(groups.select("head", "size"), "head", "left")
    listed = F.col("c.rank") == 0
    order = F.struct(
        F.col("c.rank").alias("rank"), F.when(listed, F.col("c.rate")).otherwise(F.lit(0.0)).alias("rate"), F.when(listed, -F.coalesce("size", F.lit(0))).otherwise(F.lit(0)).alias("size"),
        F.when(listed, F.lit(0)).otherwise(F.col("c.level")).alias("level"), F.col("head").alias("head"),
    )
    won = left.groupBy("siren").agg(F.min(order).alias("w"), F.max("claimants").alias("claimants"))
    names = F.create_map(*[F.lit(x) for p in MANNERS.items() for x in p[::-1]])
    return won.select("siren", F.col("w.head").alias("head"), names[F.col("w.rank")].alias("manner"), (F.col("claimants") > 1).alias("contested"))


def group_parents(listings: DataFrame) -> DataFrame:
    """head, parent: of the documents that list a head, the nearest (one that another lists itself), then the smallest.

    listings: a (document's head), b (another document's head that it lists). A loop of parents opens at its smallest head.
    """
    edges = listings.where("a <> b").select("a", "b").distinct()
    reach = closure(edges.select(F.col("a").alias("parent"), F.col("b").alias("child")), edges.select(F.col("a").alias("start"), F.col("a").alias("node")).distinct()).where("start <> node")
    pairs = edges.alias("x").join(edges.alias("y"), F.col("x.b") == F.col("y.b")).where("x.a <> y.a").select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.a").alias("other"))
    down = reach.select(F.col("start").alias("a"), F.col("node").alias("other"), F.lit(True).alias("down"))
    up = reach.select(F.col("start").alias("other"), F.col("node").alias("a"), F.lit(True).alias("up"))
    farther = pairs.join(down, ["a", "other"]).join(up, ["a", "other"], "left").where("up is null").select("a", "b").distinct()
    near = edges.join(farther.withColumn("far", F.lit(True)), ["a", "b"], "left")
    best = near.groupBy(F.col("b").alias("head")).agg(F.min(F.struct(F.coalesce("far", F.lit(False)).alias("far"), "a")).alias("p"))
    chosen = best.select("head", F.col("p.a").alias("parent"))
    up_edges = chosen.select(F.col("head").alias("parent"), F.col("parent").alias("child"))
    above = closure(up_edges, chosen.select(F.col("head").alias("start"), F.col("parent").alias("node")))
    loops = above.where("start = node").select(F.col("start").alias("head")).distinct()
    loop_of = above.join(loops.withColumnRenamed("head", "node"), "node", "left_semi").join(loops.withColumnRenamed("head", "start"), "start", "left_semi").groupBy("start").agg(F.min("node").alias("low"))
    opened = loop_of.where("start = low").select(F.col("start").alias("head"), F.lit(True).alias("opened"))
    return chosen.join(opened, "head", "left").select("head", F.when(F.col("opened").isNull(), F.col("parent")).alias("parent"))


def mutual_banks(offices: DataFrame, links: DataFrame, head: str, name_pattern: str, least: int = BANK_GROUP, allowed: list[str] | None = None, refused: tuple[str, ...] = ()) -> DataFrame:
    """siren, grouping: local banks of the federation whose bank is head.

    Banks: offices of a bank's name (SQL LIKE) or of a cooperative's category. A grouping counts if more than `least` banks are members.
    A bank belongs by its smallest groupings, if all of those are the head's; territory lists allow or refuse departments.
    """
    banks = offices.where(F.col("name").like(name_pattern) | F.col("cj").isin(BANK_CJ)).select("siren", F.substring("postcode", 1, 2).alias("dep"))
    member = open_links(links).where("role = '11'").select(F.col("parent").alias("siren"), F.col("child").alias("grouping")).distinct()
    member = member.join(offices.select(F.col("siren").alias("grouping")), "grouping", "left_semi")
    joined = member.join(banks.select("siren"), "siren", "left_semi")
    sized = joined.groupBy("grouping").agg(F.count("*").alias("n")).where(F.col("n") > least)
    own = member.where(F.col("siren") == head).select("grouping").withColumn("own", F.lit(True))
    held = joined.join(sized, "grouping").join(own, "grouping", "left").fillna({"own": False})
    smallest = held.groupBy("siren").agg(F.min("n").alias("least"))
    tied = held.join(smallest, "siren").where("n = least").groupBy("siren").agg(F.min(F.when(F.col("own"), F.col("grouping"))).alias("grouping"), F.bool_and("own").alias("all_own"))
    out = tied.where((F.col("siren") != head) & F.col("all_own")).join(banks, "siren").where(~F.coalesce("dep", F.lit("")).isin(list(refused)))
    if allowed is not None:
        out = out.where(F.col("dep").isin(allowed))
    return out.select("siren", "grouping")


def tree_groups(found: DataFrame, offices: DataFrame, companies: DataFrame, taken: DataFrame) -> DataFrame:
    """siren, head, mother, level, targetable, proof: groups of trees between active companies that no document group took."""
    active = offices.select("siren")
    free = found.select("child", "mother", "role").join(active.withColumnRenamed("siren", "child"), "child", "left_semi").join(active.withColumnRenamed("siren", "mother"), "mother", "left_semi")
    free = free.join(taken.select(F.col("siren").alias("child")), "child", "left_anti").join(taken.select(F.col("siren").alias("mother")), "mother", "left_anti")
    free = cut(free)
    placed = cut(free.join(tree.roots(free), "child"))
    members = placed.select(F.col("child").alias("siren"), F.col("root").alias("head"), "mother", "role", F.col("depth").alias("level"))
    tops = placed.select(F.col("root").alias("siren")).distinct().join(members.select("siren"), "siren", "left_anti")
    tops = tops.select("siren", F.col("siren").alias("head"), F.lit(None).cast("string").alias("mother"), F.lit(None).cast("string").alias("role"), F.lit(0).cast("long").alias("level"))
    rows = members.unionByName(tops).join(rules.targetable(offices, companies), "siren", "left")
    top = F.col("siren") == F.col("head")
    proof = F.concat(F.lit("Mandat au registre : "), F.coalesce(rules.label(F.col("role")), F.concat(F.lit("rôle "), F.col("role"))))
    return rows.select("siren", "head", F.when(~top, F.col("mother")).alias("mother"), F.when(top, F.lit(0)).otherwise(F.col("level")).cast("long").alias("level"), (top | F.col("targetable")).alias("targetable"), F.when(top, "Tête du groupe").otherwise(proof).alias("proof"))


def coverage(assigned: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, covered, share of listed companies that some group holds."""
    met = asked.select("siren").distinct().join(assigned.select("siren").distinct().withColumn("held", F.lit(True)), "siren", "left")
    return met.agg(F.count("*").alias("asked"), F.count_if("held").alias("covered")).withColumn("share", F.round(F.col("covered") / F.col("asked"), 6))


def levels_within(rows: DataFrame) -> DataFrame:
    """siren, head, mother, level: how far a company is below the first one whose mother doesn't count: a head, or one without a mother in rows.

    A loop of mothers opens at its smallest company, which has level 0.
    """
    rows = cut(rows.select("siren", "head", "mother"))
    inside = rows.where("siren <> head").join(rows.select(F.col("siren").alias("mother")), "mother", "left_semi")
    depth = tree.roots(cut(inside.select(F.col("siren").alias("child"), "mother"))).select(F.col("child").alias("siren"), "depth")
    return rows.join(depth, "siren", "left").select("siren", "head", "mother", F.coalesce("depth", F.lit(0)).cast("long").alias("level"))


def nearest_kept(rows: DataFrame, mothers: DataFrame) -> DataFrame:
    """siren, head, kept, direct: the nearest company above each one that is in the same group, or null; direct: it is the mother itself.

    rows: siren, head. mothers: child, mother. Companies that are in other groups or in none are passed; a way that comes back ends.
    """
    up = cut(mothers.select(F.col("child").alias("at"), F.col("mother").alias("next")).repartition("at"))
    group = cut(rows.select(F.col("siren").alias("next"), F.col("head").alias("next_head")))
    front, done, step = rows.select("siren", "head", F.col("siren").alias("at"), F.array("siren").alias("way")), None, 0
    while True:
        met = front.join(up, "at", "left").withColumn("next", F.when(~F.array_contains("way", F.col("next")), F.col("next")))
        met = cut(met.join(group, "next", "left"))
        here = F.coalesce(F.col("next_head") == F.col("head"), F.lit(False))
        ended = met.where(here | F.col("next").isNull()).select("siren", "head", F.when(here, F.col("next")).alias("kept"), (here & F.lit(step == 0)).alias("direct"))
        done = ended if done is None else done.unionByName(ended)
        front = met.where(~here & F.col("next").isNotNull()).select("siren", "head", F.col("next").alias("at"), F.concat("way", F.array("next")).alias("way"))
        step += 1
        if front.isEmpty():
            return done


def other_federations(offices: DataFrame, links: DataFrame, mothers: DataFrame, head: str, name_pattern: str, tops: list[str], other_names: list[str], least: int = BANK_GROUP) -> DataFrame:
    """siren: what belongs to other federations than the one of the bank head.

    Members of groupings of more than `least` banks that head isn't in; the given tops and all below them by other mandates than a seat on a
    board; banks whose name, hyphens read as spaces, holds another federation's.
    """
    bank = F.col("name").like(name_pattern) | F.col("cj").isin(BANK_CJ)
    banks = offices.where(bank).select("siren", F.translate("name", "-", " ").alias("name"))
    member = open_links(links).where("role = '11'").select(F.col("parent").alias("siren"), F.col("child").alias("grouping")).distinct()
    large = member.join(banks.select("siren"), "siren", "left_semi").groupBy("grouping").agg(F.count("*").alias("n")).where(F.col("n") > least).select("grouping")
    own = open_links(links).where(F.col("parent") == head).select(F.col("child").alias("grouping")).distinct()
    members = member.join(large.join(own, "grouping", "left_anti"), "grouping", "left_semi").select("siren")
    seeds = offices.sparkSession.createDataFrame([("", x) for x in tops], "start string, node string")
    edges = mothers.where("role not in ('64', '65')").select(F.col("mother").alias("parent"), "child")
    below = closure(edges, seeds).select(F.col("node").alias("siren"))
    named = F.lit(False)
    for x in other_names:
        named = named | F.contains(F.col("name"), F.lit(x))
    return members.unionByName(below).unionByName(banks.where(named).select("siren")).distinct()


def territory(federations: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], named: set[str], department: str | None) -> tuple[list[str] | None, list[str]]:
    """The departments where alone a bank may be (None: anywhere), and those where it may not, for a federation whose head is in department.

    federations: to each one its own departments and those it shares. named: those that the document names beside the head's. A head in
    no federation's own department may have banks anywhere but in the own departments of the ones that aren't named.
    """
    mine = next((f for f, (own, _) in federations.items() if department in own), None)
    kept = named | ({mine} if mine else set())
    allowed = None if mine is None else sorted({d for f in kept & set(federations) for part in federations[f] for d in part})
    return allowed, sorted({d for f, (own, _) in federations.items() if f not in kept for d in own if d != department})
