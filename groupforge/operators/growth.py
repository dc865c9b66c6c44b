"""Groups that grow together: the entry rules for any number of heads at once, driven by what the last round added.

All state is keyed by group, so the number of jobs depends on the rounds of the slowest group and not on how many there are; a group
that stops growing has no frontier and costs nothing more. Evidence is kept as running counts. A round looks up only what its new
companies touch: their links and their directors' other seats (storage.Sorted, which joins read in order without a shuffle), their addresses
(storage.Keyed, which reads the buckets of those keys), and judges only the candidates whose counts that changed, since all others would be judged as before.

Every count that matters grows: links from inside, directors met, directors who sit twice, companies alike at an address. So an address
that is the group's once stays so. The rules themselves aren't monotone (a medium mandate refuses what a brand would let in), which is
why a candidate that is touched is judged anew from all its counts.

In turn: within a round a candidate sees those that entered before it (the register's own order of judgement). It can depend only on its
parents that precede it, so the round is settled by judging again, level by level, those whose preceding parents' outcome has changed;
the order has no loops, so the outcome is the one of judging one after the other, without bringing a group into one task.

Heads without an active office are failures and don't grow; groups that still grow in the last round are reported as unfinished.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupforge.functions import names
from groupforge.operators import rules
from groupforge.operators.rules import DIRECTING, MAX_ROUNDS, MEDIUM, STRONG, WEAK, Settings
from groupforge.operators.tree import open_links
from groupforge.plans.storage import Keyed, Shelf, Sorted, buckets_here, ordered_buckets, shuffled

COUNTS = ("strong", "medium", "weak", "inside_members", "common")
FLAGS = ("linked", "directing", "manager", "at_group")
BY_DECISION, HEAD_REASON = "retenue par décision du consultant", "tête du groupe"


class Register:
    """What stays the same for all groups and rounds, each table written once by the key it is looked up by."""

    def __init__(self, offices: DataFrame, companies: DataFrame, links: DataFrame, persons: DataFrame, buckets: int = 16):
        with shuffled(offices.sparkSession), ordered_buckets(offices.sparkSession):
            self._written(offices, companies, links, persons, buckets)

    def _written(self, offices: DataFrame, companies: DataFrame, links: DataFrame, persons: DataFrame, buckets: int) -> None:
        cj = F.coalesce(F.col("cj").cast("string"), F.lit(""))
        address = F.when((F.col("address_key") != "") & ~F.contains("address_key", F.lit("[ND]")), F.col("address_key"))
        known = offices.select("siren", "cj", "name", names.norm(F.col("name")).alias("normed"), "band", address.alias("address"), cj.startswith("9").alias("association"))
        known = known.join(companies.groupBy("siren").agg(F.max("staff").alias("staff")), "siren", "left")
        roles = {"strong": list(STRONG), "medium": list(MEDIUM), "weak": list(WEAK), "member": ["11"]}
        edges = open_links(links).select("parent", "child", *[F.col("role").isin(r).cast("int").alias(k) for k, r in roles.items()])
        self.links = Sorted(edges, "parent")
        totals = self.links.all().groupBy(F.col("child").alias("siren")).agg(F.sum("strong").alias("all_strong"), F.sum("member").alias("members"))
        # dealt by company before they are grouped, so that the table's buckets need no second shuffle
        seats = persons.where("closed is null").select("siren", "person", F.col("role").isin(DIRECTING).alias("directs")).repartition(buckets_here(offices.sparkSession), "siren")
        seats = seats.groupBy("siren", "person").agg(F.bool_or("directs").alias("directs"))
        self.spark = offices.sparkSession
        self.offices = Keyed(known.join(totals, "siren", "left").fillna(0, ["all_strong", "members"]), "siren", buckets)
        placed = self.offices.all().where("address is not null")
        self.at_address = Keyed(placed.select("address", "siren"), "address", buckets)
        self.members_at = Keyed(placed.groupBy("address").agg(F.count_if(~F.col("association")).alias("all")), "address", buckets)
        self.seats = Sorted(seats.withColumn("family", F.substring_index("person", "|", 1)), "siren", dealt=True)
        self.seats_of = Sorted(self.seats.all().select("person", "siren", "directs"), "person")

    def drop(self) -> None:
        for t in (self.offices, self.at_address, self.members_at, self.links, self.seats, self.seats_of):
            t.drop()


@dataclass(frozen=True)
class Growth:
    """kept: grp, siren, reason, round. counts: grp, siren and the evidence of each company touched. overruled: grp, siren, rule that a
    decision lost. failures: grp, failure."""

    kept: DataFrame
    counts: DataFrame
    overruled: DataFrame
    failures: DataFrame


def setting_rows(spark: SparkSession, settings: dict[str, Settings]) -> DataFrame:
    """grp, kind, value: settings of some groups as a table."""
    rows = [(g, f.name, v) for g, s in settings.items() for f in fields(s) for v in getattr(s, f.name)]
    return spark.createDataFrame(rows, "grp string, kind string, value string")


def _set(settings: DataFrame, kind: str, name: str) -> DataFrame:
    return settings.where(F.col("kind") == kind).select("grp", F.col("value").alias(name)).distinct()


def _static(put, offices: DataFrame, heads: DataFrame, brands: DataFrame, listed: DataFrame, decisions: DataFrame, settings: DataFrame) -> DataFrame:
    """grp, siren and what no round changes: brand, list line, house, decision, left out. brands: grp, siren, brand, kind."""
    yes = F.lit(True)
    named = brands.join(_set(settings, "homonyms", "brand").withColumn("h", yes), ["grp", "brand"], "left").join(_set(settings, "acronyms", "brand").withColumn("a", yes), ["grp", "brand"], "left")
    sure, words = F.col("kind") == "sure", F.size(F.split("brand", " "))
    named = named.groupBy("grp", "siren").agg(
        F.bool_or(sure).alias("sure"), F.min(F.when(sure, words)).alias("sure_words"), F.lit(True).alias("brand"), F.coalesce(F.bool_or(sure & F.col("h")), F.lit(False)).alias("homonym"),
        F.max(F.when(sure & F.col("a"), words)).alias("acronym_words"), F.max(F.length("brand")).alias("brand_length"),
    )
    told = listed.groupBy("grp", "siren").agg(F.max("controlled").alias("controlled"))
    houses = put(_set(settings, "houses", "house"))
    found = rules.chart_heads(offices, houses.select("house").distinct()) if not houses.isEmpty() else None
    chart = houses.select("grp", F.lit("").alias("siren")).limit(0) if found is None else houses.join(found, "house").select("grp", "siren").distinct()
    out = named.join(told, ["grp", "siren"], "full_outer").join(chart.withColumn("charted", yes), ["grp", "siren"], "full_outer").join(decisions.select("grp", "siren", "decision"), ["grp", "siren"], "full_outer")
    out = out.join(_set(settings, "left_out", "siren").withColumn("left_out", yes), ["grp", "siren"], "full_outer").join(heads.select("grp"), "grp", "left_semi")
    return put(out.fillna(False, ["sure", "brand", "homonym", "charted", "left_out"]))


def _barred(rows: DataFrame, beginnings: DataFrame) -> DataFrame:
    """grp, siren of rows (grp, siren, name) whose name begins with what the group's settings exclude."""
    met = rows.alias("r").join(F.broadcast(beginnings.alias("b")), (F.col("r.grp") == F.col("b.grp")) & F.startswith(F.upper("r.name"), F.upper("b.beginning")))
    return met.select("r.grp", "r.siren").distinct()


def _judged(rows: DataFrame) -> DataFrame:
    """rows with rule (the first that lets it in) and reason (after the decision)."""
    ready = rows.withColumn("outside", F.col("all_strong") - F.col("strong")).withColumn("members_outside", F.col("members") - F.col("inside_members"))
    ready = ready.withColumn("rule", rules.entry_reason(F.col("normed")))
    return ready.withColumn("reason", F.when(F.col("decision") == "ecarter", F.lit(None)).when(F.col("decision") == "retenir", F.coalesce("rule", F.lit(BY_DECISION))).otherwise(F.col("rule")))


def _settled(put, pool: DataFrame, touched: DataFrame, register: Register) -> DataFrame:
    """Judges a round's pool in its order: who enters is seen by the children that follow. pool: candidates with their counts and order."""
    own = ["strong", "medium", "weak", "inside_members"]
    order = F.struct("seen", "kind", "place", "siren")
    pool = put(pool.withColumn("order", order))
    # the mandates in which a company of the pool precedes another, once for all levels
    edges = register.links.of(pool.select(F.col("siren").alias("parent"))).join(pool.select("grp", F.col("siren").alias("parent"), F.col("order").alias("before")), "parent")
    edges = edges.withColumnRenamed("child", "siren").join(pool.select("grp", "siren", "order"), ["grp", "siren"]).where(F.col("before") < F.col("order"))
    inner = put(edges.groupBy("grp", "siren", "parent").agg(*[F.sum(c if c != "inside_members" else "member").alias(f"more_{c}") for c in own]))
    again, seen, verdicts = touched, None, None
    while True:
        more = pool.join(again, ["grp", "siren"], "left_semi")
        if seen is not None:
            # mandates that companies entering before it hold in a candidate
            given = inner.join(again, ["grp", "siren"], "left_semi").join(seen.withColumnRenamed("siren", "parent"), ["grp", "parent"], "left_semi")
            given = given.groupBy("grp", "siren").agg(*[F.sum(f"more_{c}").alias(f"more_{c}") for c in own])
            more = more.join(given, ["grp", "siren"], "left")
            more = more.select(*[c for c in pool.columns if c not in own], *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in own])
        judged = put(_judged(more).select("grp", "siren", "rule", "reason", "decision", "order"))
        before = verdicts
        verdicts = judged if before is None else put(before.join(again, ["grp", "siren"], "left_anti").unionByName(judged))
        enters = F.col("reason").isNotNull()
        if before is None:
            changed = put(judged.where(enters).select("grp", "siren"))
        else:  # only those judged again may differ; who wasn't judged before didn't enter
            now, old = (x.groupBy("grp", "siren").agg(F.count_if(enters).alias(name)) for x, name in ((judged, "now"), (before, "old")))
            changed = put(now.join(old, ["grp", "siren"], "left").where(F.col("now") != F.coalesce("old", F.lit(0))).select("grp", "siren"))
        if changed.isEmpty():
            return verdicts
        again = inner.join(changed.withColumnRenamed("siren", "parent"), ["grp", "parent"], "left_semi").select("grp", "siren").distinct()
        again, seen = put(again), verdicts.where(enters).select("grp", "siren")
        if again.isEmpty():
            return verdicts


def grow(
    register: Register, offices: DataFrame, heads: DataFrame, brands: DataFrame, listed: DataFrame, decisions: DataFrame | None = None, settings: DataFrame | None = None,
    in_turn: bool = False, max_rounds: int = MAX_ROUNDS,
) -> Growth:
    """Grows every group of heads (grp, siren) until no round adds to any.

    brands: grp, siren, brand (normalised), kind. listed: grp, siren, controlled. decisions: grp, siren, decision. settings: as setting_rows.
    """
    with shuffled(register.spark), ordered_buckets(register.spark):
        return _grown(register, offices, heads, brands, listed, decisions, settings, in_turn, max_rounds)


def _grown(
    register: Register, offices: DataFrame, heads: DataFrame, brands: DataFrame, listed: DataFrame, decisions: DataFrame | None, settings: DataFrame | None, in_turn: bool, max_rounds: int,
) -> Growth:
    spark = register.spark
    shelf = Shelf(spark, "growth")
    put, together = shelf.put, shelf.together
    none = spark.createDataFrame([], "grp string, siren string, decision string")
    decisions = none if decisions is None else decisions
    settings = put(setting_rows(spark, {}) if settings is None else settings)
    beginnings, families = _set(settings, "name_beginnings", "beginning"), _set(settings, "families", "family")
    with_office = register.offices.of(heads).select("siren")
    good = put(heads.select("grp", "siren").distinct().join(with_office, "siren", "left_semi"))
    failed = heads.select("grp").distinct().join(good.select("grp"), "grp", "left_anti").select("grp", F.lit("tête sans siège actif").alias("failure"))
    static = _static(put, offices, good, brands, listed, decisions, settings)
    refused = static.where("decision = 'ecarter' or left_out").select("grp", "siren")

    counts = put(spark.createDataFrame([], "grp string, siren string, strong long, medium long, weak long, inside_members long, common long, linked boolean, directing boolean, manager boolean, at_group boolean"))
    index = put(spark.createDataFrame([], "grp string, person string, seats long"))
    likes = [put(spark.createDataFrame([], "grp string, siren string"))]
    places = put(spark.createDataFrame([], "grp string, address string, kept long, own long, ours boolean"))
    first = put(spark.createDataFrame([], "grp string, siren string, seen int, kind int, place int"))
    kept = put(good.select("grp", "siren", F.lit(HEAD_REASON).alias("reason"), F.lit(0).alias("round")))
    losses = [put(spark.createDataFrame([], "grp string, siren string, rule string, round int"))]
    new, unfinished, entered = kept.select("grp", "siren"), None, [kept]

    for n in range(1, max_rounds + 1):
        # links and directors of the new companies
        linked = register.links.of(new.select(F.col("siren").alias("parent"))).join(new.withColumnRenamed("siren", "parent"), "parent").groupBy("grp", F.col("child").alias("siren")).agg(
            F.sum("strong").alias("strong"), F.sum("medium").alias("medium"), F.sum("weak").alias("weak"), F.sum("member").alias("inside_members"),
        )
        sits = register.seats.of(new).join(new, "siren").join(families, ["grp", "family"], "left_anti").groupBy("grp", "person").agg(F.count("*").alias("more"))
        sits = put(sits.join(index, ["grp", "person"], "left").select("grp", "person", "more", F.coalesce("seats", F.lit(0)).alias("before")))
        index = put(index.unionByName(sits.select("grp", "person", F.col("more").alias("seats"))).groupBy("grp", "person").agg(F.sum("seats").alias("seats")))
        known, twice = F.col("before") == 0, (F.col("before") < 2) & (F.col("before") + F.col("more") >= 2)
        news = sits.where(known | twice).select("grp", "person", known.alias("known"), twice.alias("twice"))
        met = register.seats_of.of(news).join(news, "person").groupBy("grp", "siren").agg(F.count_if("known").alias("common"), F.bool_or(F.col("known") & F.col("directs")).alias("directing"), F.bool_or("twice").alias("manager"))
        delta = linked.withColumn("linked", F.lit(True)).join(met, ["grp", "siren"], "full_outer")
        delta = put(delta.fillna(0, list(COUNTS)).fillna(False, ["linked", "directing", "manager"]))

        # companies that are now like the group's, and the addresses they make the group's
        tied = delta.where("linked or manager").select("grp", "siren")
        alike = together(*likes)
        if n == 1:
            tied = tied.unionByName(static.where("sure").select("grp", "siren")).distinct()
        tied = put(tied.join(alike, ["grp", "siren"], "left_anti").join(refused, ["grp", "siren"], "left_anti"))
        tied = register.offices.of(tied).join(tied, "siren").select("grp", "siren", "name")
        tied = tied.join(_barred(tied, beginnings), ["grp", "siren"], "left_anti").select("grp", "siren")
        joined = put(tied.unionByName(new.join(alike, ["grp", "siren"], "left_anti")).distinct())
        likes.append(joined)
        moved = joined.select("grp", "siren", F.lit(1).alias("own"), F.lit(0).alias("kept")).unionByName(new.select("grp", "siren", F.lit(0).alias("own"), F.lit(1).alias("kept")))
        moved = register.offices.of(moved).where("address is not null").join(moved, "siren").groupBy("grp", "address").agg(F.sum("kept").alias("kept"), F.sum(F.when(F.col("association"), 0).otherwise(F.col("own"))).alias("own"))
        moved = put(moved)
        places = places.unionByName(moved.withColumn("ours", F.lit(False))).groupBy("grp", "address").agg(F.sum("kept").alias("kept"), F.sum("own").alias("own"), F.bool_or("ours").alias("was"))
        places = put(places.join(register.members_at.of(moved), "address", "left").select("grp", "address", "kept", "own", "was", F.coalesce(F.col("was") | ((F.col("kept") >= 2) & (F.col("own") > 0) & (F.col("own") / F.col("all") >= 0.5)), F.lit(False)).alias("ours")))
        opened = places.where("ours and not was").select("grp", "address")
        at = put(register.at_address.of(opened).join(opened, "address").select("grp", "siren").distinct())
        places = places.drop("was")

        # running counts of all that was touched
        every = counts.unionByName(delta.withColumn("at_group", F.lit(False))).unionByName(at.select("grp", "siren", *[F.lit(0).cast("long").alias(c) for c in COUNTS], *[F.lit(c == "at_group").alias(c) for c in FLAGS]))
        counts = put(every.groupBy("grp", "siren").agg(*[F.sum(c).alias(c) for c in COUNTS], *[F.bool_or(c).alias(c) for c in FLAGS]))
        touched = delta.select("grp", "siren").unionByName(at)
        if n == 1:
            touched = touched.unionByName(static.select("grp", "siren"))
        touched = put(touched.distinct().join(kept.select("grp", "siren"), ["grp", "siren"], "left_anti"))

        pool = touched
        if in_turn:
            pool = put(touched.unionByName(first.select("grp", "siren")).distinct().join(kept.select("grp", "siren"), ["grp", "siren"], "left_anti"))
        wide = register.offices.of(pool).join(pool, "siren").join(counts, ["grp", "siren"], "left").join(static, ["grp", "siren"], "left")
        wide = wide.fillna(0, list(COUNTS)).fillna(False, [*FLAGS, "sure", "brand", "homonym", "charted", "left_out"])
        wide = put(wide.where("not left_out and (linked or brand or at_group or charted or controlled is not null)"))
        wide = wide.join(_barred(wide, beginnings).withColumn("barred", F.lit(True)), ["grp", "siren"], "left").fillna(False, ["barred"])
        wide = wide.withColumn("risky", F.col("homonym") | F.coalesce(F.size(F.split("normed", " ")) <= F.col("acronym_words") + 1, F.lit(False)))
        if in_turn:
            kind = F.when(F.col("brand"), 0).when(F.col("controlled"), 1).when(~F.col("controlled"), 2).when(F.col("linked"), 3).otherwise(4)
            fresh = wide.join(first.select("grp", "siren"), ["grp", "siren"], "left_anti")
            first = put(first.unionByName(fresh.select("grp", "siren", F.lit(n).alias("seen"), kind.alias("kind"), F.when(F.col("brand"), -F.coalesce("brand_length", F.lit(0))).otherwise(0).alias("place"))))
            judged = _settled(put, wide.join(first, ["grp", "siren"]), touched, register)
        else:
            judged = put(_judged(wide).select("grp", "siren", "rule", "reason", "decision"))
        over = judged.where("decision = 'ecarter' and rule is not null").select("grp", "siren", "rule", F.lit(n).alias("round"))
        losses.append(put(over))
        added = put(judged.where("reason is not null").select("grp", "siren", "reason", F.lit(n).alias("round")))
        if added.isEmpty():
            break
        entered.append(added)
        kept = together(*entered)
        new = added.select("grp", "siren")
    else:
        unfinished = new.select("grp").distinct().select("grp", F.lit(f"croît encore au tour {max_rounds}").alias("failure"))
    kept, overruled = put(kept), put(together(*losses).groupBy("grp", "siren").agg(F.max_by("rule", "round").alias("rule")))
    failures = put(failed if unfinished is None else failed.unionByName(unfinished))
    shelf.close(kept, counts, overruled, failures)
    return Growth(kept, counts, overruled, failures)


def expand_in_turn(
    offices: DataFrame, companies: DataFrame, links: DataFrame, persons: DataFrame, head: str, brands: DataFrame, listed: DataFrame, decisions: DataFrame | None = None,
    max_rounds: int = MAX_ROUNDS, settings: Settings = rules.PLAIN,
) -> DataFrame:
    """siren, reason, round of one group in the register's own order of judgement: candidates by the round that first saw them; in it brands
    (longest first), the published list, links, then addresses; then by id."""
    spark, of = offices.sparkSession, F.lit(head).alias("grp")
    register = Register(offices, companies, links, persons)
    heads = spark.createDataFrame([(head, head)], "grp string, siren string")
    decided = None if decisions is None else decisions.select(of, "siren", "decision")
    grown = grow(register, offices, heads, brands.select(of, "siren", "brand", "kind"), listed.select(of, "siren", "controlled"), decided, setting_rows(spark, {head: settings}), True, max_rounds)
    if not grown.failures.isEmpty():
        warnings.warn(f"the group of {head}: {grown.failures.first().failure}", stacklevel=2)
    register.drop()
    return grown.kept.select("siren", "reason", "round")
