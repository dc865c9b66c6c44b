"""Why a company is in a group or is not: its evidence with the round that found it, the rule that decided and the one that lost, the cases.

All is keyed by group, so any number of groups is explained at once. The loop of growth isn't run again: kept says in which round each
company entered, and what a company ties to the group counts from the round after. An address becomes the group's in the first round in
which the companies that have joined by then are enough; arrivals are counted by round first, so an address has at most as many rows as
there are rounds when they are summed up.

Evidence and indications are relations of one row each, not lists in a cell: a company with many mandates is many rows. Persons are
counted and never named, and neither is a mother that is a sole trader or unknown.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groupforge.functions import names
from groupforge.operators import maps, rules
from groupforge.operators.rules import LABELS, MEDIUM, STRONG, Settings, label
from groupforge.operators.tree import open_links
from groupforge.plans.storage import cut, settled

#: Methods of consolidation in words.
METHODS = {"IG": "intégration globale", "MEE": "mise en équivalence", "NC": "non consolidée", "inconnue": "méthode non publiée", "autre": "autre méthode"}
SURE, AMBIGUOUS, CHART, REGISTER, ADDRESS, LISTED, UNCONTROLLED = "marque_sure", "marque_ambigue", "organigramme", "registre", "adresse", "perimetre", "perimetre_sans_controle"
COLUMNS = ("grp", "siren", "kind", "other", "role", "own", "members", "round")


def apart(offices: DataFrame, settings: Settings, decisions: DataFrame | None = None) -> DataFrame:
    """siren of companies that never make an address the group's: left out, named like those left out, or kept out by a decision."""
    out = offices.where(rules.excluded(F.col("name"), list(settings.name_beginnings)) | F.col("siren").isin(list(settings.left_out))).select("siren")
    return out if decisions is None else out.unionByName(decisions.where("decision = 'ecarter'").select("siren")).distinct()


def _told(rows: DataFrame, kind: str | Column, first: Column, **more: Column) -> DataFrame:
    """Evidence rows of one kind, one for each detail, with the first round that found it."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    given = {"other": F.lit(None).cast("string"), "role": F.lit(None).cast("string"), "own": F.lit(None).cast("long"), "members": F.lit(None).cast("long")} | more
    found = rows.select("grp", "siren", kind.alias("kind"), *[v.alias(k) for k, v in given.items()], first.cast("long").alias("round"))
    return found.groupBy(*COLUMNS[:-1]).agg(F.min("round").alias("round"))


def _seats(persons: DataFrame) -> DataFrame:
    return persons.where("closed is null").select("siren", "person").distinct()


def _managers(persons: DataFrame, kept: DataFrame) -> DataFrame:
    """grp, siren, round: companies with a director who sits in two retained ones, from the round after the second of them entered."""
    seats = _seats(persons)
    by_round = seats.join(kept.select("grp", "siren", "round"), "siren").groupBy("grp", "person", "round").agg(F.count("*").alias("n"))
    # at most one entry a round
    held = by_round.groupBy("grp", "person").agg(F.sort_array(F.collect_list(F.struct("round", "n"))).alias("r"))
    second = held.select("grp", "person", F.when(F.col("r")[0]["n"] >= 2, F.col("r")[0]["round"]).otherwise(F.get("r", F.lit(1))["round"]).alias("second")).where("second is not null")
    return seats.join(second, "person").groupBy("grp", "siren").agg((F.min("second") + 1).alias("round"))


def _addresses(offices: DataFrame, persons: DataFrame, kept: DataFrame, own: DataFrame, apart: DataFrame) -> DataFrame:
    """Evidence of a seat at one of the group's addresses, with how many of the companies there are like the group's.

    own: grp, siren, round from which a company's own evidence makes it like the group's.
    """
    usable = offices.where(F.col("address_key").isNotNull() & (F.col("address_key") != "") & ~F.contains("address_key", F.lit("[ND]")))
    usable = usable.select("siren", F.col("address_key").alias("address"), F.coalesce(F.col("cj").cast("string"), F.lit("")).startswith("9").alias("association"))
    entered = kept.select("grp", "siren", (F.col("round") + 1).alias("round"))
    like = own.unionByName(_managers(persons, kept)).join(apart, ["grp", "siren"], "left_anti").unionByName(entered)
    like = like.groupBy("grp", "siren").agg(F.min("round").alias("round"))
    # only addresses where two retained companies sit can be the group's
    joined = entered.join(usable.select("siren", "address"), "siren").groupBy("grp", "address", "round").agg(F.count("*").alias("kept"))
    places = joined.groupBy("grp", "address").agg(F.sum("kept").alias("n")).where("n >= 2").select("grp", "address")
    at = cut(usable.where("not association").join(places, "address").select("grp", "siren", "address"))
    counted = at.groupBy("grp", "address").agg(F.count("*").alias("members"))
    arrived = at.join(like, ["grp", "siren"]).groupBy("grp", "address", "round").agg(F.count("*").alias("own"))
    moves = joined.join(places, ["grp", "address"], "left_semi").join(arrived, ["grp", "address", "round"], "full_outer").fillna(0, ["kept", "own"])
    so_far = Window.partitionBy("grp", "address").orderBy("round")
    moves = moves.withColumn("kept", F.sum("kept").over(so_far)).withColumn("own", F.sum("own").over(so_far)).join(counted, ["grp", "address"])
    ours = (F.col("kept") >= 2) & (F.col("own") > 0) & (F.col("own") / F.col("members") >= 0.5)
    spots = moves.groupBy("grp", "address").agg(F.min(F.when(ours, F.col("round"))).alias("round"), F.max("own").alias("own"), F.max("members").alias("members")).where("round is not null")
    return _told(at.join(spots, ["grp", "address"]), ADDRESS, F.col("round"), other=F.col("address"), own=F.col("own"), members=F.col("members"))


def evidence(offices: DataFrame, links: DataFrame, persons: DataFrame, kept: DataFrame, brands: DataFrame, listed: DataFrame, charted: DataFrame | None = None, apart: DataFrame | None = None) -> DataFrame:
    """grp, siren, kind, other (brand, mother or address), role, own, members, round: each piece of evidence once, with the round that found it first.

    kept: grp, siren, reason, round. brands: grp, siren, brand, kind. listed: grp, siren, controlled. charted: grp, siren. apart: grp, siren.
    Evidence that doesn't depend on who is retained has round 0; of an address the counts are those of the last round. persons without the
    families that settings leave out.
    """
    sure = brands.where("kind = 'sure'").select("grp", "siren", F.lit(1).alias("round"))
    from_kept = kept.select("grp", F.col("siren").alias("parent"), (F.col("round") + 1).alias("round"))
    linked = cut(open_links(links).select("parent", F.col("child").alias("siren"), "role").join(from_kept, "parent"))
    own = sure.unionByName(linked.select("grp", "siren", "round"))
    said = listed.groupBy("grp", "siren").agg(F.max("controlled").alias("controlled")).where("controlled is not null")
    none = kept.select("grp", "siren").limit(0)
    parts = [
        _told(brands, F.concat(F.lit("marque_"), "kind"), F.lit(0), other=F.col("brand")),
        _told(said, F.when(F.col("controlled"), LISTED).otherwise(UNCONTROLLED), F.lit(0)),
        _told(linked, REGISTER, F.col("round"), other=F.col("parent"), role=F.col("role")),
        _addresses(offices, persons, kept, own, none if apart is None else apart),
    ]
    if charted is not None:
        parts.append(_told(charted, CHART, F.lit(0)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _lines(listed: DataFrame) -> DataFrame:
    """grp, siren, controlled, method, rate, source, text: of a company's lines the most controlled one, the first of equals by text."""
    best = F.min(F.struct((~F.coalesce("controlled", F.lit(False))).alias("last"), "source", "text", "method", "rate", "controlled"))
    return listed.where("controlled is not null").groupBy("grp", "siren").agg(best.alias("b")).select("grp", "siren", "b.controlled", "b.method", "b.rate", "b.source", "b.text")


def _method(method: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair])[method], method)


def cases(offices: DataFrame, links: DataFrame, kept: DataFrame, chosen: DataFrame, evidence: DataFrame, listed: DataFrame, decisions: DataFrame, overruled: DataFrame, apart: DataFrame) -> DataFrame:
    """grp, siren, name, kinds, rule, kept, decision: companies for a consultant to look at, and the rule that put each where it is.

    Kinds, comma-joined in this order: `confiance_c` (retained on one deduced tie), `co_entreprise` (retained, and a company outside holds a
    strong or medium mandate), `participation` (outside, with a medium mandate from inside or in the published list as not controlled),
    `etrangere` (foreign, with a sure brand or in the list), `decision` (none of these, but a decision put it where it is).

    chosen: grp, siren, proof, confidence; none for heads, which are no cases. evidence: as evidence() gives it. listed: grp, siren,
    controlled, method, rate, source, text. decisions: grp, siren, decision, those in force. overruled: grp, siren, rule: the last rule that
    would have let in a company that a decision keeps out. apart: companies that settings leave out by name or number (grp, siren); they are
    never foreign cases.
    """
    c = F.col
    known = evidence.select("grp", "siren").unionByName(kept.select("grp", "siren")).distinct()
    inside = kept.select("grp", c("siren").alias("parent"), F.lit(True).alias("inside"))
    held = known.join(open_links(links).select("parent", c("child").alias("siren"), "role"), "siren").join(inside, ["grp", "parent"], "left")
    heavy = [*STRONG, *MEDIUM]
    held = held.groupBy("grp", "siren").agg(
        F.count_if(c("inside") & c("role").isin(list(MEDIUM))).alias("medium"), F.count_if(c("inside").isNull() & c("role").isin(heavy)).alias("outside"),
        F.count_if(c("inside").isNull() & c("role").isin(list(STRONG))).alias("strong_outside"),
    )
    kinds = evidence.where(c("kind").isin(SURE, LISTED, UNCONTROLLED)).groupBy("grp", "siren").agg(F.bool_or(c("kind") == UNCONTROLLED).alias("stated"), F.bool_or(c("kind") != UNCONTROLLED).alias("claimed"))
    met = known.join(offices.select("siren", "name", "cj", F.lit(True).alias("active")), "siren", "left").join(kept.select("grp", "siren", "reason"), ["grp", "siren"], "left")
    for more in (held, kinds, chosen.select("grp", "siren", "proof", "confidence"), decisions, overruled, apart.distinct().withColumn("left_out", F.lit(True)), _lines(listed).drop("controlled")):
        met = met.join(more, ["grp", "siren"], "left")
    met = met.fillna(0, ["medium", "outside", "strong_outside"]).fillna(False, ["stated", "claimed", "left_out"]).where("reason is null or proof is not null")
    retained, named = c("reason").isNotNull(), F.coalesce(c("cj").cast("string"), F.lit(""))
    shares = ~retained & F.coalesce(c("active"), F.lit(False)) & ((c("medium") > 0) | c("stated"))
    foreign = named.startswith("3") & c("claimed") & ~c("left_out") & ~F.coalesce(names.norm(c("name")).rlike(r"^(CSE|COMITE|AMICALE|ASSOCIATION)\b"), F.lit(False))
    doubts = F.concat_ws(
        ",", F.when(retained & (c("confidence") == "C"), "confiance_c"), F.when(retained & (c("outside") > 0), "co_entreprise"), F.when(shares, "participation"), F.when(foreign, "etrangere"),
    )
    by_decision = c("rule").isNotNull() | (retained & (c("decision") == "retenir"))
    met = met.withColumn("kinds", F.when(doubts != "", doubts).when(by_decision, "decision")).where("kinds is not null")
    proof = F.concat(F.coalesce("source", F.lit("")), F.lit(", ligne « "), F.coalesce("text", F.lit("")), F.lit(" » ("), F.concat_ws(", ", _method(c("method")), names.rate_text(c("rate"))), F.lit(")"))
    outcome = (
        F.when(retained, F.concat(F.lit("Entrée dans le groupe : "), "reason", F.lit(" · rattachement : "), "proof"))
        .when(c("rule").isNotNull(), F.concat(F.lit("Écartée par le consultant ; règle du moteur qui l'aurait retenue : "), "rule"))
        .when(shares & c("stated"), F.concat(F.lit("Non retenue : non contrôlée selon le périmètre publié ("), proof, F.lit(")")))
        .when(shares & (c("strong_outside") > 0), "Non retenue : contrôle partagé avec une société hors du groupe (mandat fort)")
        .when(shares, "Non retenue : participation sans contrôle (mandat moyen sans indice indépendant)")
        .otherwise("Non retenue : société étrangère, jamais retenue par le moteur")
    )
    return met.select("grp", "siren", "name", "kinds", outcome.alias("rule"), retained.alias("kept"), "decision")


def indications(found: DataFrame, offices: DataFrame, links: DataFrame, persons: DataFrame, kept: DataFrame, evidence: DataFrame, listed: DataFrame) -> DataFrame:
    """grp, siren, side (`pour`, `contre`), text: what ties each case to its group, and what speaks against. found: as cases() gives it."""
    c = F.col
    case = cut(found.select("grp", "siren", "kinds", "decision", "kept"))
    lines = _lines(listed)
    shown = evidence.join(case.select("grp", "siren"), ["grp", "siren"], "left_semi").join(lines.select("grp", "siren", "method", "rate"), ["grp", "siren"], "left")
    control = F.when(c("method") == "IG", F.lit("en intégration globale")).otherwise(F.concat_ws(", détenue à ", _method(c("method")), names.rate_text(c("rate"))))
    mandate = F.concat(F.lit("Mandat au registre : "), label(c("role")))
    pro = shown.select("grp", "siren", (
        F.when(c("kind") == SURE, F.lit("Porte une marque sûre du groupe")).when(c("kind") == AMBIGUOUS, "Porte une marque ambiguë du groupe")
        .when(c("kind") == REGISTER, F.concat(mandate, F.lit(", tenu par la société du groupe "), "other"))
        .when(c("kind") == ADDRESS, F.concat(F.lit("Siège à une adresse du groupe : "), "own", F.lit(" sociétés du groupe sur "), "members"))
        .when(c("kind") == CHART, "Tête d'une maison de l'organigramme public du groupe")
        .when(c("kind") == LISTED, F.concat(F.lit("Inscrite au périmètre publié du groupe, "), control))
        .when(c("kind") == UNCONTROLLED, F.concat(F.lit("Inscrite au périmètre publié du groupe, sans contrôle ("), F.coalesce(_method(c("method")), F.lit("?")), F.lit(")")))
    ).alias("text")).where("text is not null")
    seats = _seats(persons)
    index = seats.join(kept.select("grp", "siren"), "siren").groupBy("grp", "person").agg(F.count("*").alias("n"))
    mine = seats.join(case.select("grp", "siren", "kept"), "siren").join(index, ["grp", "person"]).where(c("n") > c("kept").cast("int"))
    shared = mine.groupBy("grp", "siren").agg(F.count("*").alias("n")).select("grp", "siren", F.concat(F.lit("Dirigeants en commun avec d'autres sociétés du groupe : "), "n").alias("text"))

    inside = kept.select("grp", c("siren").alias("parent"), F.lit(True).alias("inside"))
    held = case.select("grp", "siren").join(open_links(links).select("parent", c("child").alias("siren"), "role").distinct(), "siren").join(inside, ["grp", "parent"], "left")
    ties = held.where("inside").groupBy("grp", "siren").agg(F.bool_or(c("role").isin(list(STRONG))).alias("strong"), F.bool_or(c("role").isin(list(LABELS))).alias("any"))
    ties = case.join(ties, ["grp", "siren"], "left").fillna(False, ["strong", "any"]).where("not strong")
    weak = ties.select("grp", "siren", F.when(c("any"), "Aucun mandat fort (président, gérant…) tenu par une société du groupe").otherwise("Aucun mandat au registre tenu par une société du groupe").alias("text"))
    legal = offices.select(c("siren").alias("parent"), c("cj").cast("string").alias("parent_cj"))
    others = held.where(c("inside").isNull() & c("role").isin([*STRONG, *MEDIUM])).join(legal, "parent", "left")
    who = F.when((c("parent_cj") != "") & ~c("parent_cj").startswith("1"), F.concat(F.lit("la société "), "parent")).otherwise("une entité")
    others = others.select("grp", "siren", F.concat(mandate, F.lit(", tenu par "), who, F.lit(" hors du groupe")).alias("text"))
    stated = case.join(lines.where("not controlled").select("grp", "siren", "method"), ["grp", "siren"])
    abroad = case.where(F.array_contains(F.split("kinds", ","), "etrangere")).join(offices.select("siren", "cj"), "siren")
    contra = [
        weak, others, case.where(F.array_contains(F.split("kinds", ","), "confiance_c")).select("grp", "siren", F.lit("Un seul indice : rattachement déduit, pas lu au registre").alias("text")),
        stated.select("grp", "siren", F.concat(F.lit("Le périmètre publié du groupe la dit non contrôlée : "), F.coalesce(_method(c("method")), F.lit("?"))).alias("text")),
        abroad.select("grp", "siren", F.concat(F.lit("Société étrangère (catégorie juridique "), c("cj").cast("string"), F.lit(") : hors du périmètre France")).alias("text")),
        case.where("decision = 'ecarter'").select("grp", "siren", F.lit("Écartée par le consultant").alias("text")),
    ]
    out = pro.unionByName(shared).withColumn("side", F.lit("pour"))
    for part in contra:
        out = out.unionByName(part.withColumn("side", F.lit("contre")))
    return out.select("grp", "siren", "side", "text")


class Explained:
    """evidence, cases and indications of one group, and kept (grp, siren, reason, round). Each is worked out when it is first asked for,
    where no join broadcasts a table that grows with the register, and written."""

    def __init__(self, kept: DataFrame, evidence: Callable[[], DataFrame], cases: Callable[[DataFrame], DataFrame], indications: Callable[[DataFrame, DataFrame], DataFrame]):
        self.kept, self._evidence, self._cases, self._indications = kept, evidence, cases, indications

    @cached_property
    def evidence(self) -> DataFrame:
        return settled(self.kept.sparkSession, self._evidence)

    @cached_property
    def cases(self) -> DataFrame:
        found = self.evidence
        return settled(self.kept.sparkSession, lambda: self._cases(found))

    @cached_property
    def indications(self) -> DataFrame:
        found, doubts = self.evidence, self.cases
        return settled(self.kept.sparkSession, lambda: self._indications(found, doubts))


def explain(offices: DataFrame, companies: DataFrame, links: DataFrame, persons: DataFrame, head: str, brands: DataFrame, listed: DataFrame, decisions: DataFrame, settings: Settings = rules.PLAIN) -> Explained:
    """Grows the group of head by the rules and says why each company is in it or not.

    brands: siren, brand, kind. listed: siren, controlled, method, rate, source, text. decisions: siren, decision, those in force.
    """
    spark, of = offices.sparkSession, F.lit(head).alias("grp")
    lines = listed.groupBy("siren").agg(F.max("controlled").alias("controlled"))
    grown = rules.grown(offices, companies, links, persons, head, brands, lines, decisions, settings=settings)
    overruled = grown.lost.select(of, "siren", "rule")
    seats = grown.seats.withColumn("closed", F.lit(None).cast("date"))
    kept, listed = settled(spark, lambda: grown.kept.select(of, "*")), listed.select(of, "*")

    def told() -> DataFrame:
        charted = rules.charted(offices, settings)
        out = apart(offices, settings, decisions).select(of, "siren")
        return evidence(offices, links, seats, kept, brands.select(of, "siren", "brand", "kind"), listed, None if charted is None else charted.select(of, "siren"), out)

    def doubts(found: DataFrame) -> DataFrame:
        own = grown.wide.join(grown.kept.select("siren"), "siren", "left_semi")
        chosen = cut(maps.mothers(links, grown.kept, own, brands, maps.house_heads(grown.kept, brands, offices, companies), head, settings.priority).select(of, "siren", "proof", "confidence"))
        return cases(offices, links, kept, chosen, found, listed, decisions.select(of, "siren", "decision"), overruled, apart(offices, settings).select(of, "siren"))

    return Explained(kept, told, doubts, lambda found, doubts: indications(doubts, offices, links, seats, kept, found, listed))
