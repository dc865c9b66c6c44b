"""Rules that decide: what can be targeted, which address and which directors tie companies, who enters a group and why."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupforge.functions import names
from groupforge.operators.tree import open_links
from groupforge.plans.storage import Shelf, cut, shuffled

#: Role codes and their labels.
STRONG = {
    "73": "Président", "30": "Gérant", "28": "Gérant et associé indéfiniment et solidairement responsable", "29": "Gérant et associé indéfiniment responsable",
    "74": "Associé indéfiniment et solidairement responsable", "75": "Associé indéfiniment responsable", "131": "Associé commandité",
}
MEDIUM = {"65": "Administrateur", "11": "Membre", "64": "Membre du conseil de surveillance", "51": "Président du conseil d'administration"}
WEAK = {"99": "Autre"}
DIRECTING = ["73", "30", "28", "29", "51", "53"]
HOLDING_NAF = ["64.20Z", "64.30Z", "66.30Z", "68.20A", "68.20B", "68.10Z", "68.32A", "64.99Z"]
SMALL_BANDS = ["", "NN", "00", "01", "02", "03"]
LABELS = STRONG | MEDIUM | WEAK
MAX_ROUNDS = 50
CHARTED = "tête de maison (organigramme public du groupe)"


@dataclass(frozen=True)
class Settings:
    """What is set for one group. Brands and houses are normalised names; families are family names, the beginning of a person's key."""

    homonyms: tuple[str, ...] = ()
    acronyms: tuple[str, ...] = ()
    left_out: tuple[str, ...] = ()
    name_beginnings: tuple[str, ...] = ()
    families: tuple[str, ...] = ()
    houses: tuple[str, ...] = ()
    priority: tuple[str, ...] = ()


PLAIN = Settings()
MOST_ITEMS, MOST_CHARS = 1000, 200


def checked(content: object) -> Settings:
    """Settings from an object as JSON gives it; a ValueError tells all that is wrong with it, without repeating any value (it may be a name)."""
    if not isinstance(content, dict):
        raise ValueError("les réglages doivent être un objet JSON")
    wrong = []
    for key, value in content.items():
        if key not in Settings.__dataclass_fields__:
            wrong.append(f"{key} : clé inconnue")
        elif not isinstance(value, (list, tuple)):
            wrong.append(f"{key} : doit être une liste")
        elif len(value) > MOST_ITEMS:
            wrong.append(f"{key} : {MOST_ITEMS} éléments au plus")
        else:
            for i, x in enumerate(value):
                if not isinstance(x, str):
                    wrong.append(f"{key}.{i} : doit être un texte")
                elif not 0 < len(x) <= MOST_CHARS:
                    wrong.append(f"{key}.{i} : 1 à {MOST_CHARS} caractères")
                elif key in ("left_out", "priority") and not (len(x) == 9 and x.isascii() and x.isdigit()):
                    wrong.append(f"{key}.{i} : format invalide")
    if wrong:
        raise ValueError("\n".join(wrong))
    return Settings(**{k: tuple(v) for k, v in content.items()})


def civil(cj: Column) -> Column:
    c = F.coalesce(cj.cast("string"), F.lit(""))
    return c.startswith("6") & ~c.startswith("62")


def grouping(cj: Column) -> Column:
    return F.coalesce(cj.cast("string"), F.lit("")).startswith("62")


def label(role: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[role]


def targetable_reason(cj: Column, naf: Column, band: Column, staff: Column) -> Column:
    """Why a company can or can't be targeted; only the last reason says it can."""
    big = ~F.coalesce(band, F.lit("")).isin(SMALL_BANDS) | (F.coalesce(staff, F.lit(0)) >= 10)
    return (
        F.when(civil(cj) & ~big, "Société civile ou SCI")
        .when(grouping(cj) & ~big, "GIE de moyens")
        .when(F.coalesce(naf.isin(HOLDING_NAF), F.lit(False)) & ~big, "Holding ou société immobilière sans salarié déclaré")
        .when(F.coalesce(band == "00", F.lit(False)) & (F.coalesce(staff, F.lit(0)) == 0), "Aucun salarié")
        .otherwise("Société opérationnelle")
    )


def targetable(offices: DataFrame, companies: DataFrame) -> DataFrame:
    """siren, targetable, reason."""
    met = offices.join(companies.select("siren", "staff"), "siren", "left")
    reason = targetable_reason(F.col("cj"), F.col("naf"), F.col("band"), F.col("staff"))
    return met.select("siren", (reason == "Société opérationnelle").alias("targetable"), reason.alias("reason"))


def shared_addresses(offices: DataFrame, retained: DataFrame, alike: DataFrame) -> DataFrame:
    """address_key, own, all: addresses with two retained companies at least where half the companies are group-like.

    Associations don't count; masked addresses are none. alike: siren of companies with evidence of their own.
    """
    usable = offices.where(F.col("address_key").isNotNull() & (F.col("address_key") != "") & ~F.col("address_key").contains("[ND]"))
    kept = retained.select("siren").distinct().withColumn("is_kept", F.lit(True))
    like = alike.select("siren").unionByName(retained.select("siren")).distinct().withColumn("is_like", F.lit(True))
    met = usable.select("siren", "address_key", F.coalesce(F.col("cj").cast("string"), F.lit("")).startswith("9").alias("association")).join(kept, "siren", "left").join(like, "siren", "left")
    member = ~F.col("association")
    counted = met.groupBy("address_key").agg(
        F.count_if(F.col("is_kept")).alias("kept"), F.count_if(member & F.col("is_like")).alias("own"), F.count_if(member).alias("all"),
    )
    return counted.where("kept >= 2 and own > 0 and own / all >= 0.5").select("address_key", "own", "all")


def common_directors(persons: DataFrame, retained: DataFrame) -> DataFrame:
    """siren, common (directors that another retained company has too), directing, manager (one sits in two retained companies).

    The person keys stay inside: they are counted, never given out.
    """
    seats = persons.where("closed is null").select("siren", "person", "role")
    held = seats.join(retained.select("siren"), "siren", "left_semi").select("siren", "person").distinct()
    index = held.groupBy("person").agg(F.count("*").alias("seats"))
    met = seats.groupBy("siren", "person").agg(F.bool_or(F.col("role").isin(DIRECTING)).alias("directs")).join(index, "person")
    return met.groupBy("siren").agg(F.count("*").alias("common"), F.bool_or("directs").alias("directing"), F.bool_or(F.col("seats") >= 2).alias("manager"))


def evidence_rows(offices: DataFrame, companies: DataFrame, links: DataFrame, persons: DataFrame, retained: DataFrame, brands: DataFrame, listed: DataFrame, **more) -> DataFrame:
    """The rows of evidence() that aren't retained: one wide row for each candidate, all that a decision reads."""
    return evidence(offices, companies, links, persons, retained, brands, listed, **more).join(retained.select("siren"), "siren", "left_anti")


def evidence(
    offices: DataFrame, companies: DataFrame, links: DataFrame, persons: DataFrame, retained: DataFrame, brands: DataFrame, listed: DataFrame,
    settings: Settings = PLAIN, charted: DataFrame | None = None, refused: DataFrame | None = None,
) -> DataFrame:
    """One wide row for each company with an open link from a retained one, a brand, a line in the published list, an office at a group
    address, or the head of a house.

    brands: siren, brand (normalised), kind. listed: siren, controlled. charted: siren of the heads of houses. refused: siren of companies
    that a decision keeps out; they don't make an address the group's, and neither do those that the settings leave out.
    """
    known = _known(offices, companies, brands, listed, settings, charted)
    return _evidence(known, _mandates(links, retained), common_directors(persons, retained), retained, settings, refused)


def _mandates(links: DataFrame, retained: DataFrame) -> DataFrame:
    """siren, strong, medium, weak, outside, members, members_outside, linked of each company with an open link."""
    edges = _edges(links)
    kept = retained.select(F.col("siren").alias("parent")).distinct()
    return _outside(_totals(edges), _held(edges.join(kept, "parent", "left_semi")))


HELD = ("strong", "medium", "weak", "inside_members")


def _edges(links: DataFrame) -> DataFrame:
    roles = {"strong": list(STRONG), "medium": list(MEDIUM), "weak": list(WEAK), "inside_members": ["11"]}
    return open_links(links).select("parent", F.col("child").alias("siren"), *[F.coalesce(F.col("role").isin(r).cast("int"), F.lit(0)).alias(k) for k, r in roles.items()])


def _totals(edges: DataFrame) -> DataFrame:
    return edges.groupBy("siren").agg(F.sum("strong").alias("all_strong"), F.sum("inside_members").alias("members"))


def _held(edges: DataFrame) -> DataFrame:
    return edges.groupBy("siren").agg(*[F.sum(c).alias(c) for c in HELD])


def _outside(totals: DataFrame, held: DataFrame) -> DataFrame:
    met = totals.join(held.withColumn("linked", F.lit(True)), "siren", "left").fillna(0, list(HELD)).fillna(False, ["linked"])
    return met.select(
        "siren", "strong", "medium", "weak", (F.col("all_strong") - F.col("strong")).alias("outside"), "members", (F.col("members") - F.col("inside_members")).alias("members_outside"), "linked",
    )


def _known(offices: DataFrame, companies: DataFrame, brands: DataFrame, listed: DataFrame, settings: Settings, charted: DataFrame | None) -> DataFrame:
    """What is known of each company whoever is retained: its office, staff, brands, list line, house, names left out."""
    named = brands.withColumn("brand_words", F.size(F.split("brand", " "))).groupBy("siren").agg(
        F.bool_or(F.col("kind") == "sure").alias("sure"), F.min(F.when(F.col("kind") == "sure", F.col("brand_words"))).alias("sure_words"), F.lit(True).alias("brand"),
        F.coalesce(F.bool_or((F.col("kind") == "sure") & F.col("brand").isin(list(settings.homonyms))), F.lit(False)).alias("homonym"),
        F.max(F.when((F.col("kind") == "sure") & F.col("brand").isin(list(settings.acronyms)), F.col("brand_words"))).alias("acronym_words"),
    )
    wide = offices.select("siren", "cj", "name", "band", "address_key", names.norm(F.col("name")).alias("normed")).join(companies.select("siren", "staff"), "siren", "left")
    wide = wide.join(named, "siren", "left").join(listed.groupBy("siren").agg(F.max("controlled").alias("controlled")), "siren", "left")
    if charted is None:
        wide = wide.withColumn("charted", F.lit(False))
    else:
        wide = wide.join(charted.select("siren").distinct().withColumn("charted", F.lit(True)), "siren", "left")
    wide = wide.withColumn("barred", excluded(F.col("name"), list(settings.name_beginnings))).fillna(False, ["sure", "brand", "homonym", "charted"])
    return wide.withColumn("risky", F.col("homonym") | F.coalesce(F.size(F.split("normed", " ")) <= F.col("acronym_words") + 1, F.lit(False)))


def _evidence(known: DataFrame, mandates: DataFrame, people: DataFrame, retained: DataFrame, settings: Settings, refused: DataFrame | None) -> DataFrame:
    """evidence() from its parts: known as _known, mandates as _mandates, people as common_directors give them."""
    wide = known.join(mandates, "siren", "left").join(people, "siren", "left")
    wide = wide.fillna(dict.fromkeys(("strong", "medium", "weak", "outside", "members", "members_outside", "common"), 0) | dict.fromkeys(("linked", "directing", "manager"), False))
    apart = F.col("barred") | F.col("siren").isin(list(settings.left_out))
    alike = wide.where((F.col("linked") | F.col("sure") | F.col("manager")) & ~apart).select("siren")
    alike = alike if refused is None else alike.join(refused.select("siren"), "siren", "left_anti")
    # masked and missing addresses are many rows with one key: they are dropped before the join
    located = known.where((F.col("address_key") != "") & ~F.contains("address_key", F.lit("[ND]"))).select("siren", "address_key")
    at_group = located.join(shared_addresses(known, retained, alike).select("address_key"), "address_key").select("siren").distinct().withColumn("at_group", F.lit(True))
    wide = wide.drop("address_key").join(at_group, "siren", "left").fillna(False, ["at_group"])
    return wide.where((F.expr("linked or brand or at_group or charted or controlled is not null")) & ~F.col("siren").isin(list(settings.left_out)))


def entry_reason(normed: Column | None = None) -> Column:
    """The first rule that lets a candidate of evidence_rows enter, or null; the order of the rules counts. normed: its normalised name, if at hand."""
    c = F.col
    normed = names.norm(c("name")) if normed is None else normed
    name_words = F.size(F.split(normed, " "))
    bare = name_words <= c("sure_words") + 1
    tiny = F.coalesce(c("band"), F.lit("")).isin("", "NN", "00") & (F.coalesce(c("staff"), F.lit(0)) == 0)
    cj = F.coalesce(c("cj").cast("string"), F.lit(""))
    people = ((c("common") >= 2) | ((c("common") >= 1) & c("manager"))) & ~(civil(c("cj")) & ~c("sure"))
    others = c("brand").cast("int") + c("at_group").cast("int") + people.cast("int")
    none = F.lit(None).cast("string")
    return (
        F.when(c("barred") | cj.startswith("9") | normed.rlike(r"^(CSE|COMITE|AMICALE|ASSOCIATION)\b"), none)
        .when(cj.startswith("3"), none)
        .when(~c("controlled"), none)
        .when(c("controlled"), F.lit("inscrite au périmètre publié du groupe"))
        .when(c("strong") > 0, F.lit("mandat fort au registre"))
        .when(c("charted"), F.lit(CHARTED))
        .when(grouping(c("cj")) & (c("members") >= 2) & (c("members_outside") == 0), F.lit("GIE dont tous les membres sont du groupe"))
        .when((c("medium") > 0) & (c("outside") > 0), none)
        .when((c("medium") > 0) & ((people & c("directing")) | c("brand") | c("at_group")), F.lit("mandat au registre et indice indépendant"))
        .when(c("medium") > 0, none)
        .when((c("weak") > 0) & (others >= 2), F.lit("mandat 'Autre' et deux indices"))
        .when(c("sure") & ~civil(c("cj")) & ~c("risky") & ~(tiny & bare), F.lit("nom de marque propre au groupe"))
        .when(c("brand") & (people | c("at_group")), F.lit("nom de marque et second indice"))
        .when(c("at_group") & (people | ((c("common") >= 1) & ~civil(c("cj")))), F.lit("adresse du groupe et second indice"))
    )


def excluded(name: Column, beginnings: list[str]) -> Column:
    """The name, in upper case, begins with one of those that settings exclude."""
    out = F.lit(False)
    for b in beginnings:
        out = out | F.coalesce(F.upper(name).startswith(b.upper()), F.lit(False))
    return out


def without_families(persons: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """Seats of persons whose family name (what stands before the first bar of the key) isn't left out."""
    return persons.where(~F.coalesce(F.substring_index("person", "|", 1).isin(list(families)), F.lit(False)))


def expand(offices: DataFrame, companies: DataFrame, links: DataFrame, persons: DataFrame, head: str, brands: DataFrame, listed: DataFrame, decisions: DataFrame | None = None, max_rounds: int = MAX_ROUNDS, settings: Settings = PLAIN) -> DataFrame:
    """siren, reason, round: the group of head, grown until a round adds nothing.

    All candidates of a round see the companies retained before it. Decisions (siren, decision) override the rules: `ecarter` keeps a
    company out, `retenir` lets a candidate in. A last round that adds nothing proves the end; without one there is a warning.
    """
    return grown(offices, companies, links, persons, head, brands, listed, decisions, max_rounds, settings).kept


@dataclass(frozen=True)
class Grown:
    """kept: siren, reason, round. lost: siren, rule: the last rule that would have let in a company that a decision keeps out. wide: evidence()
    once the group has grown. seats: siren, person, directs: open seats without the families that are left out."""

    kept: DataFrame
    lost: DataFrame
    wide: DataFrame
    seats: DataFrame


def grown(offices: DataFrame, companies: DataFrame, links: DataFrame, persons: DataFrame, head: str, brands: DataFrame, listed: DataFrame, decisions: DataFrame | None = None, max_rounds: int = MAX_ROUNDS, settings: Settings = PLAIN) -> Grown:
    """What expand gives, and what it was judged by.

    Mandates and directors are running counts: a round adds what its new companies hold, and meets the seats of those persons only who
    were met for the first time or now sit in a second company, so seats are shuffled once and not in every round. No join broadcasts a table
    that grows with the register.
    """
    with shuffled(offices.sparkSession):
        return _grown(offices, companies, links, persons, head, brands, listed, decisions, max_rounds, settings)


def _grown(offices: DataFrame, companies: DataFrame, links: DataFrame, persons: DataFrame, head: str, brands: DataFrame, listed: DataFrame, decisions: DataFrame | None, max_rounds: int, settings: Settings) -> Grown:
    spark = offices.sparkSession
    shelf = Shelf(spark, "expand")
    put = shelf.put
    seats = without_families(persons, settings.families).where("closed is null")
    seats = put(seats.groupBy("siren", "person").agg(F.max(F.col("role").isin(DIRECTING)).alias("directs")))
    edges = put(_edges(links))
    totals = put(_totals(edges))
    known = put(_known(offices, companies, brands, listed, settings, charted(offices, settings)))
    decisions = None if decisions is None else put(decisions.select("siren", "decision"))
    refused = None if decisions is None else decisions.where("decision = 'ecarter'")
    kept = put(spark.createDataFrame([(head, "tête du groupe", 0)], "siren string, reason string, round int"))
    lost = spark.createDataFrame([], "siren string, rule string, round int")
    held, people, index, new = None, None, None, kept.select("siren")

    def summed(old: DataFrame | None, more: DataFrame, key: str, flags: tuple[str, ...] = ()) -> DataFrame:
        both = more if old is None else old.unionByName(more)
        return put(both.groupBy(key).agg(*[(F.max if c in flags else F.sum)(c).alias(c) for c in more.columns if c != key]))

    for n in range(1, max_rounds + 2):
        held = summed(held, _held(edges.join(new.withColumnRenamed("siren", "parent"), "parent", "left_semi")), "siren")
        sits = seats.join(new, "siren", "left_semi").groupBy("person").agg(F.count("*").alias("seats"))
        before = sits.withColumn("before", F.lit(0)) if index is None else sits.join(index.withColumnRenamed("seats", "before"), "person", "left").fillna(0, ["before"])
        first, twice = F.col("before") == 0, (F.col("before") < 2) & (F.col("before") + F.col("seats") >= 2)
        sits = put(before.select("person", "seats", first.alias("first"), twice.alias("twice")))
        index = summed(index, sits.select("person", "seats"), "person")
        met = seats.join(sits.where("first or twice"), "person").groupBy("siren").agg(F.sum(F.col("first").cast("long")).alias("common"), F.max(F.col("first") & F.col("directs")).alias("directing"), F.max("twice").alias("manager"))
        people = summed(people, met, "siren", ("directing", "manager"))
        wide = put(_evidence(known, _outside(totals, held), people, kept, settings, refused))
        if n > max_rounds:
            warnings.warn(f"the group of {head} still grew in round {max_rounds}", stacklevel=5)
            break
        ready = wide.join(kept.select("siren"), "siren", "left_anti").withColumn("rule", entry_reason(F.col("normed")))
        ready = ready.withColumn("decision", F.lit(None).cast("string")) if decisions is None else ready.join(decisions, "siren", "left")
        reason = F.when(F.col("decision") == "ecarter", F.lit(None)).when((F.col("decision") == "retenir") & F.col("rule").isNull(), F.lit("retenue par décision du consultant")).otherwise(F.col("rule"))
        judged = put(ready.select("siren", "rule", "decision", reason.alias("reason"), F.lit(n).alias("round")).where("rule is not null or reason is not null"))
        lost = lost.unionByName(judged.where("decision = 'ecarter'").select("siren", "rule", "round"))
        added = judged.where("reason is not null").select("siren", "reason", "round")
        if added.isEmpty():
            break
        kept, new = put(kept.unionByName(added)), added.select("siren")
    lost = put(lost.groupBy("siren").agg(F.max_by("rule", "round").alias("rule")))
    shelf.close(kept, lost, wide, seats)
    return Grown(kept, lost, wide, seats)


def expand_traced(offices: DataFrame, companies: DataFrame, links: DataFrame, persons: DataFrame, head: str, brands: DataFrame, listed: DataFrame, decisions: DataFrame | None = None, max_rounds: int = MAX_ROUNDS, settings: Settings = PLAIN) -> tuple[DataFrame, DataFrame]:
    """What expand gives; and siren, rule: the last rule that would have let in a company that a decision keeps out."""
    found = grown(offices, companies, links, persons, head, brands, listed, decisions, max_rounds, settings)
    return found.kept, found.lost


def charted(offices: DataFrame, settings: Settings) -> DataFrame | None:
    """siren of the head of each house of the organisation chart; None without a chart."""
    if not settings.houses:
        return None
    return cut(chart_heads(offices, offices.sparkSession.createDataFrame([(h,) for h in settings.houses], "house string")).select("siren"))


def parent_choice(links: DataFrame, retained: DataFrame, head: str) -> DataFrame:
    """siren, mother, proof, confidence: the strongest mandate inside the group, else the head."""
    rank = F.when(F.col("role").isin(list(STRONG)), 0).when(F.col("role").isin(list(WEAK)), 1).otherwise(2)
    inside = open_links(links).join(retained.select(F.col("siren").alias("parent")), "parent", "left_semi").join(retained.select(F.col("siren").alias("child")), "child", "left_semi")
    best = inside.groupBy(F.col("child").alias("siren")).agg(F.min(F.struct(rank.alias("rank"), (F.col("parent") != head).cast("int").alias("other"), "parent", "role")).alias("best"))
    met = retained.where(F.col("siren") != head).select("siren", "reason").join(best, "siren", "left")
    role = F.coalesce(label(F.col("best.role")), F.col("best.role"))
    found = F.col("best").isNotNull()
    return met.select(
        "siren", F.when(found, F.col("best.parent")).otherwise(F.lit(head)).alias("mother"),
        F.when(found, F.concat(F.lit("Mandat au registre : "), role)).otherwise("Déduit : rattachée à la tête du groupe").alias("proof"),
        F.when(found, "A").when(F.col("reason").contains("second indice") | F.col("reason").startswith("inscrite"), "B").otherwise("C").alias("confidence"),
    )


def doubtful(links: DataFrame, retained: DataFrame, choices: DataFrame) -> DataFrame:
    """siren, kept, kinds (comma-joined), outside (mandates that companies outside hold): cases for a consultant."""
    heavy = list(STRONG) + list(MEDIUM)
    kept = retained.select(F.col("siren").alias("parent")).withColumn("inside", F.lit(True))
    met = open_links(links).join(kept, "parent", "left")
    held = met.groupBy(F.col("child").alias("siren")).agg(
        F.count_if(F.col("inside").isNull() & F.col("role").isin(heavy)).alias("outside"), F.count_if(F.col("inside") & F.col("role").isin(list(MEDIUM))).alias("shares"),
    )
    rows = held.join(retained.select("siren").withColumn("kept", F.lit(True)), "siren", "full_outer").join(choices.select("siren", "confidence"), "siren", "left")
    rows = rows.fillna({"kept": False, "outside": 0, "shares": 0, "confidence": ""})
    kinds = F.concat_ws(
        ",", F.when(F.col("kept") & (F.col("confidence") == "C"), "confiance_c"), F.when(F.col("kept") & (F.col("outside") > 0), "co_entreprise"),
        F.when(~F.col("kept") & (F.col("shares") > 0), "participation"),
    )
    return rows.select("siren", "kept", kinds.alias("kinds"), "outside").where("kinds <> ''")


def in_force(decisions: DataFrame) -> DataFrame:
    """siren, decision: the latest by date, then number; unknown values don't hide older ones."""
    known = decisions.where(F.col("decision").isin("retenir", "ecarter"))
    return known.groupBy("siren").agg(F.max_by("decision", F.struct("taken", "number")).alias("decision"))


#: Words that may stand before a house's name in an organisation chart.
HOUSE_WORDS = "SOC|STE|SOCIETE|LES|LE|LA|L"


def chart_heads(offices: DataFrame, houses: DataFrame) -> DataFrame:
    """house, siren: the largest eligible company whose name is a house's or begins with it. houses: house (normalised).

    Beginnings of names are generated, so the match is an equal join. Civil companies, associations and foreign ones don't count.
    """
    cj = F.coalesce(F.col("cj").cast("string"), F.lit(""))
    usable = offices.where(F.col("cj").isNotNull() & ~civil(F.col("cj")) & ~cj.startswith("9") & ~cj.startswith("3"))
    words = usable.select("siren", F.when(F.col("band") == "NN", F.lit(-1)).otherwise(F.col("band").try_cast("int")).alias("size"), F.split(names.norm(F.col("name")), " ").alias("words"))
    most = houses.agg(F.max(F.size(F.split("house", " ")))).first()[0] or 1
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda k: (k == 0) | F.concat(F.array_join(F.slice("words", 1, k), " "), F.lit(" ")).rlike(f"^(({HOUSE_WORDS}) )*$"))
    begun = words.withColumn("skip", F.explode(starts)).withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.size("words") - F.col("skip"), F.lit(most)))))
    begun = begun.select("siren", "size", F.array_join(F.slice("words", F.col("skip") + 1, F.col("k")), " ").alias("house")).distinct()
    best = begun.join(houses.select("house").distinct(), "house").groupBy("house").agg(F.min(F.struct(F.col("size").isNull().alias("none"), (-F.col("size")).alias("size"), "siren")).alias("b"))
    return best.select("house", F.col("b.siren").alias("siren"))


def listed(matched: DataFrame) -> DataFrame:
    """siren, method, rate: of a company's lines the most controlled one, the first of equals. matched: siren, line, method, rate."""
    rank = F.when(F.col("method") == "IG", 2).when(F.col("method").isin("NC", "inconnue") & (F.col("rate") > 50), 1).otherwise(0)
    best = matched.where("siren is not null").groupBy("siren").agg(F.min(F.struct((-rank).alias("rank"), "line", "method", "rate")).alias("b"))
    return best.select("siren", F.col("b.method").alias("method"), F.col("b.rate").alias("rate"))
