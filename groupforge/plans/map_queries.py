"""Queries over maps: one group from its head to its tables, and the country's map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupforge.functions import names
from groupforge.operators import assign, changes, closure, legal, maps, match, provenance, rules, serve, tree
from groupforge.plans import map_sql as sql
from groupforge.plans.register_queries import HEAD, LOW_DEGREE, _hits, _listed, query
from groupforge.plans.storage import cut, settled, shuffled
from groupforge.sources import tables


def _map(t) -> maps.GroupMap:
    offices, companies, links, persons = t("offices", "companies", "links", "persons")
    with shuffled(offices.sparkSession):
        hits, decided = cut(_hits(t)), cut(rules.in_force(t("decisions")))
    return maps.group_map(offices, companies, links, persons, HEAD, hits, _listed(t), decided, sql.MAP_SETTINGS)


@query(sql.MAP_COMPANIES)
def group_map_companies(spark, t):
    return _map(t).companies


@query(sql.MAP_LINKS)
def group_map_links(spark, t):
    return _map(t).links


@query(sql.MAP_SHARES)
def group_map_participations(spark, t):
    return _map(t).participations


@query(sql.MAP_FOREIGN)
def group_map_foreign(spark, t):
    return _map(t).foreign


def _explained(t) -> provenance.Explained:
    offices, companies, links, persons = t("offices", "companies", "links", "persons")
    lines = t("doc_lines").where(F.col("doc") == HEAD)
    listed = lines.select(F.lpad((F.col("line") * 3).cast("string"), 9, "0").alias("siren"), match.controlled().alias("controlled"), "method", "rate", F.col("doc").alias("source"), F.col("name").alias("text"))
    with shuffled(offices.sparkSession):
        hits, listed, decided = cut(_hits(t)), cut(listed), cut(rules.in_force(t("decisions")))
    return provenance.explain(offices, companies, links, persons, HEAD, hits, listed, decided, sql.MAP_SETTINGS)


@query(sql.EVIDENCE)
def group_evidence(spark, t):
    return _explained(t).evidence.drop("grp")


@query(sql.EXPLAINED)
def group_cases_explained(spark, t):
    """Each case with its rule, one row for each indication for and against it."""
    found = _explained(t)
    cases, texts = found.cases, found.indications
    return settled(spark, lambda: cases.join(texts, ["grp", "siren"], "left").select("siren", "name", "kinds", "rule", "kept", "decision", "side", "text"))


def _country(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members of the documents' maps, what the lists say, and the groups with their parents."""
    lines, links, offices = t("doc_lines", "links", "offices")
    heads = lines.select(F.col("doc").alias("start"), F.col("doc").alias("node")).distinct()
    down = cut(closure.descent(tree.open_links(links).where("role = '73'").select("parent", "child").distinct(), heads))
    best = tree.best_mothers(links, LOW_DEGREE).select(F.col("child").alias("node"), "mother", "role")
    there = down.select("start", F.col("node").alias("mother"), F.lit(True).alias("there"))
    met = down.join(best, "node", "left").join(there, ["start", "mother"], "left")
    top = F.col("start") == F.col("node")
    mapped = cut(met.select(
        F.col("start").alias("head"), F.col("node").alias("siren"), F.when(~top, F.when(F.col("there"), F.col("mother")).otherwise(F.col("start"))).alias("mother"), F.col("level").cast("long").alias("level"),
        F.when(top, "Tête du groupe").when(F.col("there"), F.concat(F.lit("Mandat au registre : "), "role")).otherwise(maps.BELOW_HEAD).alias("proof"), F.when(top | F.col("there"), "A").otherwise("C").alias("confidence"),
    ))
    banks = offices.where("cj = 5560 and siren < '000000200'").select(F.lit("000000003").alias("head"), "siren", F.lit("Banque de la fédération").alias("proof"))
    told = lines.select(F.col("doc").alias("head"), F.lpad((F.col("line") * 7 % 40).cast("string"), 9, "0").alias("siren"), "rate")
    nested = F.when(F.col("head") == "000000001", "000000000").when(F.col("head") == "000000003", "000000001")
    groups = cut(mapped.groupBy("head").agg(F.count("*").alias("size")).select("head", nested.alias("parent"), "size"))
    return cut(maps.with_banks(mapped, banks)), told, groups


def _document_rows(t) -> tuple[DataFrame, DataFrame]:
    members, told, groups = _country(t)
    won = maps.own_heads(assign.arbitrate(maps.claims_of(members, told), groups), groups)
    return cut(maps.document_rows(won, members, groups)), groups


@query(sql.CLAIMS)
def country_claims(spark, t):
    members, told, _ = _country(t)
    return maps.claims_of(members, told)


@query(sql.DOCUMENT_ROWS)
def country_document_rows(spark, t):
    return _document_rows(t)[0]


@query(sql.COUNTRY_GROUPS)
def country_groups(spark, t):
    rows, groups = _document_rows(t)
    return maps.groups_table(rows, t("offices"), groups, groups.select("head", F.concat(F.lit("document "), "head").alias("document")))


@query(sql.READ_MAP)
def country_read_map(spark, t):
    return maps.read_map(*_document_rows(t), "000000003")


@query(sql.ALONE)
def country_alone(spark, t):
    offices, companies = t("offices", "companies")
    return maps.alone(offices.where("siren < '000000500'"), _document_rows(t)[0], offices, companies)


@query(sql.BELOW_TRADERS)
def country_below_traders(spark, t):
    return maps.below_traders(tree.best_mothers(t("links"), LOW_DEGREE), t("offices"), t("legal_units").where("cj is null or cj < 5550"))


@query(sql.MAP_ROWS)
def country_map_rows(spark, t):
    offices, companies = t("offices", "companies")
    return maps.map_rows(_document_rows(t)[0].join(rules.targetable(offices, companies).select("siren", "targetable"), "siren", "left"), offices)


# --- tables of unknown columns in documents


def _table_lines(t) -> DataFrame:
    """Rows of several shapes from the published lists: with and without methods, countries, amounts, gaps, titles and long lines between."""
    n = F.col("line")
    share, method = F.regexp_replace(F.format_string("%.2f", F.col("rate") + F.lit(0.25)), r"\.", ","), F.col("method")
    text = (
        F.when(n % 23 == 0, F.lit("FRANCE | Pourcentage d'intérêts | % contrôle")).when(n % 29 == 0, F.lit("GERMANY | Pourcentage d'intérêts | % contrôle")).when(n % 31 == 0, F.repeat(F.lit("texte courant "), 8)).when(n % 37 == 0, F.lit("Japan"))
        .when(n % 11 == 1, F.concat_ws(" | ", "name", share, F.lit("98"))).when(n % 11 == 2, F.concat_ws(" | ", "name", F.lit("France"), F.lit("2 310"), share)).when(n % 11 == 3, F.concat_ws(" | ", "name", F.lit("France"), F.lit(""), F.lit(""), F.lit(""), share, F.lit("IG")))
        .when(n % 11 == 4, F.concat(F.lit(" | "), "name", F.lit(" (1) | "), "town", F.lit(" | "), share, F.lit(" % | IG* | "))).when(n % 11 == 5, F.concat_ws(" | ", F.lit("France, Vannes"), "name", F.lit("55"))).when(n % 11 == 6, F.concat_ws(" | ", "name", F.lit("France"), F.lit("55")))
        .when(n % 11 == 7, F.concat_ws(" | ", "name", "town", share, F.lit("120"))).when(n % 11 == 8, F.concat_ws(" | ", "name", F.lit("000000012"), F.lit("France"), share)).otherwise(F.concat_ws(" | ", "name", F.when(n % 2 == 0, "France").otherwise(F.col("town")), share, F.lit("60"), method))
    )
    return t("doc_lines").select("doc", "line", text.alias("text"))


COUNTRIES = {"FRANCE": "france", "GERMANY": "country", "JAPAN": "country", "BRAZIL": "country", "CANADA": "country", "CHINA": "country", "EGYPT": "country", "EUROPE": "zone", "ASIA": "zone"}


@query(sql.TABLE_ROWS)
def doc_table_rows(spark, t):
    return tables.table_rows(_table_lines(t), COUNTRIES)


@query(sql.TOWN_CANDIDATES)
def doc_town_candidates(spark, t):
    before = F.when(F.col("line") % 3 == 0, F.array(F.lit("Compagnie"), F.lit("Nord et"))).otherwise(F.array().cast("array<string>"))
    found = t("doc_lines").select("doc", "line", F.posexplode(tables.town_candidates(F.concat_ws(" ", "name", "town"), before)).alias("place", "c"))
    return found.select("doc", "line", "place", "c.*")


@query(sql.ACRONYMS)
def doc_acronyms(spark, t):
    w = F.split("name", " ")
    first = F.concat_ws("", *[F.substring(F.get(w, F.lit(i)), 1, 1) for i in (0, 1)], F.when(F.col("line") % 5 == 0, "X").otherwise("Z"))
    both = F.when(F.col("line") % 2 == 0, F.concat("name", F.lit(" - "), F.upper(first))).otherwise(F.concat(F.upper(first), F.lit(" – de la "), "name"))
    found = t("doc_lines").select("doc", "line", tables.acronym_sides(both).alias("s"))
    return found.select("doc", "line", F.get("s", F.lit(0)).alias("name"), F.get("s", F.lit(1)).alias("acronym"))


# --- probes, warnings, dates, order


@query(sql.PROBED)
def cdc_probe(spark, t):
    units, batch = t("legal_units", "batch_units")
    sample = cut(changes.drawn(batch, ["000000003", "000000050", "000000077", "000000400", "999999999"]))
    return changes.present(sample, legal.merge_units(units, sample))


@query(sql.WARNED)
def group_warnings(spark, t):
    links, companies = t("links", "companies")
    return maps.warnings_of(companies.where("siren = '000000000'"), changes.data_date(links, companies), "2026-01-15")


@query(sql.LISTED_BY_GROUP)
def assign_listed_by_group(spark, t):
    rows, groups = _document_rows(t)
    return maps.listed_by_group(rows, t("legal_units").where("cj is not null"), groups.where("parent is null"))


@query(sql.DATES)
def name_dates(spark, t):
    at = F.col("updated").cast("timestamp")
    return t("records").select("siren", names.shown_date(at).alias("shown"), names.paris_day(at).cast("string").alias("day"))


@query(sql.SORTED)
def name_sort_key(spark, t):
    return t("offices").select("siren", names.sort_key(F.concat_ws(" ", "name", "address_key")).alias("sort_key"))


@query(sql.DISTINCT_NAMES)
def name_ordered_distinct(spark, t):
    words = t("documents").select("doc_id", F.array_distinct(F.split(names.norm(F.col("text")), " ")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n"), F.array_join(F.slice("w", 1, 20), " ").alias("first"))


# --- federations, judgements, rows of exports


@query(sql.OTHER_FEDERATIONS)
def assign_other_federations(spark, t):
    offices, links = t("offices", "links")
    return assign.other_federations(offices, links, tree.best_mothers(links, LOW_DEGREE), "000000022", "S%", ["000000041", "000000100"], ["OLD", "Les hot"], least=1)


@query(sql.SAME_JUDGEMENT)
def group_same_judgement(spark, t):
    offices, companies = t("offices", "companies")
    ours = rules.targetable(offices, companies)
    return serve.same_judgement(ours, rules.targetable(offices.withColumn("band", F.lit(None).cast("string")), companies.where("closed is null")))


@query(sql.ENTITY_TYPES)
def export_entity_types(spark, t):
    offices, companies = t("offices", "companies")
    head = F.lpad((F.floor(F.col("siren").cast("long") / 10) * 10).cast("string"), 9, "0")
    return rules.targetable(offices, companies).select("siren", serve.entity_type(F.col("siren"), head, F.col("reason")).alias("entity_type"))


@query(sql.RELATION_ROWS)
def export_relation_rows(spark, t):
    return serve.relation_rows(_document_rows(t)[0])


@query(sql.BRAND_ENTITIES)
def export_brand_entities(spark, t):
    heads = t("offices").where("siren < '000000300'").select("siren", "name")
    return serve.brand_entities(["red widget", "L'or", "hot rod", "nothing"], heads)
