"""Queries over the company register, each beside SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupforge.functions import names
from groupforge.operators import assign, changes, closure, growth, legal, match, rules, serve, tree
from groupforge.plans import map_sql
from groupforge.plans import register_sql as sql
from groupforge.plans.storage import Release, cut, shared_folder, ship, shuffled
from groupforge.sources import html, lists, records, register
from groupforge.streaming import deliveries

HEAD, DAY, LOW_DEGREE = "000000000", "2026-01-15", 15
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(text: str | None):
    def add(f):
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(spark, lambda *n: _tables(spark, sf_dir, *n)), text)
        return f

    return add


def _tables(spark: SparkSession, sf_dir: str, *wanted: str):
    ship(spark)
    found = register.load(spark, sf_dir, tuple(n for n in wanted if n in register.VIEWS))
    out = [found[n] if n in found else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in wanted]
    return out if len(out) > 1 else out[0]


def queries() -> dict:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in QUERIES.items() if text}


def ultimate_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, offices, companies = _tables(spark, sf_dir, "links", "offices", "companies")
    return tree.tree(links, LOW_DEGREE).join(rules.targetable(offices, companies).withColumnRenamed("siren", "child"), "child", "left")


def _group(links: DataFrame) -> DataFrame:
    """siren of the group below HEAD by open strong mandates."""
    strong = tree.open_links(links).where(F.col("role").isin(list(rules.STRONG)))
    seeds = links.sparkSession.createDataFrame([(HEAD, HEAD)], "start string, node string")
    return closure.closure(strong.select("parent", "child").distinct(), seeds).select(F.col("node").alias("siren"))


# --- register


@query(sql.LATEST)
def reg_latest_record(spark, t):
    return changes.latest(t("records"), "siren", "updated", "denomination").select("siren", "denomination", "commercial", "staff")


@query(sql.LOAD_LINKS)
def reg_load_links(spark, t):
    return t("links").select("parent", "child", "role", F.col("closed").isNull().alias("is_open"))


@query(sql.LEGAL_UNITS)
def reg_legal_units(spark, t):
    return t("legal_units").where("cj is not null and cj not between 1000 and 1999").select("siren", "denomination", "cj", "state")


@query(sql.OFFICE_ADDRESS)
def reg_office_address(spark, t):
    offices, units = t("offices", "legal_units")
    met = offices.join(units.select("siren", "denomination"), "siren")
    key = names.address_key(F.col("address_key"), names.unmasked(F.col("postcode")), F.col("town"))
    return met.select("siren", key.alias("address"), names.department(F.col("postcode")).alias("department"), names.unmasked(F.col("address_key")).alias("known"))


@query(sql.ENRICH)
def reg_company_enrichment(spark, t):
    companies, units = t("companies", "legal_units")
    met = companies.join(units.select("siren", F.col("denomination").alias("legal_name"), "cj"), "siren", "left")
    return met.select("siren", F.coalesce("legal_name", "denomination").alias("name"), "cj", (~F.col("commercial")).alias("opposed"))


@query(sql.COUNTS)
def reg_load_counts(spark, t):
    links, companies, persons, units, offices = t("links", "companies", "persons", "legal_units", "offices")
    a = links.agg(F.count("*").alias("links"), F.count_if(F.col("closed").isNull()).alias("open_links"))
    b = companies.agg(F.count("*").alias("companies"), F.count_if("hidden").alias("hidden"))
    c = persons.agg(F.count("*").alias("seats"), F.count_distinct("person").alias("persons"))
    d = units.agg(F.count("*").alias("units"), F.count_if(F.col("state") == "A").alias("active_units"))
    e = offices.agg(F.count("*").alias("offices"))
    metrics = [x.unpivot([], [F.col(k).cast("long").alias(k) for k in x.columns], "metric", "value") for x in (a, b, c, d, e)]
    out = metrics[0]
    for m in metrics[1:]:
        out = out.unionByName(m)
    return out


@query(sql.DATA_DATE)
def reg_data_date(spark, t):
    return changes.data_date(*t("links", "companies")).select(F.col("data_date").cast("string").alias("data_date"))


# --- trees


@query(sql.BEST_MOTHER)
def tree_best_mother(spark, t):
    return tree.best_mothers(t("links"), LOW_DEGREE)


@query(sql.ROOTS)
def tree_roots(spark, t):
    return tree.tree(t("links"), LOW_DEGREE).select("child", "root", "depth", "loop")


@query(sql.SIZES)
def tree_sizes(spark, t):
    return tree.sizes(tree.tree(t("links"), LOW_DEGREE))


@query(sql.ROOT_CHANGES)
def tree_root_changes(spark, t):
    links = t("links")
    after = tree.tree(links, LOW_DEGREE)
    before = tree.tree(links.withColumn("closed", F.lit(None).cast("date")), 4 * LOW_DEGREE)
    return tree.root_changes(before, after)


# --- rules


@query(sql.TARGETABLE)
def rule_targetable(spark, t):
    return rules.targetable(*t("offices", "companies"))


@query(sql.SHARED_ADDRESS)
def rule_shared_address(spark, t):
    links, offices = t("links", "offices")
    alike = tree.open_links(links).where(F.col("role") == "73").select(F.col("child").alias("siren"))
    return rules.shared_addresses(offices, _group(links), alike)


@query(sql.COMMON_DIRECTORS)
def rule_common_directors(spark, t):
    links, persons = t("links", "persons")
    return rules.common_directors(persons, _group(links))


def _brands(t) -> DataFrame:
    found = t("brands").select(names.norm(F.col("brand")).alias("brand"), "kind", F.col("brand").alias("seq"))
    return found.groupBy("brand").agg(F.min("kind").alias("kind"), F.min("seq").alias("seq"))


def _hits(t) -> DataFrame:
    return match.brand_hits(t("offices").select("siren", names.norm(F.col("name")).alias("name")), _brands(t))


def _listed(t) -> DataFrame:
    lines = t("doc_lines").where(F.col("doc") == HEAD)
    return lines.select(F.lpad((F.col("line") * 3).cast("string"), 9, "0").alias("siren"), match.controlled().alias("controlled"))


@query(sql.ENTRY_REASON)
def rule_entry_reason(spark, t):
    offices, companies, links, persons = t("offices", "companies", "links", "persons")
    wide = rules.evidence_rows(offices, companies, links, persons, _group(links), _hits(t), _listed(t))
    return wide.select("siren", rules.entry_reason().alias("reason"))


@query(sql.IN_FORCE)
def decisions_in_force(spark, t):
    return rules.in_force(t("decisions"))


@query(map_sql.FIXPOINT)
def group_fixpoint(spark, t):
    offices, companies, links, persons = t("offices", "companies", "links", "persons")
    return rules.expand(offices, companies, links, persons, HEAD, _hits(t), _listed(t), rules.in_force(t("decisions")))


@query(map_sql.FIXPOINT_IN_TURN)
def group_fixpoint_in_turn(spark, t):
    offices, companies, links, persons = t("offices", "companies", "links", "persons")
    return growth.expand_in_turn(offices, companies, links, persons, HEAD, _hits(t), _listed(t), rules.in_force(t("decisions")))


@query(map_sql.GROUPS_GROWN)
def country_groups_grown(spark, t):
    """Groups of all documents' heads, grown together; a head without an active office is a failure."""
    offices, companies, links, persons = t("offices", "companies", "links", "persons")
    heads = t("doc_lines").select(F.col("doc").alias("siren")).distinct()
    heads = cut(heads.unionByName(heads.limit(1).select(F.lit(map_sql.NO_OFFICE).alias("siren"))).select(F.col("siren").alias("grp"), "siren"))
    brands = _hits(t).join(heads.select("grp"), F.length("brand") % 5 == F.col("grp").cast("int"))
    lines = t("doc_lines").select(F.col("doc").alias("grp"), F.lpad((F.col("line") * 3).cast("string"), 9, "0").alias("siren"), match.controlled().alias("controlled"))
    decided = rules.in_force(t("decisions")).join(F.broadcast(heads.select("grp")))
    settings = growth.setting_rows(spark, {map_sql.GROUP_HEADS[0]: map_sql.MAP_SETTINGS})
    register = growth.Register(offices, companies, links, persons)
    with shuffled(spark):
        brands = cut(brands)
    grown = growth.grow(register, offices, heads, brands, lines, decided, settings)
    register.drop()
    failed = grown.failures.select("grp", F.lit(None).cast("string").alias("siren"), F.col("failure").alias("reason"), F.lit(None).cast("int").alias("round"))
    return grown.kept.unionByName(failed)


def _reasoned(links: DataFrame) -> DataFrame:
    return _group(links).withColumn("reason", F.lit("mandat fort au registre"))


@query(sql.PARENT_CHOICE)
def group_parent_choice(spark, t):
    links = t("links")
    return rules.parent_choice(links, _reasoned(links), HEAD)


@query(sql.CASES)
def group_cases(spark, t):
    links = t("links")
    kept = cut(_reasoned(links))
    return rules.doubtful(links, kept, rules.parent_choice(links, kept, HEAD))


@query(sql.EFFECT)
def group_effect(spark, t):
    links, decisions = t("links", "decisions")
    plain, force = _group(links), cut(rules.in_force(decisions))
    added = force.where("decision = 'retenir'").join(plain, "siren", "left_anti")
    removed = plain.join(force.where("decision = 'ecarter'"), "siren", "left_semi")
    return added.select("siren", F.lit("added").alias("effect")).unionByName(removed.select("siren", F.lit("removed").alias("effect")))


# --- names


@query(sql.NORM_KEY)
def name_norm_key(spark, t):
    n = F.col("name")
    return t("offices").select("siren", names.norm(n).alias("norm"), names.key(n).alias("key"), names.compact(names.key(n)).alias("compact"))


@query(sql.NORM_TEXT)
def name_norm_arrow(spark, t):
    return t("documents").select("doc_id", names.norm_arrow(F.col("text")).alias("norm"))


@query(sql.NORM_TEXT)
def name_norm_documents(spark, t):
    return t("documents").select("doc_id", names.norm(F.col("text")).alias("norm"))


@query(sql.BRAND_SEARCH)
def brand_prefix_search(spark, t):
    return _hits(t)


@query(sql.BRAND_HOMONYMS)
def brand_homonyms(spark, t):
    inside = _group(t("links")).withColumn("inside", F.lit(True))
    met = _hits(t).join(inside, "siren", "left")
    return met.groupBy("brand").agg(F.count_if("inside").alias("in_group"), F.count_if(F.col("inside").isNull()).alias("outside"))


@query(sql.TEXT_FUNCTIONS)
def name_text_functions(spark, t):
    rate = F.col("rate") + F.lit(0.5)
    cell = F.concat(F.when(F.col("line") % 3 == 0, "=").otherwise(""), F.col("name"))
    return t("doc_lines").select(
        "doc", "line", names.rate_text(rate).alias("rate_text"), names.percentage(names.rate_text(rate)).alias("rate"), names.grouped_siren(F.col("doc")).alias("shown"),
        names.safe_cell(cell).alias("cell"), names.unmasked(F.when(F.col("line") % 4 == 0, "[ND]").otherwise(F.col("town"))).alias("town"),
    )


# --- matching


def _lines(t) -> DataFrame:
    lines = t("doc_lines")
    full = lines.select("doc", "line", F.lit(0).alias("position"), "name", "town", "needs_town", F.lit(False).alias("fallback"), F.lit(False).alias("acronym"), "method", "rate")
    short = lines.select("doc", "line", F.lit(1).alias("position"), F.concat(F.col("name"), F.lit(" SAS")).alias("name"), "town", F.lit(False).alias("needs_town"), F.lit(True).alias("fallback"), F.lit(False).alias("acronym"), "method", "rate")
    return full.unionByName(short.join(lines.where("fallback").select("doc", "line"), ["doc", "line"], "left_semi"))


def _named(t):
    units, offices = t("legal_units", "offices")
    table = cut(match.carriers(units, offices))
    lines = cut(_lines(t))
    return lines, table, cut(match.by_name(lines, table))


@query(sql.CARRIERS)
def match_carriers(spark, t):
    return match.carriers(*t("legal_units", "offices"))


@query(sql.MATCH_NAME)
def match_unique_name(spark, t):
    return _named(t)[2].select("doc", "line", "reason", "siren", "carriers")


@query(sql.MATCH_CONFLICT)
def match_conflict(spark, t):
    return match.conflicts(_named(t)[2]).select("doc", "line", "reason", "siren")


@query(sql.MATCH_REGISTER)
def match_register(spark, t):
    lines, table, found = _named(t)
    return match.by_register(lines, cut(match.conflicts(found)), table, t("links")).select("doc", "line", "reason", "siren")


@query(None)
def match_last_resort(spark, t):
    lines, table, found = _named(t)
    found = cut(match.by_register(lines, cut(match.conflicts(found)), table, t("links")))
    return match.last_resort(lines, found, table, t("links"), t("legal_units")).select("doc", "line", "reason", "siren")


@query(sql.REASONS)
def match_reasons(spark, t):
    found = match.conflicts(_named(t)[2])
    return found.groupBy("reason").agg(F.count("*").alias("n"))


# --- graphs


@query(sql.CLOSURE)
def graph_closure(spark, t):
    links, lines = t("links", "doc_lines")
    edges = tree.open_links(links).where(F.col("role").isin(match.DESCENT_ROLES)).select("parent", "child").distinct()
    return closure.closure(edges, lines.select(F.col("doc").alias("start"), F.col("doc").alias("node")).distinct())


@query(sql.DESCENT)
def graph_descent(spark, t):
    links, lines = t("links", "doc_lines")
    edges = tree.open_links(links).where("role = '73'").select("parent", "child").distinct()
    return closure.descent(edges, lines.select(F.col("doc").alias("start"), F.col("doc").alias("node")).distinct()).select("start", "node", F.col("level").cast("long").alias("level"))


def _forest(t) -> DataFrame:
    """node, parent over companies, without loops: the smallest company of a loop loses its mother."""
    mothers = tree.opened(cut(tree.best_mothers(t("links"), LOW_DEGREE)))
    return t("companies").select(F.col("siren").alias("child")).join(mothers, "child", "left").select(F.col("child").alias("node"), F.col("mother").alias("parent"))


@query(sql.ASCENT)
def graph_ascent(spark, t):
    return closure.ascent(_forest(t)).select("node", "top", F.col("steps").cast("long").alias("steps"))


@query(sql.GROUP_SIZE)
def graph_group_size(spark, t):
    forest = cut(_forest(t))
    return closure.nested_sizes(forest, t("companies").select(F.col("siren").alias("node"), F.coalesce("staff", F.lit(0)).alias("size")))


@query(sql.NEAREST)
def graph_nearest_targetable(spark, t):
    good = rules.targetable(*t("offices", "companies")).where("targetable").select(F.col("siren").alias("node"))
    return closure.nearest(_forest(t), good).select("node", "found")


# --- changes


@query(sql.MERGE)
def cdc_company_merge(spark, t):
    out = changes.merge_companies(*t("companies", "batch_companies"), DAY)
    return out.select("siren", "denomination", "commercial", "staff", F.col("opened").cast("string").alias("opened"), F.col("closed").cast("string").alias("closed"), "change")


@query(sql.LINK_DIFF)
def cdc_link_diff(spark, t):
    links, batch = t("links", "batch_links")
    out = changes.merge_edges(links, batch, batch.where("role = '73'"), DAY)
    return out.select("parent", "child", "role", F.col("closed").cast("string").alias("closed"), "change")


@query(sql.DIRECTOR_DIFF)
def cdc_director_diff(spark, t):
    """Seats after the full state of every other company came, in which some roles are missing; persons are met by their keys and only counted."""
    seats = t("persons").withColumn("opened", F.lit("2000-01-01").cast("date"))
    covered = t("companies").where(F.substring("siren", 9, 1) < "5").select("siren")
    state = seats.where("closed is null and role <> '51'").join(covered, "siren", "left_semi").select("siren", "person", F.nullif("role", F.lit("73")).alias("role")).distinct()
    out = changes.merge_edges(seats, state, covered, DAY, "siren", ("siren", "person", "role"))
    return out.groupBy("siren", "role", F.col("closed").cast("string").alias("closed"), "change").agg(F.count("*").alias("n"))


@query(sql.MASKED)
def cdc_masked_policy(spark, t):
    units, companies = t("legal_units", "companies")
    batch = companies.select("siren", F.coalesce("hidden", F.lit(False)).alias("hidden"), F.when(F.col("staff") > 6, F.lit("XX")).alias("acronym"), F.when(F.col("staff") > 12, F.lit("Nouvelle")).alias("usual_name"), F.when(F.col("staff") > 9, F.col("denomination")).alias("denomination"))
    return changes.masked(units.select("siren", "acronym", "usual_name", "denomination"), batch, ("acronym", "usual_name"), ("denomination",))


@query(sql.DRY_RUN)
def cdc_dry_run(spark, t):
    return changes.tally(changes.merge_companies(*t("companies", "batch_companies"), DAY))


@query(sql.STREAM)
def cdc_stream_batches(spark, t):
    out = deliveries.replayed(spark, *t("companies", "batch_companies"), DAY)
    return out.select("siren", "denomination", "commercial", "staff", F.col("closed").cast("string").alias("closed"))


# --- assignment


def _claims(t):
    lines, links = t("doc_lines", "links")
    listed = lines.select(F.col("doc").alias("head"), F.lpad((F.col("line") * 7 % 40).cast("string"), 9, "0").alias("siren"), F.lit("inscription").alias("manner"), "rate", F.lit(None).cast("int").alias("level"))
    edges = tree.open_links(links).where("role = '73'").select("parent", "child").distinct()
    down = closure.descent(edges, lines.select(F.col("doc").alias("start"), F.col("doc").alias("node")).distinct())
    down = down.select(F.col("start").alias("head"), F.col("node").alias("siren"), F.lit("descente").alias("manner"), F.lit(None).cast("double").alias("rate"), "level")
    trees = tree.best_mothers(links, LOW_DEGREE).select(F.col("mother").alias("head"), F.col("child").alias("siren"), F.lit("arbre").alias("manner"), F.lit(None).cast("double").alias("rate"), F.lit(None).cast("int").alias("level"))
    claims = cut(listed.unionByName(down).unionByName(trees))
    sizes = claims.groupBy("head").agg(F.count_distinct("siren").alias("size"))
    nested = F.when(F.col("head") == "000000001", "000000000").when(F.col("head") == "000000003", "000000001")
    return claims, cut(sizes.select("head", nested.alias("parent"), "size"))


@query(sql.ARBITRATION)
def assign_arbitration(spark, t):
    return assign.arbitrate(*_claims(t))


@query(sql.GROUP_PARENTS)
def assign_group_parents(spark, t):
    lines = t("doc_lines")
    pairs = lines.select(F.col("doc").alias("a"), F.lpad((F.col("line") * 3 % 5).cast("string"), 9, "0").alias("b"), "method").where("method = 'MEE'")
    return assign.group_parents(pairs.select("a", "b").distinct())


@query(sql.BANKS)
def assign_mutual_banks(spark, t):
    offices, links = t("offices", "links")
    return assign.mutual_banks(offices, links, "000000022", "S%", least=1, refused=("17", "85"))


def _tree_groups(t) -> DataFrame:
    links, offices, companies = t("links", "offices", "companies")
    taken = t("doc_lines").select(F.lpad(F.col("line").cast("string"), 9, "0").alias("siren"))
    return assign.tree_groups(tree.best_mothers(links, LOW_DEGREE), offices, companies, taken)


@query(sql.TREE_GROUPS)
def assign_tree_groups(spark, t):
    return _tree_groups(t)


@query(sql.GROUP_SIZES)
def assign_group_sizes(spark, t):
    return _tree_groups(t).groupBy("head").agg(F.count("*").alias("size"))


@query(sql.COVERAGE)
def assign_coverage(spark, t):
    return assign.coverage(_tree_groups(t), t("legal_units").where("cj is not null"))


# --- serving


@query(sql.SEARCH)
def search_ranked(spark, t):
    companies, units, offices = t("companies", "legal_units", "offices")
    return serve.search(companies, units, offices, "SOCIETE COLD")


@query(sql.EXPORT_COMPANIES)
def export_companies(spark, t):
    return serve.export_companies(_tree_groups(t), t("offices"))


@query(sql.EXPORT_LINKS)
def export_relationships(spark, t):
    return serve.export_links(_tree_groups(t), t("links"))


@query(sql.EXPORT_COVERAGE)
def export_coverage(spark, t):
    return serve.export_coverage(_tree_groups(t), t("links"), t("offices"))


@query(sql.VALIDATION)
def export_validation(spark, t):
    links, companies = t("links", "companies")
    relations = links.select("parent", "child", F.when(F.col("role") != "71", rules.label(F.col("role"))).alias("proof"))
    return serve.validate(companies.where("closed is null"), relations)


@query(sql.PRIMARY)
def crm_primary_parent(spark, t):
    links = tree.open_links(t("links")).groupBy("child", "parent").agg(F.count("*").alias("n"), F.max("opened").alias("opened"))
    holdings = links.select("child", "parent", F.when(F.col("n") > 1, F.col("n") * 26.0).alias("control"), (F.day("opened") * 3.0).alias("owned"))
    return serve.primary_parents(holdings)


@query(sql.LEVELS)
def crm_levels(spark, t):
    return serve.import_levels(tree.open_links(t("links")).where("role = '73'"))


@query(sql.OUTLINE)
def tree_outline(spark, t):
    return serve.outline(_tree_groups(t))


@query(sql.LIFTED)
def crm_lifted_parents(spark, t):
    edges = tree.open_links(t("links")).where("role = '73'").groupBy("parent", "child").agg(F.max(F.day("opened") * F.lit(2.0)).alias("share"))
    return serve.lifted_ways(edges, t("offices").where("cj is not null").select("siren"))


@query(sql.COMPARE)
def group_recall(spark, t):
    links = t("links")
    return serve.compare(tree.best_mothers(links, LOW_DEGREE).select(F.col("child").alias("siren"), "mother"), tree.best_mothers(links, 4 * LOW_DEGREE).select(F.col("child").alias("siren"), "mother").where("siren <> mother"))


@query(sql.RECORD_KEY)
def crm_record_key(spark, t):
    siret = F.when(F.col("naf") != "64.20Z", F.col("siret"))
    return t("offices").select("siren", serve.record_key(siret, F.when(F.col("cj").isNotNull(), F.col("siren")), F.concat(F.lit("own-"), "siren")).alias("record_key"))


@query(sql.CHART_HEADS)
def rule_chart_heads(spark, t):
    return rules.chart_heads(t("offices"), _brands(t).select(F.col("brand").alias("house")))


@query(sql.LISTED)
def match_listed(spark, t):
    return rules.listed(_named(t)[2].join(t("doc_lines").select("doc", "line", "method", "rate"), ["doc", "line"]))


@query(sql.DEPOSIT)
def cdc_deposit(spark, t):
    lines = t("doc_lines")
    registry = lines.groupBy(F.col("doc").alias("head")).agg(F.sha2(F.max("name"), 256).alias("sha256")).select("head", "sha256", F.lit("2025-01-01").cast("timestamp").alias("since"), F.lit(None).cast("timestamp").alias("until"))
    new = lines.groupBy(F.col("doc").alias("head")).agg(F.sha2(F.max(F.when(F.col("doc") < "000000002", F.concat("name", F.lit("!"))).otherwise(F.col("name"))), 256).alias("sha256"))
    out = changes.deposit(registry, new, "2026-01-15 00:00:00")
    return out.select("head", "sha256", F.col("since").cast("date").cast("string").alias("since"), F.col("until").cast("date").cast("string").alias("until"), "change")


@query(sql.FRESH)
def cdc_freshness(spark, t):
    sources = t("links").select(F.col("role").alias("source"), F.col("opened").alias("day")).unionByName(t("companies").select(F.col("state").alias("source"), F.col("opened").alias("day")))
    return changes.fresh(sources, "1998-08-05").select("source", F.col("day").cast("string").alias("day"), "age", "fresh")


def _formality_json(t) -> DataFrame:
    """Records as the feed brings them, from the register's own tables."""
    powers = tree.open_links(t("links")).groupBy(F.col("child").alias("siren")).agg(F.sort_array(F.collect_list(F.struct(F.lit("ENTREPRISE").alias("typeDePersonne"), F.col("role").alias("roleEntreprise"), F.struct(F.col("parent").alias("siren")).alias("entreprise")))).alias("pouvoirs"))
    met = t("companies").join(powers, "siren", "left")
    legal = F.struct(F.struct(F.struct("siren", "denomination", F.col("staff").alias("nombreSalarie")).alias("entreprise")).alias("identite"), F.when(F.col("closed").isNotNull(), F.struct(F.col("closed").alias("dateRadiation"))).alias("detailCessationEntreprise"), F.struct("pouvoirs").alias("composition"))
    formality = F.struct("siren", F.col("commercial").alias("diffusionCommerciale"), F.struct(legal.alias("personneMorale")).alias("content"))
    text = F.to_json(F.struct("siren", formality.alias("formality")))
    return met.select(F.when(F.col("state") == "C", F.substring(text, 1, 40)).otherwise(text).alias("json"))


@query(sql.FORMALITY)
def reg_formalities(spark, t):
    found = records.formalities(_formality_json(t)).where("valid")
    return found.select("siren", "denomination", "commercial", "staff", "struck", F.size("edges").cast("long").alias("edges"))


@query(sql.PERIODS)
def reg_current_period(spark, t):
    periods = t("links").groupBy(F.col("child").alias("siren")).agg(F.sort_array(F.collect_list(F.struct(F.col("opened").alias("began"), F.col("closed").alias("ended"), "role", "parent"))).alias("periods"))
    now = records.current_period(F.col("periods"))
    return periods.select("siren", now["began"].cast("string").alias("began"), now["ended"].cast("string").alias("ended"), now["role"].alias("role"))


# --- documents


@query(None)
def html_text_blocks(spark, t):
    return html.text_blocks(t("pages"))


def _document_lines(t) -> DataFrame:
    """The published lines in each of the formats; methods that a format can't write make no line of it."""
    words = F.create_map(*[F.lit(x) for k, v in (("IG", "Intégration globale"), ("MEE", "Mise en équivalence"), ("NC", "Opération conjointe")) for x in (k, v)])[F.col("method")]
    short = F.when(F.col("method") == "NC", "JV").when(F.col("method") != "inconnue", F.col("method"))
    rate = F.regexp_replace(F.format_string("%.2f", F.col("rate") + F.lit(0.25)), r"\.", ",")
    return t("doc_lines").select(
        "doc", "line", F.concat_ws(" ", "name", F.lit("France"), rate, F.coalesce(words, F.lit("?"))).alias("text"), F.concat_ws(" | ", "name", F.lit("France"), F.concat(rate, F.lit(" %"))).alias("row"),
        F.concat("name", F.lit(" "), "town", F.lit(", France "), F.coalesce(short, F.lit("?")), F.lit(" "), rate, F.lit(" %")).alias("towned"), F.concat("name", F.lit(", France "), rate, F.lit(" %")).alias("bare"),
        F.concat_ws(" | ", "name", F.lit("France"), F.lit("99"), rate, F.coalesce(short, F.lit("?")), F.lit("98")).alias("report"),
    )


@query(sql.RATE_LINES)
def doc_line_rates(spark, t):
    return _document_lines(t).select("doc", "line", *[v.alias(k) for k, v in lists.rate_line(F.col("text")).items()])


@query(sql.TOWN_LINES)
def doc_line_towns(spark, t):
    return _document_lines(t).select("doc", "line", *[v.alias(k) for k, v in lists.town_line(lists.clean(F.col("towned"))).items()])


@query(sql.BARE_LINES)
def doc_line_unconsolidated(spark, t):
    return _document_lines(t).select("doc", "line", *[v.alias(k) for k, v in lists.bare_line(F.col("bare")).items()])


@query(sql.REPORT_ROWS)
def doc_line_report(spark, t):
    return _document_lines(t).select("doc", "line", *[v.alias(k) for k, v in lists.report_row(F.col("report")).items()])


@query(sql.TABLE_LINES)
def doc_line_table(spark, t):
    return _document_lines(t).select("doc", "line", *[v.alias(k) for k, v in lists.table_line(F.col("row")).items()])


@query(sql.DOCUMENTS)
def doc_whole_lists(spark, t):
    texts = _document_lines(t).groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return lists.documents(texts).groupBy("doc", "method").agg(F.count("*").alias("n"), F.round(F.sum("rate"), 4).alias("rates"))


@query(sql.CONTROLLED)
def doc_controlled(spark, t):
    return t("doc_lines").select("doc", "line", match.controlled().alias("controlled"), F.col("name").rlike(names.FUNDS).alias("fund"))


# --- deliveries of legal units and offices


@query(sql.LAST_OF_BATCH)
def cdc_last_of_batch(spark, t):
    return changes.last_of_batch(t("batch_units"), "siren", ("denomination", "state"))


@query(sql.STATUS_MERGE)
def cdc_status_merge(spark, t):
    out = legal.merge_status(*t("companies", "batch_units"), DAY)
    return out.select("siren", "denomination", "hidden", "state", F.col("opened").cast("string").alias("opened"), F.col("closed").cast("string").alias("closed"), "change")


@query(sql.UNIT_MERGE)
def cdc_unit_merge(spark, t):
    return legal.merge_units(*t("legal_units", "batch_units"))


@query(sql.OFFICE_MERGE)
def cdc_office_merge(spark, t):
    return legal.merge_offices(*t("offices", "batch_offices")).select("siren", "siret", "name", "band", "town", "change")


@query(sql.RELEASE)
def cdc_release(spark, t):
    """Units and offices after their deliveries, committed as one and read back."""
    release = Release(spark, f"{shared_folder(spark)}/release-{uuid.uuid4().hex}")
    units, offices, new_units, new_offices = t("legal_units", "offices", "batch_units", "batch_offices")
    first = release.commit({"units": units.select("siren", *legal.FOLLOWS, *legal.KEEPS), "offices": offices.select("siren", *legal.OFFICE)}, 0)
    legal.deliver(release, new_units, new_offices, first)
    units, offices = release.read("units"), release.read("offices")
    return units.select("siren", F.lit("units").alias("part"), F.col("denomination").alias("name"), "band").unionByName(offices.select("siren", F.lit("offices").alias("part"), "name", "band"))


@query(sql.STALE)
def cdc_recompute_guard(spark, t):
    return changes.stale(t("journal"), "arbre", "liens")


@query(sql.SET_CHANGES)
def tree_mother_changes(spark, t):
    links = t("links")
    wide, narrow = (tree.best_mothers(links, n).select("child", "mother") for n in (4 * LOW_DEGREE, LOW_DEGREE))
    return changes.set_changes(wide, narrow)


# --- placing and reading


def _won(t) -> DataFrame:
    return cut(assign.arbitrate(*_claims(t)).select("siren", "head"))


@query(sql.LEVELS_WITHIN)
def assign_levels(spark, t):
    mothers = tree.best_mothers(t("links"), LOW_DEGREE).select(F.col("child").alias("siren"), "mother")
    return assign.levels_within(_won(t).join(mothers, "siren", "left")).select("siren", "head", "level")


@query(sql.NEAREST_KEPT)
def assign_nearest_kept(spark, t):
    return assign.nearest_kept(_won(t), tree.best_mothers(t("links"), LOW_DEGREE))


@query(sql.SEARCH_ID)
def search_by_number(spark, t):
    return serve.search(*t("companies", "legal_units", "offices"), "000 000 012")


@query(sql.SEARCH_GROUPS)
def search_groups(spark, t):
    hits = t("companies").where("staff >= 15").select("siren")
    return serve.groups_of(hits, cut(_tree_groups(t).select("siren", "head")), t("offices"))


@query(sql.LARGEST)
def export_largest_subsidiaries(spark, t):
    return serve.largest_subsidiaries(_tree_groups(t), t("offices"))


@query(sql.MAP_ORDER)
def export_order(spark, t):
    return serve.map_order(_tree_groups(t), t("offices"))


@query(sql.COMMON_WORDS)
def name_common_words(spark, t):
    words = t("offices").select(F.explode(F.split(names.norm(F.col("name")), " ")).alias("word"))
    return serve.most_common(words, "word")


@query(sql.EXCLUDED)
def rule_excluded_names(spark, t):
    return t("offices").select("siren", rules.excluded(F.col("name"), ["SARL", "les "]).alias("excluded"))


@query(sql.PROBE)
def reg_probe(spark, t):
    return t("legal_units").where("cj is not null and siren >= '000000077'").orderBy("siren").limit(1).select("siren", "cj")


@query(sql.UNNESTED)
def reg_parallel_unnest(spark, t):
    lists_ = t("doc_lines").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("line", "name"))).alias("l"))
    both = lists_.select("doc", F.arrays_zip(F.transform("l", lambda x: x["line"]).alias("line"), F.transform("l", lambda x: x["name"]).alias("name")).alias("z"))
    return both.select("doc", F.inline("z"))


from groupforge.plans import map_queries  # noqa: E402, F401  (they register themselves and use what is above)
