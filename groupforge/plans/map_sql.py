"""SQL for the maps of groups and of the country, beside `map_queries`."""

from __future__ import annotations

import re

from groupforge.operators.rules import DIRECTING, MEDIUM, PLAIN, STRONG, Settings
from groupforge.plans.register_sql import _BRANDS, _CONTROLLED, _LABELS, _TARGET, ACTIVE, ARBITRATION, IN_FORCE, UNIT_MERGE, _in, _values, mothers, norm, walked
from groupforge.sources.register import with_clause

MAP_SETTINGS = Settings(
    homonyms=("RED PLATE",), acronyms=("HOT RING", "NEW BOLT"), left_out=("000000033",), name_beginnings=("Les cold",), families=("P7", "P12"), houses=("BLUE WIDGET", "OLD GEAR"), priority=("000000005", "000000002"),
)
# --- maps: the fixpoint unrolled round by round; rounds after its end add nothing

ROUNDS = 14


def _brackets(values) -> str:
    return _in(values) if values else "('')"


def _beginnings(column: str, values) -> str:
    return "(" + " OR ".join([f"coalesce(starts_with(upper({column}), '{b.upper()}'), false)" for b in values] or ["false"]) + ")"


#: The first rule that lets a candidate in.
_RULE = """CASE WHEN barred OR cj LIKE '9%' OR cj LIKE '3%' OR controlled = false THEN NULL WHEN controlled THEN 'inscrite au périmètre publié du groupe' WHEN strong > 0 THEN 'mandat fort au registre'
        WHEN charted THEN 'tête de maison (organigramme public du groupe)' WHEN cj LIKE '62%' AND members >= 2 AND members_outside = 0 THEN 'GIE dont tous les membres sont du groupe'
        WHEN medium > 0 THEN CASE WHEN outside = 0 AND ((people AND directing) OR brand IS NOT NULL OR at_group) THEN 'mandat au registre et indice indépendant' END
        WHEN weak > 0 AND CAST(brand IS NOT NULL AS INT) + CAST(at_group AS INT) + CAST(people AS INT) >= 2 THEN 'mandat ''Autre'' et deux indices'
        WHEN sure AND NOT civil AND NOT risky AND NOT (tiny AND bare) THEN 'nom de marque propre au groupe' WHEN brand IS NOT NULL AND (people OR at_group) THEN 'nom de marque et second indice'
        WHEN at_group AND (people OR (common >= 1 AND NOT civil)) THEN 'adresse du groupe et second indice' END"""


def _round(n: int, s: Settings) -> str:
    """Evidence of every company as the group k{n} makes it: w{n}; and the reasons of those outside it: e{n}."""
    strong, medium = _in(STRONG), _in(MEDIUM)
    return f"""p{n} AS MATERIALIZED (
    SELECT s.siren, count(DISTINCT s.person) AS common, bool_or(s.role IN {_in(DIRECTING)}) AS directing, bool_or(h.n >= 2) AS manager
    FROM seats s JOIN (SELECT x.person, count(DISTINCT x.siren) AS n FROM seats x JOIN k{n} k ON k.siren = x.siren GROUP BY x.person) h ON h.person = s.person GROUP BY s.siren),
md{n} AS MATERIALIZED (
    SELECT child AS siren, count(*) FILTER (WHERE i AND role IN {strong}) AS strong, count(*) FILTER (WHERE i AND role IN {medium}) AS medium, count(*) FILTER (WHERE i AND role = '99') AS weak,
        count(*) FILTER (WHERE NOT i AND role IN {strong}) AS outside, count(*) FILTER (WHERE role = '11') AS members, count(*) FILTER (WHERE role = '11' AND NOT i) AS members_outside, bool_or(i) AS linked
    FROM (SELECT a.child, a.role, k.siren IS NOT NULL AS i FROM act a LEFT JOIN k{n} k ON k.siren = a.parent) GROUP BY child),
like{n} AS MATERIALIZED (
    SELECT siren FROM (SELECT siren FROM md{n} WHERE linked UNION SELECT siren FROM hits WHERE kind = 'sure' UNION SELECT siren FROM p{n} WHERE manager) WHERE siren NOT IN (SELECT siren FROM apart) UNION SELECT siren FROM k{n}),
spot{n} AS MATERIALIZED (
    SELECT o.address_key FROM off o LEFT JOIN k{n} k ON k.siren = o.siren LEFT JOIN like{n} l ON l.siren = o.siren WHERE o.address_key <> '[ND]' GROUP BY o.address_key
    HAVING count(k.siren) >= 2 AND count(l.siren) FILTER (WHERE o.cj NOT LIKE '9%') > 0 AND count(l.siren) FILTER (WHERE o.cj NOT LIKE '9%') >= 0.5 * count(*) FILTER (WHERE o.cj NOT LIKE '9%')),
w{n} AS MATERIALIZED (
    SELECT *, (common >= 2 OR (common >= 1 AND manager)) AND NOT (civil AND NOT sure) AS people FROM (
        SELECT o.*, coalesce(strong, 0) AS strong, coalesce(medium, 0) AS medium, coalesce(weak, 0) AS weak, coalesce(outside, 0) AS outside, coalesce(members, 0) AS members, coalesce(members_outside, 0) AS members_outside,
            coalesce(linked, false) AS linked, coalesce(common, 0) AS common, coalesce(directing, false) AS directing, coalesce(manager, false) AS manager, s.address_key IS NOT NULL AS at_group
        FROM off o LEFT JOIN md{n} m ON m.siren = o.siren LEFT JOIN p{n} p ON p.siren = o.siren LEFT JOIN spot{n} s ON s.address_key = o.address_key)
    WHERE (linked OR brand IS NOT NULL OR at_group OR charted OR controlled IS NOT NULL) AND siren NOT IN {_brackets(s.left_out)}),
e{n} AS MATERIALIZED (
    SELECT w.siren, {_RULE} AS rule
    FROM w{n} w LEFT JOIN k{n} k ON k.siren = w.siren WHERE k.siren IS NULL)"""


def _at_once(n: int, s: Settings) -> str:
    return f"""{_round(n, s)},
k{n + 1} AS MATERIALIZED (
    SELECT * FROM k{n} UNION ALL SELECT siren, reason, {n + 1} FROM (
        SELECT e.siren, CASE f.decision WHEN 'ecarter' THEN NULL WHEN 'retenir' THEN coalesce(rule, 'retenue par décision du consultant') ELSE rule END AS reason FROM e{n} e LEFT JOIN force f ON f.siren = e.siren)
    WHERE reason IS NOT NULL)"""


#: How often a round is judged again in the SQL of the order of judgement: at least its longest chain of candidates.
SETTLED = 8


def _in_turn(n: int, s: Settings) -> str:
    """A round whose candidates see those that enter before them: judged again until the longest chain of them is settled."""
    before = f"SELECT * FROM o{n - 1} UNION ALL" if n else ""
    fresh = f"AND w.siren NOT IN (SELECT siren FROM o{n - 1})" if n else ""
    strong, medium = _in(STRONG), _in(MEDIUM)
    text = f"""{_round(n, s)},
o{n} AS MATERIALIZED (
    {before} SELECT w.siren, row({n}, CASE WHEN brand IS NOT NULL THEN 0 WHEN controlled THEN 1 WHEN NOT controlled THEN 2 WHEN linked THEN 3 ELSE 4 END, CASE WHEN brand IS NOT NULL THEN -length(brand) ELSE 0 END, w.siren) AS ord
    FROM w{n} w LEFT JOIN k{n} k ON k.siren = w.siren WHERE k.siren IS NULL {fresh}),
v{n}_0 AS MATERIALIZED (SELECT NULL::VARCHAR AS siren, NULL::VARCHAR AS reason WHERE false)"""
    for j in range(SETTLED):
        text += f""",
v{n}_{j + 1} AS MATERIALIZED (
    SELECT r.siren, CASE f.decision WHEN 'ecarter' THEN NULL WHEN 'retenir' THEN coalesce(rule, 'retenue par décision du consultant') ELSE rule END AS reason FROM (
        SELECT w.siren, {_RULE} AS rule FROM (
            SELECT w.* REPLACE (w.strong + coalesce(x.strong, 0) AS strong, w.outside - coalesce(x.strong, 0) AS outside, w.medium + coalesce(x.medium, 0) AS medium, w.weak + coalesce(x.weak, 0) AS weak, w.members_outside - coalesce(x.members, 0) AS members_outside)
            FROM w{n} w LEFT JOIN k{n} k ON k.siren = w.siren LEFT JOIN (
                SELECT a.child, count(*) FILTER (WHERE role IN {strong}) AS strong, count(*) FILTER (WHERE role IN {medium}) AS medium, count(*) FILTER (WHERE role = '99') AS weak, count(*) FILTER (WHERE role = '11') AS members
                FROM act a JOIN v{n}_{j} e ON e.siren = a.parent AND e.reason IS NOT NULL JOIN o{n} p ON p.siren = a.parent JOIN o{n} c ON c.siren = a.child WHERE p.ord < c.ord GROUP BY a.child) x ON x.child = w.siren
            WHERE k.siren IS NULL) w) r LEFT JOIN force f ON f.siren = r.siren)"""
    return text + f""",
k{n + 1} AS MATERIALIZED (SELECT * FROM k{n} UNION ALL SELECT siren, reason, {n + 1} FROM v{n}_{SETTLED} WHERE reason IS NOT NULL)"""


def fixpoint(s: Settings, head: str = "000000000", own_brands: str = "", most: int = ROUNDS, one_round=_at_once) -> str:
    """CTEs up to k{most}: siren, reason, round. own_brands: a condition on the hits of brands that are the group's."""
    no_marks = "regexp_matches(n.name, '^(CSE|COMITE|AMICALE|ASSOCIATION)\\b')"
    rounds = ",\n".join(one_round(n, s) for n in range(most))
    text = with_clause("offices", "companies", "links", "persons", "brands", "doc_lines", "decisions", recursive=True) + f""",
{ACTIVE}, {_BRANDS},
force AS MATERIALIZED ({IN_FORCE[IN_FORCE.index("SELECT siren, decision"):]}),
seats AS MATERIALIZED (SELECT siren, person, role FROM persons WHERE closed IS NULL AND person NOT IN {_brackets(s.families)}),
listed AS (SELECT lpad(CAST(line * 3 AS VARCHAR), 9, '0') AS siren, bool_or({_CONTROLLED}) AS controlled FROM doc_lines WHERE doc = '{head}' GROUP BY 1),
eligible AS (
    SELECT siren, {norm('name')} AS n, CASE WHEN band = 'NN' THEN -1 ELSE try_cast(band AS INT) END AS size FROM offices
    WHERE cj IS NOT NULL AND NOT (CAST(cj AS VARCHAR) LIKE '6%' AND CAST(cj AS VARCHAR) NOT LIKE '62%') AND CAST(cj AS VARCHAR) NOT LIKE '9%' AND CAST(cj AS VARCHAR) NOT LIKE '3%'),
chart AS (
    SELECT h.house, e.siren FROM (SELECT unnest([{", ".join(f"'{h}'" for h in s.houses) or "''"}]) AS house) h JOIN eligible e ON h.house <> '' AND regexp_full_match(e.n, '((SOC|STE|SOCIETE|LES|LE|LA|L) )*' || h.house || '( .*)?')
    QUALIFY row_number() OVER (PARTITION BY h.house ORDER BY e.size DESC NULLS LAST, e.siren) = 1),
off AS MATERIALIZED (
    SELECT o.siren, o.name AS shown, n.name, o.address_key, coalesce(CAST(o.cj AS VARCHAR), '') AS cj, o.band, c.staff, h.brand, coalesce(h.kind = 'sure', false) AS sure, l.controlled, o.siren IN (SELECT siren FROM chart) AS charted,
        coalesce(CAST(o.cj AS VARCHAR), '') LIKE '6%' AND coalesce(CAST(o.cj AS VARCHAR), '') NOT LIKE '62%' AS civil, {_beginnings('o.name', s.name_beginnings)} AS named_out,
        named_out OR {no_marks} AS barred, len(string_split(n.name, ' ')) <= len(string_split(h.brand, ' ')) + 1 AS bare,
        sure AND (h.brand IN {_brackets(s.homonyms)} OR (h.brand IN {_brackets(s.acronyms)} AND bare)) AS risky, coalesce(o.band, '') IN ('', 'NN', '00') AND coalesce(c.staff, 0) = 0 AS tiny
    FROM offices o JOIN named n ON n.siren = o.siren LEFT JOIN companies c ON c.siren = o.siren LEFT JOIN hits h ON h.siren = o.siren LEFT JOIN listed l ON l.siren = o.siren),
apart AS MATERIALIZED (SELECT siren FROM off WHERE named_out UNION SELECT siren FROM force WHERE decision = 'ecarter' UNION SELECT siren FROM off WHERE siren IN {_brackets(s.left_out)}),
k0 AS MATERIALIZED (SELECT '{head}' AS siren, 'tête du groupe' AS reason, 0 AS round),
{rounds},
{_round(most, s)}"""
    if own_brands:
        at = text.index("force AS MATERIALIZED")
        text = text[:at] + f"own_hits AS MATERIALIZED (SELECT * FROM hits WHERE {own_brands}),\n" + re.sub(r"\bhits\b", "own_hits", text[at:])
    return text


_LAST, _WIDE = f"k{ROUNDS}", f"w{ROUNDS}"
_ORDERED = ("000000000", *MAP_SETTINGS.priority)
FIXPOINT = fixpoint(PLAIN) + f"\nSELECT siren, reason, round FROM {_LAST}"
FIXPOINT_IN_TURN = fixpoint(PLAIN, most=7, one_round=_in_turn) + "\nSELECT siren, reason, round FROM k7"
#: Groups of the documents that grow together, each with the brands whose length leaves its number; the last has no active office.
GROUP_HEADS = [f"{k:09d}" for k in range(5)]
NO_OFFICE = "000000007"
GROUPS_GROWN = "\nUNION ALL ".join(
    f"SELECT '{h}' AS grp, siren, reason, round FROM ({fixpoint(MAP_SETTINGS if k == 0 else PLAIN, h, f'length(brand) % 5 = {k}', 16)} SELECT siren, reason, round FROM k16)" for k, h in enumerate(GROUP_HEADS)
) + f"\nUNION ALL SELECT '{NO_OFFICE}', NULL, 'tête sans siège actif', NULL"
_MAP = fixpoint(MAP_SETTINGS) + f""",
gl AS MATERIALIZED (SELECT DISTINCT a.parent, a.child, a.role FROM act a JOIN {_LAST} k ON k.siren = a.parent),
{_TARGET},
house AS (
    SELECT h.brand, h.siren FROM hits h JOIN {_LAST} k ON k.siren = h.siren LEFT JOIN off o ON o.siren = h.siren
    QUALIFY row_number() OVER (PARTITION BY h.brand ORDER BY coalesce(o.staff, 0) DESC, coalesce(o.band, '') DESC, k.round, h.siren) = 1),
md AS (
    SELECT g.child, g.parent, g.role FROM gl g JOIN {_LAST} k ON k.siren = g.child
    QUALIFY row_number() OVER (PARTITION BY g.child ORDER BY CASE WHEN role IN {_in(STRONG)} THEN 0 WHEN role = '99' THEN 1 ELSE 2 END, CASE g.parent {" ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(_ORDERED))} ELSE 99 END, g.parent, g.role) = 1),
pick AS MATERIALIZED (
    SELECT k.siren, k.round, coalesce(m.parent, x.siren, '000000000') AS mother,
        CASE WHEN m.parent IS NOT NULL THEN 'Mandat au registre : ' || coalesce(n.label, m.role) WHEN x.siren IS NOT NULL THEN 'Déduit : même maison (' || x.brand || ')' ELSE 'Déduit : rattachée à la tête du groupe' END AS proof,
        CASE WHEN m.parent IS NOT NULL THEN 'A' WHEN coalesce(w.controlled, false) OR k.reason LIKE '%second indice%' OR CAST(w.brand IS NOT NULL AS INT) + CAST(w.at_group AS INT) + CAST(w.charted AS INT) + CAST(k.reason LIKE '%indice' AS INT) >= 2 THEN 'B' ELSE 'C' END AS confidence
    FROM {_LAST} k LEFT JOIN md m ON m.child = k.siren LEFT JOIN {_LABELS} n(role, label) ON n.role = m.role LEFT JOIN hits h ON h.siren = k.siren LEFT JOIN house x ON x.brand = h.brand AND x.siren <> k.siren LEFT JOIN {_WIDE} w ON w.siren = k.siren
    WHERE k.siren <> '000000000'),
fw AS (
    SELECT siren, round, [siren] AS path, mother AS cur, false AS again FROM pick
    UNION ALL SELECT w.siren, w.round, list_append(w.path, w.cur), p.mother, list_contains(list_append(w.path, w.cur), p.mother) FROM fw w JOIN pick p ON p.siren = w.cur WHERE NOT w.again),
cuts AS (
    SELECT cur AS siren FROM (SELECT siren, round, cur, list_min(list_slice(path, list_position(path, cur), len(path))) AS loop FROM fw WHERE again)
    QUALIFY row_number() OVER (PARTITION BY loop ORDER BY round, siren) = 1),
fin AS MATERIALIZED (
    SELECT p.siren AS child, CASE WHEN c.siren IS NULL THEN p.mother ELSE '000000000' END AS mother, CASE WHEN c.siren IS NULL THEN p.proof ELSE 'Déduit : boucle de mandats coupée' END AS proof, CASE WHEN c.siren IS NULL THEN p.confidence ELSE 'C' END AS confidence
    FROM pick p LEFT JOIN cuts c ON c.siren = p.siren),
{walked('lv', 'fin')},
acc AS (
    SELECT siren AS node, siren AS cur FROM {_LAST}
    UNION ALL SELECT a.node, f.mother FROM acc a JOIN fin f ON f.child = a.cur LEFT JOIN target t ON t.siren = a.cur WHERE NOT coalesce(t.targetable, false))"""
MAP_COMPANIES = _MAP + f"""
SELECT k.siren, k.reason, CAST(k.round AS BIGINT) AS round, f.mother, coalesce(f.proof, 'Tête du groupe') AS proof, coalesce(f.confidence, 'A') AS confidence, CAST(coalesce(l.depth, 0) AS BIGINT) AS level, coalesce(t.targetable, false) AS targetable, a.cur AS account
FROM {_LAST} k LEFT JOIN fin f ON f.child = k.siren LEFT JOIN lv l ON l.child = k.siren LEFT JOIN target t ON t.siren = k.siren
    LEFT JOIN (SELECT a.node, a.cur FROM acc a JOIN target t ON t.siren = a.cur WHERE t.targetable) a ON a.node = k.siren"""
MAP_LINKS = _MAP + f"""
SELECT g.parent, g.child, n.label AS role, 'Mandat au registre : ' || n.label AS proof FROM gl g JOIN {_LAST} k ON k.siren = g.child JOIN {_LABELS} n(role, label) ON n.role = g.role"""
MAP_SHARES = _MAP + f"""
SELECT siren, coalesce(string_agg(said, '; ' ORDER BY said), '') AS mandates FROM (
    SELECT w.siren, coalesce(NOT w.controlled, false) AS told, g.role, CASE WHEN g.role IN {_in(MEDIUM)} OR (g.role IN {_in(STRONG)} AND told) THEN g.parent || ' ' || n.label END AS said
    FROM {_WIDE} w LEFT JOIN gl g ON g.child = w.siren LEFT JOIN {_LABELS} n(role, label) ON n.role = g.role WHERE w.siren NOT IN (SELECT siren FROM {_LAST}))
GROUP BY siren HAVING bool_or(told) OR bool_or(coalesce(role IN {_in(MEDIUM)}, false))"""
MAP_FOREIGN = _MAP + f"\nSELECT siren, shown AS name FROM {_WIDE} WHERE cj LIKE '3%' AND NOT named_out AND (sure OR coalesce(controlled, false)) AND siren NOT IN (SELECT siren FROM {_LAST})"


# --- why a company is in the group or is not

_SPOTS = " UNION ALL ".join(f"SELECT address_key, {n + 1} AS n FROM spot{n}" for n in range(ROUNDS + 1))
_RULES = " UNION ALL ".join(f"SELECT siren, rule, {n} AS n FROM e{n}" for n in range(ROUNDS + 1))
_EVIDENCE = _MAP + f""",
spots AS (SELECT address_key, min(n) AS n FROM ({_SPOTS}) GROUP BY 1),
alike AS (
    SELECT o.address_key, count(*) FILTER (WHERE o.cj NOT LIKE '9%') AS members, count(l.siren) FILTER (WHERE o.cj NOT LIKE '9%') AS own FROM off o LEFT JOIN like{ROUNDS} l ON l.siren = o.siren GROUP BY 1),
ev AS MATERIALIZED (
    SELECT siren, 'marque_' || kind AS kind, brand AS other, NULL::VARCHAR AS role, NULL::BIGINT AS own, NULL::BIGINT AS members, 0::BIGINT AS round FROM (SELECT DISTINCT siren, kind, brand FROM hits)
    UNION ALL SELECT siren, CASE WHEN controlled THEN 'perimetre' ELSE 'perimetre_sans_controle' END, NULL, NULL, NULL, NULL, 0 FROM listed WHERE controlled IS NOT NULL
    UNION ALL SELECT DISTINCT siren, 'organigramme', NULL, NULL, NULL::BIGINT, NULL::BIGINT, 0 FROM chart
    UNION ALL SELECT a.child, 'registre', a.parent, a.role, NULL, NULL, min(k.round) + 1 FROM act a JOIN {_LAST} k ON k.siren = a.parent GROUP BY a.child, a.parent, a.role
    UNION ALL SELECT o.siren, 'adresse', o.address_key, NULL, l.own, l.members, p.n FROM off o JOIN spots p ON p.address_key = o.address_key JOIN alike l ON l.address_key = o.address_key WHERE o.cj NOT LIKE '9%')"""
EVIDENCE = _EVIDENCE + "\nSELECT siren, kind, other, role, own, members, round FROM ev"
_HEAVY = _in([*STRONG, *MEDIUM])
_WAYS = _values({"IG": "intégration globale", "MEE": "mise en équivalence", "NC": "non consolidée", "inconnue": "méthode non publiée", "autre": "autre méthode"}.items())
EXPLAINED = _EVIDENCE + f""",
over AS (SELECT r.siren, arg_max(r.rule, r.n) AS rule FROM ({_RULES}) r JOIN force f ON f.siren = r.siren AND f.decision = 'ecarter' WHERE r.rule IS NOT NULL GROUP BY 1),
line AS (
    SELECT lpad(CAST(line * 3 AS VARCHAR), 9, '0') AS siren, {_CONTROLLED} AS controlled, coalesce(m.way, d.method) AS way, d.method, d.doc, d.name AS said,
        replace(regexp_replace(printf('%.2f', d.rate), '\\.?0+$', ''), '.', ',') || chr(160) || '%' AS rate
    FROM doc_lines d LEFT JOIN {_WAYS} m(code, way) ON m.code = d.method WHERE d.doc = '000000000'
    QUALIFY row_number() OVER (PARTITION BY d.line ORDER BY NOT {_CONTROLLED}, d.name) = 1),
mine AS (SELECT DISTINCT a.child, a.parent, a.role, k.siren IS NOT NULL AS inside, n.label FROM act a LEFT JOIN {_LAST} k ON k.siren = a.parent LEFT JOIN {_LABELS} n(role, label) ON n.role = a.role),
held AS (
    SELECT child AS siren, coalesce(bool_or(inside AND role IN {_in(MEDIUM)}), false) AS medium, coalesce(bool_or(NOT inside AND role IN {_HEAVY}), false) AS outside, coalesce(bool_or(NOT inside AND role IN {_in(STRONG)}), false) AS strong_outside,
        bool_or(inside AND role IN {_in(STRONG)}) AS strong, bool_or(inside AND label IS NOT NULL) AS tied FROM mine GROUP BY 1),
alls AS (
    SELECT c.siren, o.shown AS name, o.cj, o.siren IS NOT NULL AS active, k.reason, p.proof, p.confidence, coalesce(h.medium, false) AS medium, coalesce(h.outside, false) AS outside, coalesce(h.strong_outside, false) AS strong_outside,
        coalesce(h.strong, false) AS strong, coalesce(h.tied, false) AS tied, coalesce(NOT l.controlled, false) AS stated, f.decision, v.rule AS lost, l.way, l.doc, l.said, l.rate,
        coalesce(o.cj LIKE '3%' AND NOT o.barred AND (l.controlled OR c.siren IN (SELECT siren FROM hits WHERE kind = 'sure')) AND c.siren NOT IN {_brackets(MAP_SETTINGS.left_out)}, false) AS abroad
    FROM (SELECT siren FROM ev UNION SELECT siren FROM {_LAST}) c LEFT JOIN off o ON o.siren = c.siren LEFT JOIN {_LAST} k ON k.siren = c.siren LEFT JOIN fin p ON p.child = c.siren LEFT JOIN held h ON h.siren = c.siren
        LEFT JOIN line l ON l.siren = c.siren LEFT JOIN force f ON f.siren = c.siren LEFT JOIN over v ON v.siren = c.siren
    WHERE c.siren <> '000000000'),
doubt AS (SELECT *, reason IS NULL AND active AND (medium OR stated) AS shared FROM alls),
sorted AS (
    SELECT *, concat_ws(',', CASE WHEN reason IS NOT NULL AND confidence = 'C' THEN 'confiance_c' END, CASE WHEN reason IS NOT NULL AND outside THEN 'co_entreprise' END, CASE WHEN shared THEN 'participation' END, CASE WHEN abroad THEN 'etrangere' END) AS doubts FROM doubt),
cs AS MATERIALIZED (
    SELECT *, CASE WHEN doubts <> '' THEN doubts ELSE 'decision' END AS kinds,
        CASE WHEN reason IS NOT NULL THEN 'Entrée dans le groupe : ' || reason || ' · rattachement : ' || proof WHEN lost IS NOT NULL THEN 'Écartée par le consultant ; règle du moteur qui l''aurait retenue : ' || lost
            WHEN shared AND stated THEN 'Non retenue : non contrôlée selon le périmètre publié (' || doc || ', ligne « ' || said || ' » (' || way || ', ' || rate || '))' WHEN shared AND strong_outside THEN 'Non retenue : contrôle partagé avec une société hors du groupe (mandat fort)'
            WHEN shared THEN 'Non retenue : participation sans contrôle (mandat moyen sans indice indépendant)' ELSE 'Non retenue : société étrangère, jamais retenue par le moteur' END AS verdict
    FROM sorted WHERE doubts <> '' OR lost IS NOT NULL OR (reason IS NOT NULL AND decision = 'retenir')),
own_seats AS (SELECT DISTINCT siren, person FROM seats),
said AS (
    SELECT e.siren, 'pour' AS side, CASE e.kind WHEN 'marque_sure' THEN 'Porte une marque sûre du groupe' WHEN 'marque_ambigue' THEN 'Porte une marque ambiguë du groupe' WHEN 'registre' THEN 'Mandat au registre : ' || n.label || ', tenu par la société du groupe ' || e.other
        WHEN 'adresse' THEN 'Siège à une adresse du groupe : ' || e.own || ' sociétés du groupe sur ' || e.members WHEN 'organigramme' THEN 'Tête d''une maison de l''organigramme public du groupe'
        WHEN 'perimetre' THEN 'Inscrite au périmètre publié du groupe, ' || CASE WHEN l.method = 'IG' THEN 'en intégration globale' ELSE l.way || ', détenue à ' || l.rate END ELSE 'Inscrite au périmètre publié du groupe, sans contrôle (' || l.way || ')' END AS text
    FROM ev e LEFT JOIN {_LABELS} n(role, label) ON n.role = e.role LEFT JOIN line l ON l.siren = e.siren
    UNION ALL SELECT c.siren, 'pour', 'Dirigeants en commun avec d''autres sociétés du groupe : ' || count(*) FROM cs c JOIN own_seats s ON s.siren = c.siren
        WHERE EXISTS (SELECT 1 FROM own_seats x JOIN {_LAST} k ON k.siren = x.siren WHERE x.person = s.person AND x.siren <> s.siren) GROUP BY c.siren
    UNION ALL SELECT siren, 'contre', CASE WHEN tied THEN 'Aucun mandat fort (président, gérant…) tenu par une société du groupe' ELSE 'Aucun mandat au registre tenu par une société du groupe' END FROM cs WHERE NOT strong
    UNION ALL SELECT siren, 'contre', 'Un seul indice : rattachement déduit, pas lu au registre' FROM cs WHERE kinds LIKE '%confiance_c%'
    UNION ALL SELECT siren, 'contre', 'Le périmètre publié du groupe la dit non contrôlée : ' || way FROM cs WHERE stated
    UNION ALL SELECT m.child, 'contre', 'Mandat au registre : ' || m.label || ', tenu par ' || CASE WHEN o.cj <> '' AND o.cj NOT LIKE '1%' THEN 'la société ' || m.parent ELSE 'une entité' END || ' hors du groupe' FROM mine m LEFT JOIN off o ON o.siren = m.parent WHERE NOT m.inside AND m.role IN {_HEAVY}
    UNION ALL SELECT siren, 'contre', 'Société étrangère (catégorie juridique ' || cj || ') : hors du périmètre France' FROM cs WHERE kinds LIKE '%etrangere%'
    UNION ALL SELECT siren, 'contre', 'Écartée par le consultant' FROM cs WHERE decision = 'ecarter')
SELECT c.siren, c.name, c.kinds, c.verdict AS rule, c.reason IS NOT NULL AS kept, c.decision, s.side, s.text FROM cs c LEFT JOIN said s ON s.siren = c.siren AND s.text IS NOT NULL"""


# --- the country's map

_ARBITRATED = ARBITRATION[ARBITRATION.index("own AS (SELECT * FROM cl") :]
_ARBITRATED, _CHOSEN = _ARBITRATED[: _ARBITRATED.rindex("\nSELECT f.siren")], _ARBITRATED[_ARBITRATED.rindex("\nSELECT f.siren") + 1 :]
_COUNTRY = with_clause("links", "offices", "companies", "doc_lines", "legal_units", recursive=True) + f""",
{ACTIVE}, {mothers('m', 'act', 15)},
e AS (SELECT DISTINCT parent, child FROM act WHERE role = '73'),
dn AS (SELECT DISTINCT doc AS start, doc AS node, 0 AS level FROM doc_lines UNION SELECT r.start, e.child, r.level + 1 FROM dn r JOIN e ON e.parent = r.node WHERE r.level < 60),
reach AS MATERIALIZED (SELECT start AS head, node AS siren, min(level) AS level FROM dn GROUP BY 1, 2),
mapped AS (
    SELECT r.head, r.siren, CASE WHEN r.siren <> r.head THEN coalesce(x.siren, r.head) END AS mother, r.level,
        CASE WHEN r.siren = r.head THEN 'Tête du groupe' WHEN x.siren IS NOT NULL THEN 'Mandat au registre : ' || m.role ELSE 'Déduit : rattachée à la tête du groupe' END AS proof, CASE WHEN r.siren = r.head OR x.siren IS NOT NULL THEN 'A' ELSE 'C' END AS confidence
    FROM reach r LEFT JOIN m ON m.child = r.siren LEFT JOIN reach x ON x.head = r.head AND x.siren = m.mother),
bank AS (SELECT '000000003' AS head, siren, 'Banque de la fédération' AS proof FROM offices WHERE cj = 5560 AND siren < '000000200'),
members AS MATERIALIZED (
    SELECT * FROM mapped UNION ALL SELECT head, siren, head, 1, proof, 'B' FROM bank b WHERE NOT EXISTS (SELECT 1 FROM mapped x WHERE x.head = b.head AND x.siren = b.siren)),
told AS (SELECT doc AS head, lpad(CAST(line * 7 % 40 AS VARCHAR), 9, '0') AS siren, max(rate) AS rate FROM doc_lines GROUP BY 1, 2),
claim AS (SELECT b.head, b.siren, CASE WHEN t.head IS NULL THEN 1 ELSE 0 END AS rank, t.rate, CASE WHEN t.head IS NULL THEN b.level END AS level FROM members b LEFT JOIN told t ON t.head = b.head AND t.siren = b.siren),
cl AS (SELECT head, siren, rank, coalesce(rate, 0) AS rate, coalesce(level, 0) AS level FROM claim),
sz AS (SELECT head, count(*) AS size, CASE head WHEN '000000001' THEN '000000000' WHEN '000000003' THEN '000000001' END AS parent FROM mapped GROUP BY head),
{_ARBITRATED},
chosen AS MATERIALIZED ({_CHOSEN}),
won AS MATERIALIZED (SELECT siren, head FROM chosen WHERE siren NOT IN (SELECT head FROM sz) UNION ALL SELECT head, head FROM sz),
dmap AS MATERIALIZED (
    SELECT w.siren, w.head, CASE WHEN w.siren = w.head THEN s.parent ELSE w.head END AS map, b.mother, b.proof, b.confidence
    FROM won w JOIN sz s ON s.head = w.head LEFT JOIN members b ON b.siren = w.siren AND b.head = CASE WHEN w.siren = w.head THEN s.parent ELSE w.head END),
up AS (
    SELECT d.siren, d.map, d.mother AS cur, [d.siren, d.mother] AS way, coalesce(x.head = d.map, false) AS here FROM dmap d LEFT JOIN won x ON x.siren = d.mother WHERE d.mother IS NOT NULL
    UNION ALL SELECT u.siren, u.map, b.mother, list_append(u.way, b.mother), coalesce(x.head = u.map, false)
    FROM up u JOIN members b ON b.head = u.map AND b.siren = u.cur LEFT JOIN won x ON x.siren = b.mother WHERE NOT u.here AND b.mother IS NOT NULL AND NOT list_contains(u.way, b.mother)),
dr AS MATERIALIZED (
    SELECT d.siren, d.head, CASE WHEN d.siren <> d.head OR d.proof IS NOT NULL THEN coalesce(u.cur, d.map) END AS mother,
        CASE WHEN d.siren = d.head AND d.proof IS NULL THEN 'Tête du groupe' WHEN u.cur = d.mother THEN d.proof WHEN x.head IS NOT NULL THEN 'Déduit : maison mère directe ' || d.mother || ' rangée dans le groupe ' || x.head ELSE 'Déduit : rattachée à la tête du groupe' END AS proof,
        CASE WHEN d.siren = d.head AND d.proof IS NULL THEN 'A' WHEN u.cur = d.mother THEN d.confidence ELSE 'C' END AS confidence
    FROM dmap d LEFT JOIN (SELECT siren, cur FROM up WHERE here) u ON u.siren = d.siren LEFT JOIN won x ON x.siren = d.mother),
inner_ AS (SELECT siren AS child, mother FROM dr WHERE siren <> head AND mother IN (SELECT siren FROM dr)),
{walked('dl', 'inner_')},
doc_rows AS MATERIALIZED (SELECT d.*, CAST(coalesce(l.depth, 0) AS BIGINT) AS level FROM dr d LEFT JOIN dl l ON l.child = d.siren),
{_TARGET}"""
CLAIMS = _COUNTRY + "\nSELECT head, siren, CASE rank WHEN 0 THEN 'inscription' ELSE 'descente' END AS manner, rate, CAST(level AS INT) AS level FROM claim"
DOCUMENT_ROWS = _COUNTRY + "\nSELECT * FROM doc_rows"
COUNTRY_GROUPS = _COUNTRY + """
SELECT r.head, o.name, count(*) AS size, s.parent, 'document ' || r.head AS document FROM doc_rows r JOIN sz s ON s.head = r.head LEFT JOIN offices o ON o.siren = r.head GROUP BY r.head, o.name, s.parent"""
READ_MAP = _COUNTRY + """,
nest AS (SELECT '000000003' AS head UNION SELECT s.head FROM nest n JOIN sz s ON s.parent = n.head),
below AS (
    SELECT '000000003' AS siren, 0 AS level UNION SELECT r.siren, b.level + 1 FROM below b JOIN doc_rows r ON r.mother = b.siren WHERE r.head IN (SELECT head FROM nest) AND b.level < 60)
SELECT siren, CAST(min(level) AS BIGINT) AS level FROM below GROUP BY siren"""
ALONE = _COUNTRY + """
SELECT o.siren, o.name, t.targetable, t.reason FROM offices o JOIN target t ON t.siren = o.siren
WHERE (o.cj IS NULL OR o.cj < 1000 OR o.cj > 1999) AND o.siren NOT IN (SELECT siren FROM companies WHERE closed IS NOT NULL) AND o.siren NOT IN (SELECT siren FROM doc_rows) AND o.siren < '000000500'"""
BELOW_TRADERS = _COUNTRY + """
SELECT child AS siren, mother FROM m WHERE mother NOT IN (SELECT siren FROM offices WHERE cj IS NULL OR cj < 1000 OR cj > 1999) AND mother NOT IN (SELECT siren FROM legal_units WHERE cj IS NULL OR cj < 5550)"""
MAP_ROWS = _COUNTRY + r""",
cell AS (SELECT siren, CASE WHEN regexp_matches(name, '^[=+\-@\t\r]') THEN '''' || name ELSE name END AS name FROM offices)
SELECT regexp_replace(r.siren, '^(\d{3})(\d{3})(\d{3})$', '\1 \2 \3') AS siren, c.name, regexp_replace(r.head, '^(\d{3})(\d{3})(\d{3})$', '\1 \2 \3') AS head, regexp_replace(r.mother, '^(\d{3})(\d{3})(\d{3})$', '\1 \2 \3') AS mother,
    x.name AS mother_name, r.level, CASE WHEN t.targetable THEN 'oui' ELSE 'non' END AS targetable
FROM doc_rows r LEFT JOIN cell c ON c.siren = r.siren LEFT JOIN cell x ON x.siren = r.mother LEFT JOIN target t ON t.siren = r.siren"""


# --- tables of unknown columns in documents

_SHARE = "replace(printf('%.2f', rate + 0.25), '.', ',')"
_TABLE_LINES = f"""tl AS (
    SELECT doc, line, CASE WHEN line % 23 = 0 THEN 'FRANCE | Pourcentage d''intérêts | % contrôle' WHEN line % 29 = 0 THEN 'GERMANY | Pourcentage d''intérêts | % contrôle' WHEN line % 31 = 0 THEN repeat('texte courant ', 8) WHEN line % 37 = 0 THEN 'Japan'
        WHEN line % 11 = 1 THEN name || ' | ' || {_SHARE} || ' | 98' WHEN line % 11 = 2 THEN name || ' | France | 2 310 | ' || {_SHARE} WHEN line % 11 = 3 THEN name || ' | France |  |  |  | ' || {_SHARE} || ' | IG'
        WHEN line % 11 = 4 THEN ' | ' || name || ' (1) | ' || town || ' | ' || {_SHARE} || ' % | IG* | ' WHEN line % 11 = 5 THEN 'France, Vannes | ' || name || ' | 55' WHEN line % 11 = 6 THEN name || ' | France | 55'
        WHEN line % 11 = 7 THEN name || ' | ' || town || ' | ' || {_SHARE} || ' | 120' WHEN line % 11 = 8 THEN name || ' | 000000012 | France | ' || {_SHARE}
        ELSE name || ' | ' || CASE WHEN line % 2 = 0 THEN 'France' ELSE town END || ' | ' || {_SHARE} || ' | 60 | ' || method END AS text
    FROM doc_lines)"""
_PLACES = "(VALUES ('FRANCE', 'france'), ('GERMANY', 'country'), ('JAPAN', 'country'), ('BRAZIL', 'country'), ('CANADA', 'country'), ('CHINA', 'country'), ('EGYPT', 'country'), ('EUROPE', 'zone'), ('ASIA', 'zone'))"
TABLE_ROWS = with_clause("doc_lines") + f""",
{_TABLE_LINES},
raw AS (SELECT doc, line, unnest(string_split(text, '|')) AS cell, generate_subscripts(string_split(text, '|'), 1) AS i FROM tl WHERE text LIKE '%|%'),
bare AS (SELECT doc, line, i, trim(regexp_replace(trim(cell), '\\s*(\\([0-9]+\\)|\\*+|%)$', '')) AS cell FROM raw),
inner_cells AS (SELECT *, i - min(i) FILTER (WHERE cell <> '') OVER (PARTITION BY doc, line) AS p, max(i) FILTER (WHERE cell <> '') OVER (PARTITION BY doc, line) AS z FROM bare),
c AS (
    SELECT c.doc, c.line, p, cell, CASE WHEN cell IN ('', '-', '—') THEN 'empty' WHEN regexp_full_match(cell, '[0-9]{{9}}') THEN 'number' WHEN regexp_full_match(cell, '[0-9]{{1,3}}([.,][0-9]+)?') THEN 'share'
        WHEN regexp_full_match(cell, '[0-9][0-9 .,]*') THEN 'amount' WHEN {norm('cell')} IN ('IG', 'INTEGRATION GLOBALE', 'MEE', 'ME', 'MISE EN EQUIVALENCE', 'IP', 'JV') THEN 'method' ELSE coalesce(a.kind, b.kind, 'text') END AS kind
    FROM inner_cells c LEFT JOIN {_PLACES} a(k, kind) ON a.k = {norm('cell')} LEFT JOIN {_PLACES} b(k, kind) ON cell LIKE '%,%' AND b.k = {norm("split_part(cell, ',', 1)")} WHERE p >= 0 AND i <= z),
told AS (
    SELECT doc, line, count(*) AS size, max(kind) FILTER (WHERE p = 0) AS opens, bool_and(p = 0 OR regexp_matches(upper(strip_accents(cell)), '%|POURCENTAGE|INTERET|CONTROLE|DETENTION|INTEREST|OWNERSHIP')) AS about FROM c GROUP BY doc, line),
events AS (
    SELECT doc, line, opens AS kind, size FROM told WHERE size > 1 AND about AND opens IN ('france', 'country', 'zone')
    UNION ALL SELECT doc, line, '', -1 FROM tl LEFT JOIN {_PLACES} a(k, kind) ON a.k = {norm('text')} WHERE text NOT LIKE '%|%' AND (length(text) > 80 OR a.k IS NOT NULL)),
named AS (SELECT doc, line, min(p) AS at FROM c WHERE kind = 'text' GROUP BY doc, line),
s AS (
    SELECT c.doc, c.line, any_value(n.at) AS named, count(*) AS size, arg_min(cell, p) FILTER (WHERE p = n.at) AS name, count(*) FILTER (WHERE kind = 'share' AND p > n.at) AS shares, arg_min(cell, p) FILTER (WHERE kind = 'share' AND p > n.at) AS share,
        min(p) FILTER (WHERE kind = 'share' AND p > n.at) AS share_at, bool_or(kind = 'amount') AS amount, coalesce(max(try_cast(replace(cell, ',', '.') AS DOUBLE)) FILTER (WHERE kind = 'share'), 0) AS most,
        arg_min({norm('cell')}, p) FILTER (WHERE kind = 'method') AS m, arg_min(kind, p) FILTER (WHERE kind IN ('france', 'country', 'zone')) AS own, min(p) FILTER (WHERE kind IN ('france', 'country', 'zone')) AS at,
        arg_min(cell, p) FILTER (WHERE kind IN ('france', 'country', 'zone')) AS shown, coalesce(bool_or(cell LIKE '%,%' OR cell LIKE '%.%') FILTER (WHERE kind = 'share' AND p > n.at), false) AS decimals
    FROM c JOIN named n ON n.doc = c.doc AND n.line = c.line GROUP BY c.doc, c.line),
gaps AS (
    SELECT s.doc, s.line FROM s JOIN c a ON a.doc = s.doc AND a.line = s.line JOIN c b ON b.doc = a.doc AND b.line = a.line AND b.p = a.p + 1 JOIN c d ON d.doc = a.doc AND d.line = a.line AND d.p = a.p + 2
    WHERE a.kind = 'empty' AND b.kind = 'empty' AND d.kind = 'empty' AND a.p > s.named AND d.p < s.share_at),
r AS (
    SELECT s.*, (SELECT arg_max(e.kind, e.line) FROM events e WHERE e.doc = s.doc AND e.line < s.line) AS above, coalesce((SELECT arg_max(e.size, e.line) FROM events e WHERE e.doc = s.doc AND e.line < s.line) = s.size, false) AS titled,
        CASE m WHEN 'IG' THEN 'IG' WHEN 'INTEGRATION GLOBALE' THEN 'IG' WHEN 'MEE' THEN 'MEE' WHEN 'ME' THEN 'MEE' WHEN 'MISE EN EQUIVALENCE' THEN 'MEE' WHEN 'IP' THEN 'autre' WHEN 'JV' THEN 'autre' END AS method
    FROM s WHERE length(regexp_replace(name, '[^\\p{{L}}]', '', 'g')) >= 2 AND NOT list_has_any(string_split({norm('name')}, ' '), ['SUCCURSALE', 'SUCC', 'BRANCH', 'NIEDERLASSUNG', 'SUCURSAL']) AND shares BETWEEN 1 AND 4 AND NOT amount AND most <= 100 AND NOT EXISTS (SELECT 1 FROM gaps g WHERE g.doc = s.doc AND g.line = s.line) AND NOT EXISTS (SELECT 1 FROM events e WHERE e.doc = s.doc AND e.line = s.line)),
k AS (SELECT * FROM r WHERE CASE WHEN own IS NULL THEN titled ELSE method IS NOT NULL OR shares > 1 OR decimals OR shown LIKE '%,%' END)
SELECT doc, line, name, coalesce(own, above) AS country, coalesce(method, 'inconnue') AS method, CAST(replace(share, ',', '.') AS DOUBLE) AS rate FROM k
WHERE coalesce(own, above) = 'france' AND (method IS NOT NULL OR titled OR EXISTS (SELECT 1 FROM k x WHERE x.doc = k.doc AND x.own = 'country' AND x.size = k.size AND x.at = k.at))"""
TOWN_CANDIDATES = with_clause("doc_lines") + """,
w AS (SELECT doc, line, name || ' ' || town AS whole, string_split(name || ' ' || town, ' ') AS w FROM doc_lines),
x AS (
    SELECT doc, line, (h - 1) * 3 + k AS turn, CASE h WHEN 1 THEN 'Compagnie Nord et' ELSE 'Nord et' END || rtrim(' ' || array_to_string(w[1:len(w) - k], ' ')) AS name, array_to_string(w[len(w) - k + 1:], ' ') AS town, true AS needs_town, false AS fallback
    FROM w, range(1, 3) a(h), range(1, 4) b(k) WHERE line % 3 = 0 AND k <= len(w)
    UNION ALL SELECT doc, line, 10 + k, array_to_string(w[1:len(w) - k], ' '), array_to_string(w[len(w) - k + 1:], ' '), k > 1, false FROM w, range(1, 4) b(k) WHERE k < len(w)
    UNION ALL SELECT doc, line, 20, whole, w[len(w)], true, true FROM w WHERE len(w) > 1)
SELECT doc, line, CAST(row_number() OVER (PARTITION BY doc, line ORDER BY turn) - 1 AS INT) AS place, name, town, needs_town, fallback FROM x"""
ACRONYMS = with_clause("doc_lines") + f""",
w AS (SELECT doc, line, name, upper(substr(split_part(name, ' ', 1), 1, 1) || substr(split_part(name, ' ', 2), 1, 1) || CASE WHEN line % 5 = 0 THEN 'X' ELSE 'Z' END) AS short FROM doc_lines),
l AS (SELECT *, CASE WHEN line % 2 = 0 THEN name ELSE 'de la ' || name END AS long FROM w),
i AS (SELECT *, array_to_string(list_transform(list_filter(string_split({norm('long')}, ' '), lambda x: x NOT IN ('DE', 'DU', 'DES', 'D', 'L', 'LA', 'LE', 'LES', 'ET', 'EN', 'A', 'AU', 'AUX')), lambda x: x[1]), '') AS initials FROM l),
ok AS (SELECT *, initials LIKE short[1] || '%' || short[2] || '%' || short[3] || '%' AS reads FROM i)
SELECT doc, line, CASE WHEN reads THEN long END AS name, CASE WHEN reads THEN short END AS acronym FROM ok"""


# --- probes, warnings, dates, order

_KEYS = "(VALUES ('000000003'), ('000000050'), ('000000077'), ('000000400'), ('999999999')) k(key)"
_AT = UNIT_MERGE.rindex("\nSELECT n.siren")
PROBED = UNIT_MERGE[:_AT] + f""",
replayed AS ({UNIT_MERGE[_AT + 1 :]}),
picked AS (SELECT DISTINCT (SELECT min(siren) FROM batch_units WHERE siren >= key) AS siren FROM {_KEYS})
SELECT p.siren, coalesce(r.change, 'none') = 'none' AS present FROM picked p LEFT JOIN replayed r ON r.siren = p.siren WHERE p.siren IS NOT NULL"""
WARNED = with_clause("links", "companies") + """,
d AS (SELECT max(greatest(opened, coalesce(closed, opened))) AS day FROM (SELECT opened, closed FROM links UNION ALL SELECT opened, closed FROM companies))
SELECT 'Tête seule : aucune société rattachée.' AS warning WHERE (SELECT count(*) FROM companies WHERE siren = '000000000') <= 1
UNION ALL SELECT 'Données du registre au ' || strftime(day, '%d/%m/%Y') || ' : plus de 7 jours de retard.' FROM d WHERE DATE '2026-01-15' - CAST(day AS DATE) > 7"""
LISTED_BY_GROUP = _COUNTRY + """
SELECT r.head, count(*) AS listed, bool_or(s.parent IS NULL) AS document FROM doc_rows r JOIN sz s ON s.head = r.head WHERE r.siren IN (SELECT siren FROM legal_units WHERE cj IS NOT NULL) GROUP BY r.head"""
DATES = with_clause("records") + """
SELECT siren, strftime(updated, '%d/%m/%Y') AS shown, strftime(CAST(updated AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Paris', '%Y-%m-%d') AS day FROM records"""
SORTED = with_clause("offices") + r"""
SELECT siren, array_to_string(list_transform(regexp_extract_all(upper(strip_accents(concat_ws(' ', name, address_key))), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), '') AS sort_key FROM offices"""
DISTINCT_NAMES = f"""
WITH w AS (SELECT doc_id, unnest(string_split({norm('text')}, ' ')) AS word, generate_subscripts(string_split({norm('text')}, ' '), 1) AS i FROM documents),
f AS (SELECT doc_id, word, min(i) AS i FROM w GROUP BY doc_id, word), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY n) FILTER (WHERE n <= 20) AS first FROM o GROUP BY doc_id"""


# --- federations, judgements, rows of exports

OTHER_FEDERATIONS = with_clause("links", "offices", recursive=True) + f""",
{ACTIVE}, {mothers('m', 'act', 15)},
bk AS (SELECT siren, replace(name, '-', ' ') AS name FROM offices WHERE name LIKE 'S%' OR cj IN (5194, 5195, 5460, 5560, 5660, 6560, 6595, 6596)),
lg AS (SELECT child FROM act WHERE role = '11' AND parent IN (SELECT siren FROM bk) AND child NOT IN (SELECT child FROM act WHERE parent = '000000022') GROUP BY child HAVING count(DISTINCT parent) > 1),
un AS (SELECT unnest(['000000041', '000000100']) AS siren UNION SELECT m.child FROM un JOIN m ON m.mother = un.siren WHERE m.role NOT IN ('64', '65'))
SELECT parent AS siren FROM act WHERE role = '11' AND child IN (SELECT child FROM lg) UNION SELECT siren FROM un UNION SELECT siren FROM bk WHERE contains(name, 'OLD') OR contains(name, 'Les hot')"""
SAME_JUDGEMENT = with_clause("offices", "companies") + f""",
{_TARGET},
{_TARGET.replace("target AS", "theirs AS").replace("coalesce(band, '')", "''").replace("band = '00'", "false").replace("LEFT JOIN companies c", "LEFT JOIN (SELECT * FROM companies WHERE closed IS NULL) c")}
SELECT count(*) AS found, count(*) FILTER (WHERE t.targetable = x.targetable) AS same FROM target t JOIN theirs x ON x.siren = t.siren"""
ENTITY_TYPES = with_clause("offices", "companies") + f""",
{_TARGET}
SELECT siren, CASE WHEN CAST(siren AS BIGINT) % 10 = 0 THEN 'holding_operating_group' WHEN reason LIKE '%civile%' THEN 'sci' WHEN reason LIKE '%GIE%' THEN 'shared_service' WHEN reason LIKE '%Holding%' THEN 'holding' ELSE 'operating_company' END AS entity_type FROM target"""
RELATION_ROWS = _COUNTRY + """
SELECT mother AS parent_id, siren AS child_id, CASE WHEN confidence IN ('A', 'B') THEN 'confirmed' ELSE 'to_verify' END AS status, CASE confidence WHEN 'A' THEN 'high' WHEN 'B' THEN 'medium' ELSE 'low' END AS confidence,
    CASE confidence WHEN 'A' THEN 'yes' ELSE 'no' END AS verified FROM doc_rows WHERE mother IS NOT NULL AND siren <> head"""
BRAND_ENTITIES = with_clause("offices") + """,
b AS (SELECT * FROM (VALUES ('B1', 'red widget'), ('B2', 'L''or'), ('B3', 'hot rod'), ('B4', 'nothing')) b(brand_id, brand))
SELECT brand_id, brand, (SELECT min(siren) FROM offices o WHERE siren < '000000300' AND contains(replace(upper(o.name), '''', ' '), replace(upper(b.brand), '''', ' '))) AS entity FROM b"""
