"""Evidence, cases and what speaks for and against them."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from groupforge.operators import provenance, rules

OFFICES = "siren string, cj int, name string, address_key string"
LINKS = "parent string, child string, role string, opened date, closed date"
KEPT = "grp string, siren string, reason string, round int"
BRANDS = "grp string, siren string, brand string, kind string"
LISTED = "grp string, siren string, controlled boolean, method string, rate double, source string, text string"
PERSONS = "siren string, person string, role string, closed date"


def replayed(offices, links, persons, kept, brands, listed, apart):
    """The evidence of one group, round by round over Python sets."""
    out, last = {}, max(r for _, r in kept) + 1
    put = lambda key, n: out.setdefault(key, n)
    for s, b, k in brands:
        put((s, "marque_" + k, b, None, None, None), 0)
    for s, ok in listed:
        put((s, "perimetre" if ok else "perimetre_sans_controle", None, None, None, None), 0)
    places = {}
    for n in range(1, last + 1):
        inside = {s for s, r in kept if r < n}
        linked = {(c, p, r) for p, c, r in links if p in inside and p != c}
        for c, p, r in linked:
            put((c, "registre", p, r, None, None), n)
        sits = defaultdict(set)
        for s, p in persons:
            if s in inside:
                sits[p].add(s)
        managers = {s for s, p in persons if len(sits[p]) >= 2}
        like = ({c for c, _, _ in linked} | {s for s, _, k in brands if k == "sure"} | managers) - apart | inside
        for a in {x[3] for x in offices if x[3] and "[ND]" not in x[3]}:
            there = {s for s, cj, _, k in offices if k == a}
            counted = {s for s, cj, _, k in offices if k == a and not str(cj).startswith("9")}
            own = len(counted & like)
            if len(there & inside) >= 2 and own and own / len(counted) >= 0.5:
                places[a] = (places.get(a, (n,))[0], own, counted)
    for a, (n, own, counted) in places.items():
        for s in counted:
            out[(s, "adresse", a, None, own, len(counted))] = n
    return {(*k, n) for k, n in out.items()}


def test_evidence_is_what_a_replay_of_the_rounds_finds(spark):
    """Two groups at once, with repeated links and seats, masked and missing addresses, and null names."""
    rnd = random.Random(5)
    ids = [f"{k:02d}" for k in range(60)]
    offices = [(x, rnd.choice([5710, 5499, 9220, 3120, None]), rnd.choice([None, f"N {x}"]), rnd.choice([None, "", "X [ND]", *"ABCDEFGH"])) for x in ids]
    edges = [(rnd.choice(ids), rnd.choice(ids), rnd.choice(["73", "65", "99", "71"])) for _ in range(80)]
    seats = [(rnd.choice(ids), f"P{rnd.randrange(15)}") for _ in range(70)]
    kept, brands, listed, apart, want = [], [], [], [], set()
    for g in ("g", "h"):
        inside = [(x, rnd.randrange(4)) for x in rnd.sample(ids, 22)]
        own_brands = [(x, "B", rnd.choice(["sure", "ambigue"])) for x in rnd.sample(ids, 8)]
        told = [(x, rnd.choice([True, False])) for x in rnd.sample(ids, 5)]
        out = set(rnd.sample(ids, 6))
        kept += [(g, x, "r", n) for x, n in inside]
        brands += [(g, *b) for b in own_brands] * 2
        listed += [(g, x, ok, "IG", 1.0, "d", "t") for x, ok in told] + [(g, ids[0], None, None, None, None, None)]
        apart += [(g, x) for x in out]
        want |= {(g, *r) for r in replayed(offices, edges, seats, inside, own_brands, told, out)}
    frame = spark.createDataFrame
    got = provenance.evidence(
        frame(offices, OFFICES), frame([(*e, None, None) for e in edges * 2], LINKS), frame([(s, p, "73", None) for s, p in seats] * 2, PERSONS), frame(kept, KEPT),
        frame(brands, BRANDS), frame(listed, LISTED), apart=frame(apart, "grp string, siren string"),
    )
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert {"adresse", "registre", "marque_sure", "perimetre"} <= {r[2] for r in found} and len({r[-1] for r in found if r[2] == "adresse"}) > 1


def test_all_kinds_of_cases_with_pro_and_contra(spark):
    """H is the head; A is deduced, B shared, C and E outside, F foreign, G let in and K kept out by decision, L plain, U only refused by a rule."""
    frame = spark.createDataFrame
    offices = frame([(x, 3120 if x == "F" else 5710, f"NAME {x}", "1 RUE") for x in "HABCEFGKLU"] + [("T", 1000, "TRADER", None)], OFFICES)
    ties = [("H", "B", "73"), ("X", "B", "30"), ("T", "B", "30"), ("Y", "B", "71"), ("H", "C", "65"), ("L", "C", "11"), ("U", "C", "73"), ("H", "K", "73"), ("H", "L", "73"), ("L", "L", "73"), ("H", "U", "71")]
    links = frame([(*x, None, None) for x in ties], LINKS)
    persons = frame([("A", "P1", "73", None), ("H", "P1", "73", None), ("A", "P2", "73", None), ("L", "P9", "73", None)], PERSONS)
    reasons = {"H": ("tête du groupe", 0), "A": ("nom de marque propre au groupe", 1), "B": ("mandat fort au registre", 1), "G": ("retenue par décision du consultant", 1), "L": ("mandat fort au registre", 1)}
    kept = frame([("g", x, why, n) for x, (why, n) in reasons.items()], KEPT)
    chosen = frame([("g", x, f"preuve {x}", "C" if x == "A" else "A") for x in "ABGL"], "grp string, siren string, proof string, confidence string")
    brands = frame([("g", "A", "NAME A", "sure"), ("g", "F", "NAME F", "sure"), ("g", "G", "NAME G", "ambigue")], BRANDS)
    listed = frame([("g", "E", False, "MEE", 40.0, "DOC", "E Ltd"), ("g", "L", True, "NC", 66.5, "DOC", "L SA"), ("g", "F", True, "IG", 100.0, "DOC", "F Inc")], LISTED)
    decisions = frame([("g", "G", "retenir"), ("g", "K", "ecarter")], "grp string, siren string, decision string")
    lost = frame([("g", "K", "mandat fort au registre")], "grp string, siren string, rule string")
    none = frame([], "grp string, siren string")
    found = provenance.evidence(offices, links, persons, kept, brands, listed, apart=decisions.where("decision = 'ecarter'").select("grp", "siren"))
    doubts = provenance.cases(offices, links, kept, chosen, found, listed, decisions, lost, none)
    got = {r.siren: r for r in doubts.collect()}
    assert {s: r.kinds for s, r in got.items()} == {"A": "confiance_c", "B": "co_entreprise", "C": "participation", "E": "participation", "F": "etrangere", "G": "decision", "K": "decision"}
    assert got["A"].rule == "Entrée dans le groupe : nom de marque propre au groupe · rattachement : preuve A" and got["A"].kept
    assert got["C"].rule == "Non retenue : contrôle partagé avec une société hors du groupe (mandat fort)"
    assert got["E"].rule == "Non retenue : non contrôlée selon le périmètre publié (DOC, ligne « E Ltd » (mise en équivalence, 40 %))"
    assert got["K"].rule == "Écartée par le consultant ; règle du moteur qui l'aurait retenue : mandat fort au registre" and not got["K"].kept
    assert got["F"].rule.startswith("Non retenue : société étrangère")
    sides = {}
    for r in provenance.indications(doubts, offices, links, persons, kept, found, listed).collect():
        sides.setdefault((r.siren, r.side), []).append(r.text)
    sides = {k: sorted(v) for k, v in sides.items()}
    # H A B G L are retained, C and U linked, F bears a sure brand
    at = "Siège à une adresse du groupe : 8 sociétés du groupe sur 10"
    assert sides["A", "pour"] == ["Dirigeants en commun avec d'autres sociétés du groupe : 1", "Porte une marque sûre du groupe", at]
    assert sides["A", "contre"] == ["Aucun mandat au registre tenu par une société du groupe", "Un seul indice : rattachement déduit, pas lu au registre"]
    assert sides["B", "contre"] == ["Mandat au registre : Gérant, tenu par une entité hors du groupe"] * 2
    assert sides["C", "pour"] == ["Mandat au registre : Administrateur, tenu par la société du groupe H", "Mandat au registre : Membre, tenu par la société du groupe L", at]
    assert sides["C", "contre"] == ["Aucun mandat fort (président, gérant…) tenu par une société du groupe", "Mandat au registre : Président, tenu par la société U hors du groupe"]
    assert sides["E", "contre"][1] == "Le périmètre publié du groupe la dit non contrôlée : mise en équivalence"
    assert "Société étrangère (catégorie juridique 3120) : hors du périmètre France" in sides["F", "contre"] and "Inscrite au périmètre publié du groupe, en intégration globale" in sides["F", "pour"]
    assert "Écartée par le consultant" in sides["K", "contre"]


def test_nothing_known_gives_nothing(spark):
    frame = spark.createDataFrame
    offices, links, persons = frame([], OFFICES), frame([], LINKS), frame([], PERSONS)
    kept, brands, listed, none = frame([], KEPT), frame([], BRANDS), frame([], LISTED), frame([], "grp string, siren string")
    found = provenance.evidence(offices, links, persons, kept, brands, listed, none, none)
    doubts = provenance.cases(offices, links, kept, none.withColumn("proof", F.lit("")).withColumn("confidence", F.lit("")), found, listed, none.withColumn("decision", F.lit("")), none.withColumn("rule", F.lit("")), none)
    assert found.isEmpty() and doubts.isEmpty() and provenance.indications(doubts, offices, links, persons, kept, found, listed).isEmpty()


def test_the_rule_that_a_decision_beats_is_kept(spark):
    """B would enter by its mandate in round 2; as it is kept out, C is never met."""
    frame = spark.createDataFrame
    offices = frame([(x, 5710, f"NAME {x}", "11", None) for x in "HABC"], "siren string, cj int, name string, band string, address_key string")
    companies = frame([(x, 5) for x in "HABC"], "siren string, staff int")
    links = frame([("H", "A", "73", None, None), ("A", "B", "73", None, None), ("B", "C", "73", None, None)], LINKS)
    decided = frame([("B", "ecarter"), ("C", "retenir")], "siren string, decision string")
    kept, lost = rules.expand_traced(offices, companies, links, frame([], PERSONS), "H", frame([], "siren string, brand string, kind string"), frame([], "siren string, controlled boolean"), decided)
    assert {r.siren: r.round for r in kept.collect()} == {"H": 0, "A": 1}
    assert [tuple(r) for r in lost.collect()] == [("B", "mandat fort au registre")]
