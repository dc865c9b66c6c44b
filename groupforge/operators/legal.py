"""Daily deliveries of legal units and head offices: all is read, reduced to the last record of each company, then applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupforge.operators.changes import differs, last_of_batch
from groupforge.plans.storage import Release

UNIT = ("denomination", "acronym", "usual_name", "cj", "band", "state", "stated", "hidden")
FOLLOWS, KEEPS = ("acronym", "usual_name", "band"), ("denomination", "cj", "state")
OFFICE = ("siret", "address_key", "name", "cj", "naf", "band", "town", "postcode")


def _met(table: DataFrame, batch: DataFrame, columns: tuple[str, ...], place: str) -> DataFrame:
    """table beside the last record of each company, whose columns begin with n_."""
    last = last_of_batch(batch, "siren", columns, place)
    new = last.select("siren", *[F.col(c).alias(f"n_{c}") for c in columns], F.lit(True).alias("has_new"))
    return table.withColumn("has_old", F.lit(True)).join(new, "siren", "full_outer")


def merge_status(companies: DataFrame, batch: DataFrame, day: str, place: str = "place") -> DataFrame:
    """siren, denomination, hidden, state, opened, closed, change: companies after a delivery of legal units.

    A unit that ceases closes its company on the day stated (the delivery's day without one), not before it opened; one that is active
    again opens it again; one that is not known is added if active. What the delivery doesn't say stays.
    """
    today = F.lit(day).cast("date")
    met = _met(companies.select("siren", "denomination", "hidden", "state", "opened", "closed"), batch, UNIT, place)
    met = met.where("has_old or n_state = 'A'")
    hidden, state = F.coalesce("n_hidden", "hidden"), F.coalesce("n_state", "state")
    ceases = F.coalesce((F.col("n_state") == "C") & ~F.col("state").eqNullSafe("C") & F.col("closed").isNull(), F.lit(False))
    back = F.coalesce((F.col("n_state") == "A") & (F.col("state") == "C") & F.col("closed").isNotNull(), F.lit(False))
    closed = F.when(ceases, F.greatest("opened", F.coalesce("n_stated", today))).when(~back, F.col("closed"))
    changed = differs([(F.col("hidden"), hidden), (F.col("state"), state)])
    change = F.when(F.col("has_old").isNull(), "inserted").when(ceases, "closed").when(back, "reopened").when(changed, "updated").otherwise("none")
    return met.select("siren", F.coalesce("denomination", "n_denomination").alias("denomination"), hidden.alias("hidden"), state.alias("state"), F.coalesce("opened", today).alias("opened"), closed.alias("closed"), change.alias("change"))


def merge_units(units: DataFrame, batch: DataFrame, place: str = "place") -> DataFrame:
    """siren, the columns of FOLLOWS and KEEPS, change: legal units after a delivery. A hidden unit keeps what the delivery lacks; names,
    categories and states are never emptied; sole traders and units without a category are not added."""
    met = _met(units.select("siren", *FOLLOWS, *KEEPS), batch, UNIT, place)
    met = met.where("has_old or n_cj <> 1000")
    known = F.col("has_new").isNull()
    new = {c: F.when(known, F.col(c)).when(F.col("n_hidden"), F.coalesce(f"n_{c}", c)).otherwise(F.col(f"n_{c}")) for c in FOLLOWS} | {c: F.coalesce(f"n_{c}", c) for c in KEEPS}
    change = F.when(F.col("has_old").isNull(), "inserted").when(differs([(F.col(c), v) for c, v in new.items()]), "updated").otherwise("none")
    return met.select("siren", *[v.alias(c) for c, v in new.items()], change.alias("change"))


def merge_offices(offices: DataFrame, batch: DataFrame, place: str = "place") -> DataFrame:
    """siren, the columns of OFFICE, change: head offices after a delivery. Only active ones count, and none is ever deleted."""
    met = _met(offices.select("siren", *OFFICE), batch.where("active"), OFFICE, place)
    known = F.col("has_new").isNull()
    new = {c: F.when(known, F.col(c)).otherwise(F.col(f"n_{c}")) for c in OFFICE}
    change = F.when(F.col("has_old").isNull(), "inserted").when(differs([(F.col(c), v) for c, v in new.items()]), "updated").otherwise("none")
    return met.select("siren", *[v.alias(c) for c, v in new.items()], change.alias("change"))


def deliver(release: Release, units: DataFrame, offices: DataFrame, after: int) -> int:
    """Merges a day's deliveries of units and offices into the tables `units` and `offices` of a release and commits both as one."""
    known = release.read("units"), release.read("offices")
    return release.commit({"units": merge_units(known[0], units).drop("change"), "offices": merge_offices(known[1], offices).drop("change")}, after)
