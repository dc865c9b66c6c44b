"""Change capture on tables whose rows are closed, never deleted. Applying a delivery twice changes nothing the second time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(records: DataFrame, key: str, updated: str, *ties: str) -> DataFrame:
    """The newest record of each key; ties go by the columns named, smallest first."""
    rest = [c for c in records.columns if c not in {key, updated, *ties}]
    order = F.struct((-F.unix_micros(F.col(updated).cast("timestamp"))).alias("age"), *ties, *rest)
    best = records.groupBy(key).agg(F.min(order).alias("r"), F.max(updated).alias(updated))
    return best.select(key, *[F.col("r")[c].alias(c) for c in (*ties, *rest)], updated)


def differs(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a | b, [~x.eqNullSafe(y) for x, y in pairs])


def last_of_batch(batch: DataFrame, key: str, columns: tuple[str, ...], place: str = "place") -> DataFrame:
    """key and columns: one record of each key, the one that comes last in the delivery."""
    order = F.struct(*([place] if place in batch.columns else []), *columns)
    return batch.groupBy(key).agg(F.max(order).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in columns])


def merge_companies(companies: DataFrame, batch: DataFrame, day: str) -> DataFrame:
    """siren, denomination, commercial, staff, opened, closed, change: the table after the delivery.

    Names and consent keep their value where the delivery has none; staff follows it. Struck companies close, others reopen.
    change: inserted, closed, reopened, updated or none. Of several records of a company in one delivery the last one counts: the highest
    `place` if the delivery has that column, else the greatest by value.
    """
    b = last_of_batch(batch, "siren", ("denomination", "commercial", "staff", "struck"))
    b = b.select("siren", *[F.col(c).alias(f"n_{c}") for c in ("denomination", "commercial", "staff", "struck")], F.lit(True).alias("has_new"))
    met = companies.select("siren", "denomination", "commercial", "staff", "opened", "closed").withColumn("has_old", F.lit(True)).join(b, "siren", "full_outer")
    name, consent = F.coalesce("n_denomination", "denomination"), F.coalesce("n_commercial", "commercial")
    staff = F.when(F.col("has_new"), F.col("n_staff")).otherwise(F.col("staff"))
    today, struck = F.lit(day).cast("date"), F.coalesce("n_struck", F.lit(False))
    closed = F.when(F.col("has_new").isNull(), F.col("closed")).when(struck, F.coalesce("closed", today))
    changed = differs([(F.col("denomination"), name), (F.col("commercial"), consent), (F.col("staff"), staff)])
    change = (
        F.when(F.col("has_old").isNull(), "inserted").when(F.col("has_new").isNull(), "none").when(struck & F.col("closed").isNull(), "closed")
        .when(~struck & F.col("closed").isNotNull(), "reopened").when(changed, "updated").otherwise("none")
    )
    return met.select("siren", name.alias("denomination"), consent.alias("commercial"), staff.alias("staff"), F.coalesce("opened", today).alias("opened"), closed.alias("closed"), change.alias("change"))


def merge_edges(edges: DataFrame, batch: DataFrame, owners: DataFrame, day: str, owner: str = "child", keys: tuple[str, ...] = ("parent", "child", "role")) -> DataFrame:
    """keys, opened, closed, change: open rows that the full state of their owner lacks close; rows of the state that are not open open.

    owners: the owner keys that the delivery covers. Null keys compare as equal. Duplicates close together.
    """
    today = F.lit(day).cast("date")

    def meets(a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])

    state, covered = batch.select(*keys), owners.select(F.col(owner)).distinct().withColumn("covered", F.lit(True))
    old = edges.select(*keys, "opened", "closed").join(covered, owner, "left")
    seen = state.distinct()
    marked = old.join(seen.withColumn("there", F.lit(True)), meets(old, seen), "left").select(*[old[k] for k in keys], "opened", "closed", "covered", "there")
    closes = F.col("closed").isNull() & F.coalesce("covered", F.lit(False)) & F.col("there").isNull()
    kept = marked.select(*keys, "opened", F.when(closes, today).otherwise(F.col("closed")).alias("closed"), F.when(closes, "closed").otherwise("none").alias("change"))
    open_ = edges.where("closed is null").select(*keys).distinct()
    fresh = state.join(open_, meets(state, open_), "left_anti").select(*keys, today.alias("opened"), F.lit(None).cast("date").alias("closed"), F.lit("opened").alias("change"))
    return kept.unionByName(fresh)


def masked(units: DataFrame, batch: DataFrame, follows: tuple[str, ...], keeps: tuple[str, ...]) -> DataFrame:
    """The table after a delivery whose masked values are null: a hidden unit keeps what is known, others follow the delivery; `keeps`
    columns are never emptied. changed tells whether a row differs."""
    b = batch.select("siren", "hidden", *[F.col(c).alias(f"n_{c}") for c in (*follows, *keeps)], F.lit(True).alias("has_new"))
    met = units.join(b, "siren", "left")
    new = {c: F.when(F.col("has_new").isNull(), F.col(c)).when(F.col("hidden"), F.coalesce(f"n_{c}", c)).otherwise(F.col(f"n_{c}")) for c in follows}
    new |= {c: F.coalesce(f"n_{c}", c) for c in keeps}
    return met.select("siren", *[v.alias(c) for c, v in new.items()], differs([(F.col(c), v) for c, v in new.items()]).alias("changed"))


def tally(merged: DataFrame) -> DataFrame:
    """change, n: what a delivery would do, without writing."""
    return merged.groupBy("change").agg(F.count("*").alias("n"))


def data_date(links: DataFrame, companies: DataFrame) -> DataFrame:
    """The latest date that the register carries."""
    dates = links.select("opened", "closed").unionByName(companies.select("opened", "closed"))
    return dates.agg(F.max(F.greatest("opened", F.coalesce("closed", "opened"))).alias("data_date"))


def deposit(registry: DataFrame, new: DataFrame, when: str) -> DataFrame:
    """head, sha256, since, until, change: one document in force for each head. The same content again changes nothing; another closes the one
    in force and opens. registry: head, sha256, since, until; new: head, sha256."""
    now = F.lit(when).cast("timestamp")
    fresh = new.select("head", "sha256").distinct()
    in_force = registry.where("until is null").select("head", "sha256")
    opens = fresh.join(in_force, ["head", "sha256"], "left_anti")
    closing = opens.select("head").distinct().withColumn("closing", F.lit(True))
    met = registry.join(closing, "head", "left").withColumn("closes", F.col("until").isNull() & F.coalesce("closing", F.lit(False)))
    kept = met.select("head", "sha256", "since", F.when(F.col("closes"), now).otherwise(F.col("until")).alias("until"), F.when(F.col("closes"), "closed").otherwise("none").alias("change"))
    return kept.unionByName(opens.select("head", "sha256", now.alias("since"), F.lit(None).cast("timestamp").alias("until"), F.lit("opened").alias("change")))


def days_to_read(last: str, today: str, spark, most: int = 7) -> DataFrame:
    """day: the days after `last` up to yesterday, at most `most` of the latest."""
    days = f"select explode(sequence(greatest(date_add(date'{last}', 1), date_add(date'{today}', -{int(most)})), date_add(date'{today}', -1))) as day"
    return spark.sql(days if last < today else "select date'1970-01-01' as day").where(F.col("day").between(F.lit(last).cast("date") + F.expr("interval 1 day"), F.lit(today).cast("date") - F.expr("interval 1 day")))


def fresh(sources: DataFrame, today: str, most: int = 7) -> DataFrame:
    """source, day, age, fresh: the latest whole day of each source; a date in the future is stale."""
    last = sources.groupBy("source").agg(F.max("day").alias("day"))
    age = F.datediff(F.lit(today).cast("date"), F.col("day"))
    return last.select("source", "day", age.cast("long").alias("age"), age.between(0, most).alias("fresh"))


def stale(journal: DataFrame, own: str, feed: str) -> DataFrame:
    """stale, changes: whether what the source `own` computed is out of date: never computed, its last finished run failed, or the runs of `feed`
    since then added or closed rows. journal: id, source, status (en_cours, succes or another), added, closed."""
    last = journal.where((F.col("source") == own) & (F.col("status") != "en_cours")).agg(F.max(F.struct("id", "status")).alias("l"))
    since = journal.where(F.col("source") == feed).join(F.broadcast(last.select(F.coalesce("l.id", F.lit(-1)).alias("last"))), F.col("id") > F.col("last"))
    total = since.agg(F.coalesce(F.sum(F.coalesce("added", F.lit(0)) + F.coalesce("closed", F.lit(0))), F.lit(0)).alias("changes"))
    met = total.join(F.broadcast(last))  # one row each
    return met.select((~F.coalesce(F.col("l.status") == "succes", F.lit(False)) | (F.col("changes") > 0)).alias("stale"), "changes")


def set_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of one side only, with side: before or after. Both have the same columns; nulls are equal."""
    columns = before.columns
    both = before.distinct().withColumn("_b", F.lit(1)).unionByName(after.distinct().withColumn("_b", F.lit(2)))
    return both.groupBy(*columns).agg(F.sum("_b").alias("_b")).where("_b < 3").select(*columns, F.when(F.col("_b") == 1, "before").otherwise("after").alias("side"))


def drawn(batch: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a delivery for the first company at or above each of a few drawn keys; a key above all draws none."""
    firsts = batch.agg(*[F.min(F.when(F.col("siren") >= k, F.col("siren"))).alias(f"k{i}") for i, k in enumerate(keys)])
    wanted = firsts.select(F.explode(F.array(*[F.col(f"k{i}") for i in range(len(keys))])).alias("siren")).where("siren is not null").distinct()
    return batch.join(F.broadcast(wanted), "siren", "left_semi")  # as many rows as keys


def present(sample: DataFrame, replayed: DataFrame) -> DataFrame:
    """siren, present: whether a drawn company's records are in the register already: replaying them, without writing, changes nothing.

    replayed: siren, change of the table after the sample. One that the replay has no row for (it isn't of the register's kind) is present.
    """
    moved = replayed.where("change <> 'none'").select("siren").distinct().withColumn("moved", F.lit(True))
    return sample.select("siren").distinct().join(moved, "siren", "left").select("siren", F.col("moved").isNull().alias("present"))
