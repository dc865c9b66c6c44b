"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

Line keys (128-bit hashes) come in batches. The runs hold each key seen so far once, with the number of its documents in the
batch that brought it and the largest id among them. A new batch is merge-anti-joined with the runs: keys that are new make a
sorted run of level 0, the others go to a log of repeats. FAN runs of a level are merged into one run of the next, so a batch
meets few runs, and a key is rewritten once a level. At the end the runs and the log's sums give each key's number of documents
and largest id.

Runs and batches are tables in hash buckets, one sorted file each, so merges read them in order: no run is shuffled or sorted
again. Keys are made once and stored with the numbered rows, and travel as hashes, aggregated by batch before any shuffle; a line
that every document holds is one row a task. Lines that very many documents hold are met by broadcast of a bounded number of
them (common.meet). Texts are shuffled once, to meet the places of their dropped lines.

Defined results: a null or empty text is one empty line, and a very long one any number of them. Each row is a document; rows that
repeat the largest id keep a line both. A null id is never the largest, unless all are null. Only the named columns are read, so
others can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groupforge.plans.storage import ordered_buckets

from .common import ROW, SPACES, Scratch, by_row, documents, meet

LEAST_CHARS, LEAST_DOCS = 20, 3
#: A batch holds at most about BATCH_DOCS documents, and there are at least BATCHES.
BATCHES, BATCH_DOCS, FAN = 4, 1 << 28, 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """The line without outer white space, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _hashed(text: Column, least_chars: int) -> Column:
    """Places and hashes of a text's lines whose keys are long enough; each key is made once."""

    def one(k: Column, place: Column) -> Column:
        return F.struct(place.alias("place"), F.length(k).alias("chars"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))

    return F.filter(F.transform(F.transform(lines(text), key), one), lambda x: x["chars"] >= least_chars)


class Runs:
    """Sorted runs of disjoint keys, by level; each is a table of hash buckets."""

    def __init__(self, scratch: Scratch, fan: int = FAN):
        self.scratch, self.fan, self.spark = scratch, fan, scratch.spark
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def write(self, rows: DataFrame, name: str, dealt: bool = False) -> str:
        """A table of rows by h1, h2 in sorted buckets; dealt: each of rows' partitions already is a bucket in order."""
        table = f"groupforge_{name}_{uuid.uuid4().hex}"
        if not dealt:
            rows = rows.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2")
        writer = rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("compression", "zstd")
        self.paths[table] = self.scratch.path(name)
        writer.option("path", self.paths[table]).saveAsTable(table)
        return table

    def read(self, table: str) -> DataFrame:
        return self.spark.table(table)

    def drop(self, table: str) -> None:
        self.spark.sql(f"drop table if exists {table}")
        self.scratch.drop(self.paths.pop(table))

    def close(self) -> None:
        for table in list(self.paths):
            self.drop(table)

    def all(self) -> list[DataFrame]:
        return [self.read(t) for level in self.levels for t in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of a sorted batch whose keys no run holds: merges only."""
        for run in self.all():
            batch = batch.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, new: DataFrame, dealt: bool = False) -> DataFrame:
        """Writes a run of keys that no run holds yet and gives it back."""
        table = self.write(new, "run0", dealt)
        self._put(0, table)
        return self.read(table)

    def _put(self, level: int, table: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def compact(self) -> None:
        """Merges the runs of each full level, bucket by bucket: an outer merge join of disjoint keys keeps their order."""
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fan:
                tables, self.levels[level] = self.levels[level], []
                merged = self.read(tables[0])
                for t in tables[1:]:
                    other = self.read(t).toDF("h1", "h2", "n2", "last2").hint("merge")
                    merged = merged.join(other, ["h1", "h2"], "full_outer").select("h1", "h2", F.coalesce("n", "n2").alias("n"), F.coalesce("last", "last2").alias("last"))
                self._put(level + 1, self.write(merged, f"run{level + 1}", dealt=True))
                for t in tables:
                    self.drop(t)


def marked(docs: DataFrame, id_col: str, text_col: str, least_chars: int, scratch: Scratch) -> DataFrame:
    """One written row per row of docs: its number, id, text, and the places and hashes of its longer lines."""
    number = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    rows = docs.select(number.alias(ROW), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return scratch.stage(rows.withColumn("keys", F.transform(_hashed(F.col("text"), least_chars), lambda x: F.struct(x["place"].alias("place"), x["h1"].alias("h1"), x["h2"].alias("h2")))), "marked")


def frequent(marks: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """Keys of at least least_docs rows of marked(): h1, h2, n (those rows), last (the largest id that holds the key)."""
    spark = scratch.spark
    batches = max(batches, -(-marks.count() // BATCH_DOCS))
    own = F.array_distinct(F.transform("keys", lambda x: F.struct(x["h1"], x["h2"])))
    rows = marks.select("id", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"), F.explode(own).alias("k"))
    entries = rows.groupBy("batch", "k.h1", "k.h2").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    entries_path = scratch.write(entries, "entries", ["batch"])
    shape = f"h1 long, h2 long, n long, last {marks.schema['id'].dataType.simpleString()}"
    entries = spark.read.schema(shape + ", batch int").parquet(entries_path)
    runs, log = Runs(scratch), []
    try:
        with ordered_buckets(spark):
            for b in range(batches):
                coming = entries.where(F.col("batch") == b).drop("batch")
                if not any(runs.levels):
                    runs.add(coming)
                    continue
                batch = runs.write(coming, "batch")
                new = runs.add(runs.fresh(runs.read(batch)), dealt=True)
                log.append(scratch.stage(runs.read(batch).join(new.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti"), "repeats"))
                runs.drop(batch)
                runs.compact()
            keys = runs.all()[0]
            for run in runs.all()[1:]:
                keys = keys.unionByName(run)
            for more in log:
                keys = keys.unionByName(more)
            keys = keys.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
            found = scratch.stage(keys.where(F.col("n") >= least_docs), "frequent")
    finally:
        runs.close()
    scratch.drop(entries_path, *log)
    return found


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, **more) -> DataFrame:
    """One row per row of docs: row, id, n_lines, n_dropped, text (the lines that stay)."""
    scratch = Scratch(docs.sparkSession, "lines")
    marks = marked(docs, id_col, text_col, least_chars, scratch)
    hot = frequent(marks, scratch, **more)
    total = marks.agg(F.sum(F.size("keys"))).first()[0] or 0
    places = marks.select(F.col(ROW).alias("row"), "id", F.explode("keys").alias("k")).select("row", "id", "k.place", "k.h1", "k.h2")
    places = meet(places, hot, ["h1", "h2"], "n", total).where(~F.col("id").eqNullSafe(F.col("last")))
    away = scratch.stage(places.groupBy("row").agg(F.sort_array(F.collect_list("place")).alias("away")), "places")
    met = by_row(marks.select(F.col(ROW).alias("row"), "id", "text"), away, "row", "left").withColumn("away", F.coalesce("away", F.array().cast("array<int>")))
    met = met.withColumn("all", lines(F.col("text")))
    ends = F.concat(F.array(F.lit(-1)), F.col("away"), F.array(F.size("all")))
    gaps = F.transform(F.sequence(F.lit(0), F.size("away")), lambda i: F.slice(F.col("all"), F.col("ends")[i] + 2, F.col("ends")[i + 1] - F.col("ends")[i] - 1))
    met = met.withColumn("ends", ends).withColumn("stay", F.array_join(F.flatten(gaps), "\n"))
    return met.select("row", "id", F.size("all").cast("long").alias("n_lines"), F.size("away").cast("long").alias("n_dropped"), F.col("stay").alias("text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dropped(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
l AS (SELECT r, doc_id, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS pos FROM d),
k AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM l),
hot AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
m AS (SELECT k.*, h.key IS NOT NULL AND h.last IS DISTINCT FROM k.doc_id AS away FROM k LEFT JOIN hot h ON k.key = h.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE away) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT away), '')) AS kept_sha256
FROM m GROUP BY r
"""
