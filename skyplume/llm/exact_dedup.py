"""Exact deduplication as a stateful stream (DataFrame functions only).

Documents arrive as a stream of small rows: digest of the normalised text,
stable identifier, code points and content locator. A streaming aggregation
keyed by digest keeps, in RocksDB and without expiry, the row that stays and
the number of rows seen; each micro-batch writes what changed. Because the
state never expires, later runs meet the first copy of a text however old.

Texts are never in the state. The locator is the number of the run that brought
the text; ``runs`` says where that run's texts are stored. On a hit full bytes
are compared: the texts of a run are compared with each other behind one
shuffle, and with the text of the row that stood before the run, which is read
from where its locator points. Rows whose bytes differ (a collision of digests)
are grouped by their bytes.

A run may be brought again after a failure at any point: it is known by its
content until it has finished, and its rows are counted once.

A digest with more than ``HOT`` rows (or 1 in 50,000 of all) is dealt out over
salts for the comparison, and its state is broadcast instead of shuffled to;
by their size there are 50,000 such digests at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyplume.llm.common import SPACE, discard, freed_shuffles, fresh_path, move, settled

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a digest beyond which it is dealt out.
HOT = 1000
RUNS = "run int, mark string, content string, batches bigint"
BEST = "best struct<n_points:int,neg_id:bigint,run:int>"


def normalised(text: Column) -> Column:
    """Text without ASCII white space; null: empty."""
    # translate() drops the characters that have no counterpart.
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def sha256_key(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def arrivals(docs: DataFrame, run: int = 0, key=sha256_key) -> DataFrame:
    """What the stream reads of each row. ``rank``: greatest for the row that stays; its ``run`` is the locator."""
    norm = normalised(F.col("text"))
    rank = F.struct(points(F.col("text")).alias("n_points"), (-F.col("doc_id").cast("long")).alias("neg_id"), F.lit(run).alias("run"))
    return docs.select(key(norm).alias("digest"), rank.alias("rank"), sha256_key(norm).alias("sha"))


def stream_keepers(spark: SparkSession, inbox: str, schema, state: str, updates: str, files_per_batch: int = 4096) -> None:
    """Runs the stream over all files now in the folders of ``inbox``; started again with the same folders, it reads the new ones only.

    Each micro-batch overwrites its own folder under ``updates``, so a batch
    that is repeated after a failure leaves one copy.
    """
    # Many small stores: disk space set aside ahead (4 MB a partition) would exceed what they hold.
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        seen = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{inbox}/*")
        kept = seen.groupBy("digest").agg(F.max("rank").alias("best"), F.count("*").alias("n_rows"))
        query = (
            kept.writeStream.outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{updates}/batch={i}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet rows under ``path``; none if nothing is there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def changes(spark: SparkSession, home: str) -> DataFrame:
    return stored(spark, f"{home}/updates", f"digest binary, {BEST}, n_rows bigint, batch bigint")


def keepers(spark: SparkSession, home: str, batches: int | None = None) -> DataFrame:
    """(digest, best, n_rows) of every digest that the runs under ``home`` have seen, or that they had seen after some ``batches``."""
    changed = changes(spark, home)
    if batches is not None:
        changed = changed.filter(F.col("batch") < batches)
    # State only grows, so a digest's last update is its greatest.
    return changed.groupBy("digest").agg(F.max("best").alias("best"), F.max("n_rows").alias("n_rows"))


class Run:
    """One run over ``docs``: brings them to the state under ``home`` and decides on each row.

    ``content`` is a Parquet folder that has the rows' doc_id and text, for later
    runs to read; where it is None and ``home`` is given, they are written under
    ``home``. Without ``home`` the run starts an empty state of its own.
    """

    def __init__(self, docs: DataFrame, home: str | None = None, content: str | None = None, key=sha256_key, hot: int = HOT, files_per_batch: int = 4096):
        self.spark, self.key, self.alone = docs.sparkSession, key, home is None
        self.docs, self.home = docs.select("doc_id", "text"), home or fresh_path(docs.sparkSession, "dedup")
        spark = self.spark
        # One row a run.
        self.runs = {} if self.alone else {r["run"]: r for r in stored(spark, f"{self.home}/runs", RUNS).collect()}
        self.content = {k: r["content"] for k, r in self.runs.items()}
        self.number = len(self.runs)
        schema = arrivals(self.docs, 0, key).schema
        stream = lambda: stream_keepers(spark, f"{self.home}/inbox", schema, f"{self.home}/state", f"{self.home}/updates", files_per_batch)
        if self.alone:
            arrivals(self.docs, 0, key).write.parquet(self.inbox())
        else:
            self.enter(content, stream)
        self.before = settled(keepers(spark, self.home, self.runs[self.number]["batches"])) if self.number else None
        stream()
        self.arrived = spark.read.schema(schema).parquet(self.inbox())
        self.keepers = settled(keepers(spark, self.home))
        self.limit = max(hot, (self.keepers.agg(F.sum("n_rows")).first()[0] or 0) // 50_000)
        self.hot = settled(self.keepers.filter(F.col("n_rows") > self.limit))

    def inbox(self) -> str:
        return f"{self.home}/inbox/run-{self.number}"

    def enter(self, content: str | None, stream: Callable[[], None]) -> None:
        """Brings the rows to the inbox and registers the run, so that the same rows brought again after a failure are the same run.

        Rows are written aside first and marked by their content. A run that was
        registered with this mark and never finished is taken up where it stood:
        its rows are in the inbox, and the stream knows which of them it has
        counted. Otherwise they become the next run, after the stream has counted
        what unfinished ones have left; what an attempt left in the next run's place
        before it was registered has not been streamed and is replaced.
        """
        spark, aside = self.spark, f"{self.home}/aside/{uuid.uuid4().hex}"
        arrivals(self.docs, self.number, self.key).write.parquet(aside)
        told = [F.sum(F.xxhash64(F.lit(seed), "digest", "rank.n_points", "rank.neg_id").cast("decimal(38,0)")) for seed in (1, 2)]
        mark = ":".join(map(str, spark.read.parquet(aside).agg(F.count("*"), *told).first()))
        done = {r["run"] for r in stored(spark, f"{self.home}/finished", "run int").collect()}
        open_ = [k for k, r in self.runs.items() if r["mark"] == mark and k not in done]
        if open_:
            self.number = open_[0]
            discard(spark, aside)
            return
        discard(spark, self.inbox())
        if set(self.runs) - done:
            stream()
        if not content:
            content = f"{self.home}/content/run-{self.number}"
            self.docs.write.mode("overwrite").parquet(content)
        move(spark, aside, self.inbox())
        batches = changes(spark, self.home).agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]
        row = spark.createDataFrame([(self.number, mark, content, batches)], RUNS)
        row.coalesce(1).write.mode("append").parquet(f"{self.home}/runs")
        self.runs[self.number], self.content[self.number] = row.first(), content

    def close(self) -> None:
        """Marks the run as finished; one without a home leaves nothing."""
        if self.alone:
            discard(self.spark, self.home)
        else:
            self.spark.createDataFrame([(self.number,)], "run int").coalesce(1).write.mode("append").parquet(f"{self.home}/finished")

    def texts(self, docs: DataFrame, run: int) -> DataFrame:
        return docs.select(self.key(normalised(F.col("text"))).alias("digest"), normalised(F.col("text")).alias("norm"), F.col("doc_id").cast("long").alias("doc_id"), points(F.col("text")).alias("n_points"), F.lit(run).alias("run"))

    def earlier(self, run: int) -> DataFrame:
        return self.texts(self.spark.read.schema("doc_id long, text string").parquet(self.content[run]), run)

    def collisions(self) -> DataFrame:
        """Digests whose rows' bytes are not all equal, or not those of the row that stood before the run; those of earlier runs among them."""
        salts = F.ceil(F.col("n_rows") / self.limit).cast("int")
        hot = F.broadcast(self.hot.select(F.col("digest").alias("_d"), salts.alias("salts")))  # 50,000 rows at most
        rows = self.texts(self.docs, self.number).select("digest", "norm").join(hot, F.col("digest") == F.col("_d"), "left")
        rows = rows.select("digest", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("salts")), F.lit(0)).cast("int").alias("salt"), "norm")
        if self.before is not None:
            stood = self.before.join(self.arrived.select("digest").distinct(), "digest").select(F.col("digest").alias("_k"), F.col("best.run").alias("_run"), (-F.col("best.neg_id")).alias("_id"), F.col("best.n_points").alias("_n"))
            for run in sorted(r["_run"] for r in stood.select("_run").distinct().collect()):
                old = self.earlier(run).join(stood.filter(F.col("_run") == run), (F.col("digest") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("n_points") == F.col("_n"))).select("digest", "norm")
                old = old.join(hot, F.col("digest") == F.col("_d"), "left")
                rows = rows.union(old.select("digest", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), "norm"))
        first = F.first("norm").over(W.partitionBy("digest", "salt").orderBy("digest"))
        part = rows.withColumn("first", first).groupBy("digest", "salt").agg(F.bool_or(F.col("norm") != F.col("first")).alias("bad"), F.first("first").alias("first"))
        # What is left of a digest are its salts' first texts.
        part = settled(part.join(hot, F.col("digest") == F.col("_d"), "left").select("digest", "bad", F.when(F.col("salts") > 1, F.col("first")).alias("first")))
        apart = part.filter("first is not null").groupBy("digest").agg((F.min("first") != F.max("first")).alias("bad")).filter("bad")
        found = part.filter("bad").select("digest").union(apart.select("digest"))
        # Once different texts share a digest they do so in all later runs.
        if self.number:
            found = found.union(stored(self.spark, f"{self.home}/collisions", "digest binary"))
        found = settled(found.distinct())
        if not self.alone:
            found.write.mode("append").parquet(f"{self.home}/collisions")
        return found

    def decided(self) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) of every row of the run."""
        state = self.keepers.select(F.col("digest").alias("_k"), "best", "n_rows")
        hot = F.broadcast(self.hot.select(F.col("digest").alias("_k"), "best", "n_rows"))
        rows = self.arrived.join(hot, F.col("digest") == F.col("_k"))
        rows = rows.union(self.arrived.join(hot.select("_k"), F.col("digest") == F.col("_k"), "left_anti").join(state.filter(F.col("n_rows") <= self.limit), F.col("digest") == F.col("_k")))
        same = F.col("rank.neg_id").eqNullSafe(F.col("best.neg_id")) & (F.col("rank.n_points") == F.col("best.n_points"))
        rows = rows.select("digest", (-F.col("rank.neg_id")).alias("doc_id"), (-F.col("best.neg_id")).alias("keep_id"), F.col("n_rows").alias("group_size"), same.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
        bad = self.collisions()
        if bad.isEmpty():
            return rows.drop("digest")
        odd, best = self.regrouped(bad)
        mine = odd.filter(F.col("run") == self.number).join(best, ["digest", "norm"])
        kept = F.col("doc_id").eqNullSafe(-F.col("best.neg_id")) & (F.col("n_points") == F.col("best.n_points"))
        return rows.join(bad, "digest", "left_anti").drop("digest").union(mine.select("doc_id", -F.col("best.neg_id"), "n", kept, F.sha2("norm", 256)))

    def regrouped(self, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All runs' texts of the digests ``bad``, and the row that stays by digest and bytes."""
        runs = [self.texts(self.docs, self.number), *[self.earlier(k) for k in self.content if k != self.number]]
        odd = reduce(DataFrame.union, runs).join(bad, "digest")
        return odd, odd.groupBy("digest", "norm").agg(F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg_id"))).alias("best"), F.count("*").alias("n"))


def exact_groups(docs: DataFrame, home: str | None = None, content: str | None = None, key=sha256_key, hot: int = HOT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``.

    Equal texts: identical once ASCII white space is deleted; null counts as
    empty, so null and blank texts are one group. The row with the most code
    points stays, then the smallest doc_id; a null doc_id comes last. Repeated
    rows (same doc_id and text as the row that stays) are all marked as kept:
    they are that document. With a ``home`` groups reach over all runs so far.
    Texts of any length are compared whole; an empty table gives no rows; other
    columns are not read, whatever they are called.
    """
    with freed_shuffles(docs.sparkSession):
        run = Run(docs, home, content, key, hot)
        out = settled(run.decided())
    run.close()
    return out


def keep_first(docs: DataFrame, key=sha256_key, hot: int = HOT) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns as they were, whatever they are called.

    The row that stays is that of ``exact_groups``; of repeated rows any one.
    """
    with freed_shuffles(docs.sparkSession):
        run = Run(docs, key=key, hot=hot)
        bad = run.collisions()
        stays = run.keepers.join(bad, "digest", "left_anti").select("digest", "best.n_points", "best.neg_id", F.lit(b"").alias("bytes"))
        collide = not bad.isEmpty()
        if collide:
            stays = stays.union(run.regrouped(bad)[1].select("digest", "best.n_points", "best.neg_id", F.col("norm").cast("binary")))
        stays = settled(stays.select("digest", "n_points", F.col("neg_id").isNotNull().alias("known"), F.coalesce("neg_id", F.lit(0)).alias("neg_id"), "bytes"))
    norm = normalised(F.col("text"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key(norm).alias("digest"), points(F.col("text")).alias("n_points"), F.col("doc_id").isNotNull().alias("known"), F.coalesce(-F.col("doc_id").cast("long"), F.lit(0)).alias("neg_id"), norm.alias("norm"))
    if collide:
        rows = rows.join(bad.withColumn("bad", F.lit(True)), "digest", "left").withColumn("bytes", F.when(F.col("bad"), F.col("norm").cast("binary")).otherwise(F.lit(b"")))
    else:
        rows = rows.withColumn("bytes", F.lit(b""))
    # By id as well, so that the copies of a text are dealt out.
    keys = ["digest", "n_points", "known", "neg_id", "bytes"]
    out = rows.select("row", *keys).join(stays, keys, "left_semi").dropDuplicates(keys).select("row.*")
    run.close()
    return out


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    return exact_groups(spark.read.parquet(path), content=path)


OP3_SQL = f"""
WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, max({{'p': points, 'i': -doc_id}}) AS best FROM n GROUP BY norm)
SELECT n.doc_id, -(g.best.i) AS keep_id, g.group_size, n.doc_id = -(g.best.i) AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
