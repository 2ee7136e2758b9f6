r"""Secret scans through an incremental blob ledger (DataFrame functions only).

Every version of every document is content-addressed (SHA-256 of its bytes).
The ledger keeps, for each blob and rule version, the spans found; a run scans
only the pairs it has not seen, appends them, and joins the ledger back to all
paths, so a text with many copies or versions is scanned once and a new rule
only reads the blobs again, not the history.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.llm.common import fresh_path

LEDGER = "blob binary, rule string, rule_version string, spans array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    name: str
    pattern: str
    group: int
    least: int
    version: str = "1"


#: The base rules. Runs of one class are maximal matches, so their least length can stand in the pattern.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)


def spans_of(text: Column, rule: Rule, kind: int) -> Column:
    """Spans of ``rule``: code points, end exclusive.

    The pieces between matches and the matches alternate, so a match starts
    after the lengths of all pieces up to it and all matches before it.
    """
    pieces = F.split(text, rule.pattern, -1)
    wholes = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = wholes if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    parts = F.arrays_zip(F.slice(pieces, 1, F.size(wholes)).alias("p"), wholes.alias("w"), groups.alias("g"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    state = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["w"])
        hit = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= rule.least, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, state, step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(none)


def address(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def scan_unseen(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what ``ledger`` (a Parquet folder) has not seen of ``versions`` (text, other columns); returns the whole ledger."""
    spark = versions.sparkSession
    texts = versions.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("blob", address(F.col("text")))
    try:
        seen = spark.read.schema(LEDGER).parquet(ledger)
    except Exception as e:  # the first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
        seen = None
    kinds = {r.name: i for i, r in enumerate(RULES)}
    fresh = texts
    done = F.array()
    if seen is not None:
        pairs = seen.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "rule_version")).alias("_done"))
        fresh = texts.join(pairs, "blob", "left").filter(F.size(F.array_except(F.array(*[F.lit(f"{r.name}@{r.version}") for r in rules]), F.coalesce("_done", F.array().cast("array<string>")))) > 0)
        done = F.coalesce("_done", F.array().cast("array<string>"))
    # One text for each blob; copies in a map task are dropped before the shuffle.
    blobs = fresh.groupBy("blob").agg(F.any_value("text").alias("text"), *([F.any_value(done).alias("_done")] if seen is not None else []))
    wanted = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), spans_of(F.col("text"), r, kinds.get(r.name, len(RULES) + i)).alias("spans")) for i, r in enumerate(rules)]
    if seen is not None:
        # A pair that was seen is not scanned: what stands behind a condition is evaluated where it holds.
        wanted = [F.when(~F.array_contains("_done", f"{r.name}@{r.version}"), w) for r, w in zip(rules, wanted, strict=True)]
    blobs.select("blob", F.explode(F.array(*wanted)).alias("f")).filter("f is not null").select("blob", "f.*").write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    name = lambda x: F.element_at(F.array(*[F.lit(r.name) for r in RULES]), x["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob, spans of every row of ``docs``; spans sorted by start, then kind.

    A null text is empty and has no spans; rows with equal text share one blob,
    repeated rows come back as often as they are; texts of any length are scanned
    whole; an empty table gives no rows. Other columns are not read.
    """
    found = scan_unseen(docs.select("text"), ledger, rules)
    keep = reduce(lambda a, b: a | b, [(F.col("rule") == r.name) & (F.col("rule_version") == r.version) for r in rules])
    by_blob = found.filter(keep & (F.size("spans") > 0)).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    paths = docs.select("doc_id", address(F.coalesce(F.col("text"), F.lit(""))).alias("blob"))
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.array_sort(F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>"))).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = secret_spans(docs, fresh_path(spark, "blob-ledger"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    rows = rows.withColumns({"n_assign": count(0), "n_access": count(1), "n_hex": count(2), "_s": joined(F.col("spans"))})
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("_s", 256).alias("base_sha256"), F.col("_s").alias("spans"))


def _sql_spans(name: str, kind: int, pattern: str, group: int, least: int) -> str:
    return f"""
{name} AS (
  SELECT doc_id, rid, unnest(range(1, len(w) + 1)) AS i, w, p, g FROM (
    SELECT doc_id, rid, regexp_extract_all(text, '{pattern}', 0) AS w, regexp_extract_all(text, '{pattern}', {group}) AS g,
      string_split_regex(text, '{pattern}') AS p FROM t)),
{name}_s AS (
  SELECT rid, {kind} AS kind, '{name}' AS kind_name,
    list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS s, length(w[i]) AS n
  FROM {name} WHERE length(g[i]) >= {least})"""


OP7_SQL = (
    "WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),"
    + ",".join(_sql_spans(r.name, i, r.pattern.replace("'", "''"), r.group, r.least) for i, r in enumerate(RULES))
    + """,
every AS (SELECT * FROM assign_s UNION ALL SELECT * FROM access_s UNION ALL SELECT * FROM hex_s),
told AS (
  SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
    string_agg(kind_name || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR), ',' ORDER BY s, kind) AS j
  FROM every GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(j, '')) AS base_sha256, coalesce(j, '') AS spans
FROM t LEFT JOIN told USING (rid)
"""
)
