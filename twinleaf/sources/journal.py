"""The append-only journal of translations, its last-record-wins view, and resumable state.

The journal is a folder or file of JSON lines. Results are true where the journal says so: state is
reconciled with it, never the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "chunk_id string, translations map<string,string>, usage map<string,string>, attempts int, recorded_at string, review struct<reviewer:string,source:string,revised_block_ids:array<string>>"
STATE = "chunk_id string, block_ids array<string>, status string, attempts int, usage map<string,string>, error string, updated_at string"
#: Fixed value: the version of the state's format.
SCHEMA_VERSION = 1
#: The parts of a build's identity.
IDENTITY = ("book_slug", "source_sha256", "glossary_version", "style_version", "provider", "model", "chunk_plan", "prompt_version")
INCONSISTENT = "state says done, the journal lacks blocks: the chunk runs again"


class StaleBuildError(RuntimeError):
    """The state belongs to another source, glossary, style, model or plan."""


def read_lines(spark, path: str) -> DataFrame:
    """line_no, line of a text file, blank lines left out. Files are read whole, so numbers hold."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).select("file", (F.col("n") + 1).alias("line_no"), "line").where("trim(line) != ''")


def read_journal(spark, path: str) -> DataFrame:
    """Records with line_no. A malformed line, or one without chunk_id, fails the read."""
    lines = read_lines(spark, path)
    parsed = lines.select("file", "line_no", F.from_json("line", f"{RECORD}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    where = F.concat_ws(":", F.col("file"), F.col("line_no").cast("string"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    chunk = F.when(bad, F.raise_error(F.concat(where, F.lit(" is no complete record")))).when(F.coalesce("r.chunk_id", F.lit("")) == "", F.raise_error(F.concat(where, F.lit(" has no chunk_id")))).otherwise(F.col("r.chunk_id"))
    return parsed.select(chunk.cast("string").alias("chunk_id"), "r.translations", "r.usage", "r.attempts", "r.recorded_at", "r.review", "line_no")


def last_records(journal: DataFrame, by: str = "line_no", key: str = "chunk_id") -> DataFrame:
    """The last record of each chunk, whole."""
    rest = [c for c in journal.columns if c != key]
    return journal.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def translations(records: DataFrame) -> DataFrame:
    """block_id, zh; of records that hold the same block the latest counts."""
    rows = records.select("line_no", F.explode("translations").alias("block_id", "zh"))
    return rows.groupBy("block_id").agg(F.max_by("zh", "line_no").alias("zh"))


def unknown_records(records: DataFrame, plan: DataFrame) -> DataFrame:
    return records.join(plan, "chunk_id", "left_anti")


def new_state(plan: DataFrame) -> DataFrame:
    """A pending row for each chunk of a plan (chunk_id, block_ids)."""
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return plan.select("chunk_id", "block_ids", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), nothing.alias("usage"), F.lit("").alias("error"), F.lit("").alias("updated_at"))


def identity_changes(old: dict, new: dict) -> list[str]:
    return [k for k in IDENTITY if old.get(k) != new.get(k)]


def check_identity(old: dict, new: dict) -> None:
    if changed := identity_changes(old, new):
        raise StaleBuildError("the build's identity has changed: " + ", ".join(changed))


def check_plan(state: DataFrame, plan: DataFrame) -> None:
    """State and plan must have the same chunks with the same blocks in the same order."""
    a, b = state.select("chunk_id", "block_ids"), plan.select("chunk_id", "block_ids")
    if a.exceptAll(b).union(b.exceptAll(a)).take(1):
        raise StaleBuildError("the chunk plan differs from the state")


def reconcile(state: DataFrame, records: DataFrame, now: str = "") -> DataFrame:
    """State as the journal has it: a complete record makes its chunk done; a chunk that is done
    without one has failed and runs again; the rest stays."""
    r = records.select("chunk_id", F.array_sort(F.map_keys("translations")).alias("_got"), F.col("attempts").alias("_attempts"), F.col("usage").alias("_usage"))
    joined = state.join(r, "chunk_id", "left")
    whole = F.coalesce(F.col("_got") == F.array_sort(F.array_distinct("block_ids")), F.size("block_ids") == 0)
    healed, broken = whole & (F.col("status") != "done"), ~whole & (F.col("status") == "done")

    def pick(name: str, if_healed: Column, if_broken: Column) -> Column:
        return F.when(healed, if_healed).when(broken, if_broken).otherwise(F.col(name)).alias(name)

    return joined.select(
        "chunk_id",
        "block_ids",
        pick("status", F.lit("done"), F.lit("failed")),
        pick("attempts", F.coalesce("_attempts", F.lit(0)), F.lit(0)),
        pick("usage", F.coalesce("_usage", "usage"), F.col("usage")),
        pick("error", F.lit(""), F.lit(INCONSISTENT)),
        pick("updated_at", F.lit(now), F.lit(now)),
    )


def pending(state: DataFrame) -> DataFrame:
    return state.where("status != 'done'")


def total_cost(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """cost: the sum over the last records, of each group of by; what is no number counts for nothing."""
    cost = F.coalesce(F.expr("try_cast(usage['cost'] AS double)"), F.lit(0.0))
    return records.groupBy(*(by or [])).agg(F.coalesce(F.sum(F.when(~F.isnan(cost), cost).otherwise(0.0)), F.lit(0.0)).alias("cost"))
