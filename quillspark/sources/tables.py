"""Sources and sinks (S1-S8): outputs and cases as JSON lines, snapshots, source corpora, stored tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.integrity import fresh_cases
from quillspark.storage import exists

OUTPUT = "case_index bigint, text string, error string, input_tokens bigint, output_tokens bigint"
CASE = "id string, prompt_site_id string, inputs map<string,string>, expected string, tags array<string>, source string, notes string"
#: The stored tables and their schemas; keys are checked by ``integrity.key_violations``.
SCHEMAS = {
    "prompts": "id string, name string, provider string, file string, line int, purpose string, confidence string, payload string, first_seen_at timestamp, last_seen_at timestamp",
    "pipelines": "id string, name string, nodes array<string>, entries array<string>, exits array<string>, first_seen_at timestamp, last_seen_at timestamp",
    "prompt_versions": "prompt_id string, version bigint, template string, parent_version bigint, created_by string, note string, created_at timestamp",
    "runs": "id string, target_kind string, target_id string, target_version bigint, status string, n_cases bigint, cost_usd double, started_at timestamp, finished_at timestamp",
    "scores": "run_id string, case_index bigint, judge_kind string, judge_name string, score double, critique string",
    "feedback": "id bigint, run_id string, case_index bigint, rating int, critique string, created_at timestamp",
    "providers_detected": "project_root string, provider string, file string, key_var_name string, source string, line int, detected_at timestamp",
    "iterations": "id string, prompt_id string, session_id string, round int, weighted_score double, per_dim map<string,double>, revise_mode string, converged_reason string, new_version bigint, downstream_status map<string,string>, started_at timestamp",
}


def read_outputs(spark: SparkSession, path: str, schema: str = OUTPUT) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` lines of run outputs under ``path``, with the run from the folder ``run_id=...``.

    Lines that are no JSON or have a field of the wrong type are in ``bad``, as they stand; blank lines
    are neither. One pass each; nothing is cached. A path that is not there has no rows.
    """
    if exists(spark, path):
        found = spark.read.option("recursiveFileLookup", "true").text(path)
        lines = found.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), r"run_id=([^/]+)/", 1))
    else:
        lines = spark.createDataFrame([], "value string, run_id string")
    read = lines.where("trim(value) <> ''").select(
        "run_id", "value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_r")
    )
    return read.where("_r._bad is null").select("run_id", "_r.*").drop("_bad"), read.where("_r._bad is not null").select("run_id", F.col("value").alias("line"))


def write_outputs(df: DataFrame, path: str) -> None:
    """Outputs as JSON lines, a folder a run; errors are rows like any other.

    A run without cases has no folder; that it ran is told by its row in ``runs``.
    """
    df.write.mode("append").partitionBy("run_id").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """S3: cases from JSON lines; lines that do not fit the schema, or have no id, are left out. No path, no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], CASE)
    whole = spark.read.schema(f"{CASE}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return whole.where("_bad is null and id is not null").drop("_bad")


def append_cases(df: DataFrame, path: str, existing: DataFrame) -> None:
    """Append the cases that are not stored yet; one writer a path."""
    fresh_cases(df, existing).write.mode("append").json(path)


def write_snapshot(df: DataFrame, path: str, scan_id: str) -> None:
    """One scan's rows; a repeated write of a scan replaces that scan alone."""
    df.write.mode("overwrite").parquet(f"{path}/scan_id={scan_id}")


def read_snapshot(spark: SparkSession, path: str, scan_id: str) -> DataFrame:
    """One scan's rows; other scans are not read."""
    return spark.read.parquet(f"{path}/scan_id={scan_id}")


def scan_to_json(rows: DataFrame, group: str = "project") -> DataFrame:
    """Each project's rows as one JSON document, in order of their columns."""
    rest = [c for c in rows.columns if c != group]
    listed = F.array_sort(F.collect_list(F.struct(*rest)))
    return rows.groupBy(group).agg(F.to_json(F.struct(F.first(group).alias(group), listed.alias("prompts"))).alias("document"))


class Tables:
    """The stored tables below one folder; a table that was never written is empty."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def read(self, name: str) -> DataFrame:
        schema = SCHEMAS[name]
        if not exists(self.spark, f"{self.base}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")

    def append(self, name: str, df: DataFrame) -> None:
        columns = [f.name for f in self.spark.createDataFrame([], SCHEMAS[name]).schema]
        df.select(*columns).write.mode("append").parquet(f"{self.base}/{name}")

    def register_views(self) -> None:
        for name in SCHEMAS:
            self.read(name).createOrReplaceTempView(name)
