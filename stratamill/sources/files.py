"""Files as tables: well logs, knowledge-base files and evidence planes; writers that refuse to overwrite."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Callable, Iterable, Sequence
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parts of a dump's file name and the plane each stands for; the first that occurs counts.
DUMPS = {
    "_PULSE_": "tool_pulse",
    "_SURVEY_": "tool_survey",
    "_GAMMA_": "tool_gamma",
    "_SHOCK": "tool_shock",
    "_SYSTEM_": "tool_magpi",
    "_CONTINUOUS": "tool_continuous",
    "_TELEM_": "tool_telem",
    "_VOLTAGE": "tool_voltages",
    "_CONFIG_": "tool_config",
    "_ENVIRONMENT": "tool_environment",
}
#: Columns of a well's log and of its reference log.
LOG = ("MD", "X", "Y", "Z", "GR", "TVT_input")
REFERENCE = ("TVT", "GR")
#: Least rows of a reference log, of the known prefix, and of the tail.
LEAST_REFERENCE, LEAST_KNOWN, LEAST_TAIL = 50, 50, 5
#: References of an archive that are listed.
LISTED = 5


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, name and length of the files; what is in them isn't read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def by_well(files: DataFrame) -> DataFrame:
    """well, path: the id is the name up to the first double underscore."""
    return files.select(F.split("name", "__")[0].alias("well"), "path")


def wells(spark: SparkSession, folder: str) -> DataFrame:
    """well, path of each horizontal log, and reference, the path of its reference log (null if it has none, the first of several)."""
    logs = by_well(listing(spark, folder, "*horizontal_well*.csv"))
    other = by_well(listing(spark, folder, "*typewel*.csv")).groupBy("well").agg(F.min("path").alias("reference"), F.count("*").alias("n_references"))
    return logs.join(other, "well", "left").withColumn("n_references", F.coalesce("n_references", F.lit(0)))


def logs(spark: SparkSession, folder: str, pattern: str, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """well and the columns as doubles, from CSV files whose headers may differ in order and in other columns.

    Files without a required column are left out; text that is no number, and NaN, are null. Only the columns asked
    for are parsed, so labels that aren't asked for are never seen.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(folder).select(F.col("_metadata.file_path").alias("path"), F.split("value", ",").alias("cells"))
    head = lines.filter(F.forall(F.array(*map(F.lit, required)), lambda c: F.array_contains("cells", c)))
    head = head.select("path", F.col("cells").alias("head"))
    rows = lines.join(head, "path").filter(F.col("cells") != F.col("head"))

    def cell(c: str):
        at = F.nullif(F.array_position("head", c).cast("int"), F.lit(0))
        value = F.trim(F.element_at("cells", at)).try_cast("double")
        return F.when(~F.isnan(value), value).alias(c)

    well = F.split(F.element_at(F.split("path", "/"), -1), "__")[0].alias("well")
    return rows.select(well, *map(cell, [*required, *optional]))


def usable_wells(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows of the wells that can be used, with known, tail and TVT (null where a file has no truth).

    A well needs a reference log of LEAST_REFERENCE rows, known values that are one prefix by depth, and enough rows
    with all coordinates on both sides of its end. Rows without a depth belong to neither side.
    """
    rows = logs(spark, folder, "*horizontal_well*.csv", LOG, ("TVT",))
    whole = F.col("MD").isNotNull() & F.col("X").isNotNull() & F.col("Y").isNotNull() & F.col("Z").isNotNull()
    given = F.col("TVT_input").isNotNull()
    rows = rows.withColumns({"known": given & whole, "tail": ~given & whole})
    counts = rows.groupBy("well").agg(
        F.coalesce(F.max(F.when(given, F.col("MD"))) < F.min(F.when(~given, F.col("MD"))), F.lit(True)).alias("_prefix"),
        F.count_if("known").alias("_known"),
        F.count_if("tail").alias("_tail"),
    )
    reference = logs(spark, folder, "*typewel*.csv", REFERENCE).dropna().groupBy("well").count().filter(F.col("count") >= LEAST_REFERENCE)
    good = counts.filter(F.col("_prefix") & (F.col("_known") >= LEAST_KNOWN) & (F.col("_tail") >= LEAST_TAIL)).select("well")
    return rows.join(good.join(reference.select("well"), "well", "left_semi"), "well", "left_semi")


def knowledge_files(spark: SparkSession, folder: str, extensions: Iterable[str], skip_folders: Iterable[str] = (), skip_names: Iterable[str] = (), most_bytes: int = 2_000_000, most_files: int | None = None) -> DataFrame:
    """path, name, length of files with one of the extensions, below folder; the first most_files by path, if that is given."""
    found = listing(spark, folder, recursive=True).filter(F.col("length") <= most_bytes)
    found = found.filter(F.lower(F.regexp_extract("name", r"\.[^.]*$", 0)).isin(*extensions))
    if skip_names := list(skip_names):
        found = found.filter(~F.col("name").isin(skip_names))
    if skip_folders := list(skip_folders):
        found = found.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip_folders))))
    return found if most_files is None else found.orderBy("path").limit(most_files)


def texts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path and whole text of files."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def dump_planes(spark: SparkSession, folder: str) -> DataFrame:
    """id, modality, state, evidence of the planes that CSV dumps stand for, by file name."""
    upper = F.upper("name")
    plane = F.coalesce(*(F.when(F.contains(upper, F.lit(part)), F.lit(plane)) for part, plane in DUMPS.items()), F.concat(F.lit("tool_csv_"), F.substring(F.regexp_replace("name", r"\.[^.]*$", ""), 1, 40)))
    return listing(spark, folder, "*.csv").select(plane.alias("id"), F.lit("tool_dump").alias("modality"), F.lit("LIVE").alias("state"), F.col("path").alias("evidence"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def entries(content: pd.Series) -> pd.Series:
    """Names in a zip archive; null if it is none."""

    def names(data):
        try:
            return zipfile.ZipFile(io.BytesIO(data)).namelist()
        except zipfile.BadZipFile:
            return None

    return content.map(names)


def archive_planes(spark: SparkSession, path: str) -> DataFrame:
    """id, modality, state, n, evidence of the planes in acquisition archives, and an unknown plane for what is no archive.

    evidence has the first LISTED entries of a plane in the order of the archive.
    """
    found = spark.read.format("binaryFile").load(path).select("path", entries("content").alias("names"))
    entry = F.lower("entry")
    kinds = F.array_compact(
        F.array(
            F.when(F.contains(entry, F.lit("/wits")) | F.contains(entry, F.lit("wits logs")), F.struct(F.lit("wits_surface").alias("id"), F.lit("wits").alias("modality"))),
            F.when(F.contains(entry, F.lit("decoder")), F.struct(F.lit("decoder_rt").alias("id"), F.lit("decoder").alias("modality"))),
            F.when(F.endswith(entry, F.lit(".db")), F.struct(F.lit("acq_db").alias("id"), F.lit("acq_db").alias("modality"))),
        )
    )
    rows = found.select("path", F.posexplode("names").alias("at", "entry")).withColumn("kind", F.explode(kinds)).select("path", "at", "entry", "kind.*")
    planes = rows.groupBy("path", "id", "modality").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "entry"))), lambda e: e["entry"]).alias("evidence"))
    planes = planes.select("path", "id", "modality", F.lit("LIVE").alias("state"), "n", F.slice("evidence", 1, LISTED).alias("evidence"))
    broken = found.filter("names IS NULL").select("path", F.lit("acq_emz").alias("id"), F.lit("acq_db").alias("modality"), F.lit("UNKNOWN").alias("state"), F.lit(0).cast("long").alias("n"), F.array("path").alias("evidence"))
    return planes.unionByName(broken)


def submission(sample: DataFrame, predictions: DataFrame) -> DataFrame:
    """sample's ids (well and row, joined by the last underscore) with tvt from predictions (well, row, tvt).

    Raises ValueError if an id has no prediction: a row that is filled in would look like a result.
    """
    keys = sample.select("id", F.regexp_extract("id", "^(.*)_[^_]*$", 1).alias("well"), F.regexp_extract("id", "([^_]*)$", 1).try_cast("long").alias("row"))
    out = keys.join(predictions.select("well", "row", "tvt"), ["well", "row"], "left").select("id", "tvt")
    missing = out.filter("tvt IS NULL")
    if first := [r["id"] for r in missing.limit(5).collect()]:
        raise ValueError(f"{missing.count()} rows have no prediction, such as {', '.join(first)}")
    return out


def write_once(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes df; raises if path is there already. The committer makes all files appear at once."""
    df.write.mode("errorifexists").format(kind).save(path)


def save_index(chunks: DataFrame, path: str, vector: str = "embedding") -> None:
    """The whole index and a slim one without vectors."""
    write_once(chunks, f"{path}/full")
    write_once(chunks.drop(vector), f"{path}/slim")


def load_index(spark: SparkSession, path: str, vectors: bool = True) -> DataFrame:
    """The index that save_index() wrote, with vectors or without."""
    return spark.read.parquet(f"{path}/{'full' if vectors else 'slim'}")


def resume_shards(spark: SparkSession, path: str, folds: Iterable[int], compute: Callable[[int], DataFrame]) -> DataFrame:
    """The rows of all folds with their fold; those that an earlier run ended are read, the others computed and written.

    A fold has ended once its audit (rows and a checksum) is there; what a lost run left without one is written anew. A
    fold that no longer agrees with its audit raises ValueError. Folds are few and each is a Spark job of its own.
    """

    def audit(df: DataFrame) -> DataFrame:
        whole = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
        return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(whole), F.lit(0)).cast("string").alias("checksum"))

    out = None
    for fold in folds:
        shard, mark = f"{path}/fold-{fold}", f"{path}/audit-{fold}"
        try:
            known = spark.read.parquet(mark).first()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            compute(fold).write.mode("overwrite").parquet(shard)
            audit(spark.read.parquet(shard)).write.mode("overwrite").parquet(mark)
        else:
            if known != audit(spark.read.parquet(shard)).first():
                raise ValueError(f"fold {fold} in {path} doesn't agree with its audit")
        rows = spark.read.parquet(shard).withColumn("fold", F.lit(fold))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no folds")
    return out


def digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and sha256 of the bytes of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def sealed(values: dict[str, Any]) -> dict[str, Any]:
    """values with the digest of their canonical JSON: sorted keys, no spaces, no NaN."""
    text = json.dumps(values, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return values | {"sha256": hashlib.sha256(text.encode()).hexdigest()}
