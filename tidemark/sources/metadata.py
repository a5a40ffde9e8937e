"""Readers for heterogeneous study metadata, all to explicit columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDECAR = ("subject string, cohort string, `group` string, channels array<string>, "
           "qc struct<duration_s double, n_channels_in int, sfreq_in double, unit_correction double>, "
           "match_offsets array<bigint>")
ANNOTATION = "data array<struct<serial string, age double, symptom array<string>>>"
SPLIT = ("train_split array<struct<serial string>>, validation_split array<struct<serial string>>, "
         "test_split array<struct<serial string>>")


def sidecars(spark: SparkSession, dirs: Sequence[str], payload: DataFrame) -> DataFrame:
    """Sidecars of several folders whose payload exists; ``payload`` lists the subjects with one."""
    js = spark.read.schema(SIDECAR).json(list(dirs))
    return js.join(payload.select("subject").distinct(), "subject", "left_semi")


def payload_listing(spark: SparkSession, dirs: Sequence[str], suffix: str = ".npy") -> DataFrame:
    """Payload files by stem, from file names alone (contents are not read)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(list(dirs))
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("subject"))


def annotations(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """serial -> (age, ';'-joined tags) from ``{"data": [...]}`` documents."""
    raw = spark.read.schema(ANNOTATION).option("multiLine", multiline).json(path)
    rec = raw.select(F.explode("data").alias("r")).select("r.*")
    return rec.select("serial", "age", F.concat_ws(";", "symptom").alias("subtype"))


def trimmed_header(df: DataFrame, lower: bool = False) -> DataFrame:
    return df.toDF(*[c.strip().lower() if lower else c.strip() for c in df.columns])


def age_norm(age: Column) -> Column:
    """clip((age − 40) / 50, 0, 1); an absent age stays absent."""
    return F.when(age.isNotNull(), F.least(F.greatest((age - 40) / 50, F.lit(0.0)), F.lit(1.0)))


def participants(spark: SparkSession, path: str) -> DataFrame:
    """Participants TSV: padded header, group codes, MMSE/30 (0.5 when the column is absent)."""
    df = trimmed_header(spark.read.csv(path, sep="\t", header=True))
    if "Group" not in df.columns:
        raise KeyError(f"column 'Group' not found in {df.columns}")
    mmse = (F.col("MMSE").cast("double") / 30) if "MMSE" in df.columns else F.lit(0.5)
    age = F.col("Age").cast("double")
    code = F.when(F.col("Group") == "A", 0).when(F.col("Group") == "F", 1).when(F.col("Group") == "C", 2)
    return df.select(F.trim("participant_id").alias("participant_id"), age.alias("age"),
                     F.col("Group").alias("group"), code.alias("code"), mmse.alias("mmse_norm"),
                     (F.col("Gender") == "M").cast("int").alias("sex_code"),
                     age_norm(age).alias("age_norm"))


def _named_values(spark: SparkSession, paths: Sequence[str], encoding: str) -> DataFrame:
    """``names`` (lower-cased header) and ``values`` of every line of CSV files, each by the header of its own file.

    A quoted field must not hold a line feed.
    """
    lines = (spark.read.option("encoding", encoding).schema("line string")
             .csv(list(paths), sep="\x01", quote="", mode="PERMISSIVE")
             .select("line", "_metadata.file_path", F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("at"))
             .where(F.trim(F.coalesce("line", F.lit(""))) != ""))
    # One row a file: its first line.
    heads = lines.groupBy(F.col("file_path").alias("file")).agg(F.min(F.struct("at", "line")).alias("first"))
    heads = heads.select("file", F.col("first.at").alias("head"), F.col("first.line").alias("header"))
    widest = heads.agg(F.max(F.size(F.split("header", ",")))).first()[0] or 1
    cells = ", ".join(f"c{i} string" for i in range(widest))

    def parsed(c: str) -> Column:
        row = F.from_csv(c, cells)
        return F.array(*[row[f"c{i}"] for i in range(widest)])

    names = F.transform(parsed("header"), lambda n: F.lower(F.trim(F.regexp_replace(n, "^\ufeff", ""))))
    rows = lines.join(heads, lines["file_path"] == heads["file"]).where(F.col("at") != F.col("head"))
    return rows.select(names.alias("names"), parsed("line").alias("values"))


def demographics(spark: SparkSession, globs: Sequence[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Demographics CSVs whose headers and column orders differ from file to file: either id spelling, blank ids dropped."""
    rows = _named_values(spark, globs, encoding)

    def cell(name: str) -> Column:
        return F.get("values", F.array_position("names", name).cast("int") - 1)

    sid = F.trim(F.coalesce(*[F.when(F.trim(cell(c)) != "", cell(c)) for c in ("id eeg", "id_eeg")], F.lit("")))
    return rows.select(sid.alias("id"), F.trim(cell("diagnosis")).alias("diagnosis"),
                       cell("age").try_cast("double").alias("age"), cell("sex").alias("sex")).filter(F.col("id") != "")


def workbook(spark: SparkSession, parts: Sequence[str]) -> DataFrame | None:
    """First part that carries the sheet (as CSV) wins; header, ids and dates stripped."""
    for path in parts:
        try:
            df = trimmed_header(spark.read.csv(path, header=True))
        except AnalysisException:
            continue
        if df.columns:
            return df.withColumns({"id": F.trim("id"), "Date": F.trim("Date")})
    return None


def split_partition(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """(serial, part): train, and held = validation and test together; serials padded to 5."""
    raw = spark.read.schema(SPLIT).option("multiLine", multiline).json(path)
    train = raw.select(F.explode("train_split.serial").alias("serial"), F.lit("train").alias("part"))
    held = raw.select(F.explode(F.concat(F.coalesce("validation_split.serial", F.array().cast("array<string>")),
                                         F.coalesce("test_split.serial", F.array().cast("array<string>"))))
                      .alias("serial"), F.lit("held").alias("part"))
    return train.unionByName(held).withColumn("serial", F.lpad("serial", 5, "0")).distinct()
