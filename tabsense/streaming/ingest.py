"""Folder ingest (S7, S9): files arriving in a landing folder become dataset
catalog rows.

``readStream.format('binaryFile')`` lists new files (only path, length and
modification time are selected, so file contents are never read by the stream),
``trigger(availableNow=True)`` processes what is there and stops, and
``foreachBatch`` checks the files (extension, size cap, readable, at least one row
and one column), drops repeats of the same (session, name, length), within the batch
and against the written catalog, and appends one catalog row per file with its status
and reason.  All files of a type are read together, grouped by file.  The stream's checkpoint
lives in the shared checkpoint folder, so a restarted ingest neither skips nor
repeats files.
"""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.sources import readers as S
from tabsense.session import cut_lineage, ensure_checkpoint_dir

INGEST_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("session_id", T.StringType()),
    T.StructField("filename", T.StringType()), T.StructField("filepath", T.StringType()),
    T.StructField("file_type", T.StringType()), T.StructField("length", T.LongType()),
    T.StructField("row_count", T.LongType()), T.StructField("column_count", T.LongType()),
    T.StructField("schema_json", T.MapType(T.StringType(), T.StringType())),
    T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()),
    T.StructField("uploaded_at", T.TimestampType())])


BINARY_FILE = T.StructType([T.StructField("path", T.StringType()),
                            T.StructField("modificationTime", T.TimestampType()),
                            T.StructField("length", T.LongType()),
                            T.StructField("content", T.BinaryType())])


def screen(files: DataFrame, session_id: str, max_mb: float | None = None) -> DataFrame:
    """Extension and size checks as column expressions; ``uri`` is the encoded file path."""
    name = S.safe_name(F.col("path"))
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    ok_ext = ext.isin(sorted(S.SUPPORTED_EXTENSIONS))
    too_big = F.lit(False) if not max_mb else F.col("length") > F.lit(int(max_mb * 1024 * 1024))
    reason = (F.when(~ok_ext, F.concat(F.lit("unsupported file type "), F.coalesce(ext, F.lit(""))))
              .when(F.col("length") == 0, F.lit("empty file"))
              .when(too_big, F.lit(f"file larger than {max_mb} MB"))
              .when(ext == ".xls", F.lit("unreadable: legacy .xls workbooks are not supported")))
    return files.select(F.lit(session_id).alias("session_id"), name.alias("filename"),
                        F.col("path").alias("filepath"), F.regexp_replace(ext, r"^\.", "").alias("file_type"),
                        F.col("length"), reason.alias("reason"), F.col("modificationTime").alias("mtime"), "uri")


def _new_files(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """One file of every (session, name, length), the one with the least path, and none
    that the catalog already holds."""
    key = ["session_id", "filename", "length"]
    rest = [c for c in batch.columns if c not in key]
    one = batch.groupBy(*key).agg(F.min(F.struct("filepath", *[c for c in rest if c != "filepath"])).alias("f"))
    one = one.select(*key, "f.*")
    return one if known is None else one.join(known.select(*key), key, "left_anti")


def _facts(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(uri, row_count, column_count, schema_json, error) of the accepted files: one set of
    jobs a file type, whatever the number of files."""
    names: dict[str, list] = {}
    for r in files.where("reason IS NULL").select("file_type", "filepath", "uri").collect():    # one row a file of the batch
        names.setdefault(r.file_type, []).append(r)
    out = spark.createDataFrame([], "uri string, row_count long, column_count long, schema_json map<string,string>, error string")
    for kind, rs in sorted(names.items()):
        paths = sorted(r.filepath for r in rs)
        if kind == "xlsx":
            got = S.excel_facts(spark, paths).join(files.select("uri", F.col("filepath").alias("path")), "path")
        else:
            got = S.json_facts(spark, paths) if kind == "json" else S.csv_facts(spark, paths, "\t" if kind == "tsv" else ",")
            got = got.select(F.col("file").alias("uri"), "row_count", "column_count", "schema_json",
                             F.lit(None).cast("string").alias("error"))
        out = out.unionByName(got.select(out.columns))
    return out


def _register(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Catalog rows of the batch's new files."""
    known = files.join(_facts(spark, files), "uri", "left")
    no_data = (F.coalesce("row_count", F.lit(0)) == 0) | (F.coalesce("column_count", F.lit(0)) == 0)
    reason = (F.when(F.col("reason").isNotNull(), F.col("reason"))
              .when(F.col("error").isNotNull(), F.concat(F.lit("unreadable: "), "error"))
              .when(no_data, F.lit("no data in file")))
    # a replayed micro-batch must produce the same ids (see the idempotent write below)
    digest = F.md5(F.concat_ws("|", "session_id", "filepath", F.col("length").cast("string"), F.unix_micros("mtime").cast("string")))
    return known.select(
        F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5").alias("id"),
        "session_id", "filename", "filepath", "file_type", "length", "row_count", "column_count", "schema_json",
        F.when(reason.isNull(), "registered").otherwise("rejected").alias("status"), reason.alias("reason"),
        F.col("mtime").alias("uploaded_at"))


def _written(spark: SparkSession, catalog_path: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(catalog_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(T.StructType([*INGEST_SCHEMA.fields, T.StructField("batch_id", T.StringType())])).parquet(catalog_path)


def ingest_folder(spark: SparkSession, landing: str, catalog_path: str, session_id: str = "default",
                  max_mb: float | None = None, checkpoint: str | None = None,
                  max_files_per_batch: int = 1000) -> DataFrame:
    """Process every file now in ``landing`` (availableNow) and return the
    catalog rows written by this run and earlier ones.  A micro-batch holds at
    most ``max_files_per_batch`` files, which bounds the path list the driver
    hands to the readers."""
    base = ensure_checkpoint_dir(spark)
    folder = uuid.uuid5(uuid.NAMESPACE_URL, landing).hex
    ck = checkpoint or os.path.join(base, f"ingest-{folder}")
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", str(max_files_per_batch))
             .load(landing).select("path", "length", "modificationTime", F.col("_metadata.file_path").alias("uri")))
    screened = screen(files, session_id, max_mb)

    def write(batch: DataFrame, epoch: int) -> None:
        # Idempotent sink: each micro-batch of a folder owns one batch_id partition and
        # replaces it, so a batch replayed after a failure leaves no duplicates; the
        # guard against repeats asks the other partitions, so the stream keeps no state.
        spark, own = batch.sparkSession, f"{folder[:12]}-{int(epoch)}"
        known = _written(spark, catalog_path)
        if known is not None:
            known = known.where((F.col("session_id") == session_id) & (F.col("batch_id") != own))
        # cut: the batch is written over a partition of the table it has read
        out = cut_lineage(_register(spark, _new_files(batch, known))).withColumn("batch_id", F.lit(own))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("session_id", "batch_id").parquet(catalog_path))

    q = (screened.writeStream.foreachBatch(write).option("checkpointLocation", ck)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(catalog_path).select(*[F.col(f.name).cast(f.dataType)
                                                     for f in INGEST_SCHEMA.fields])
