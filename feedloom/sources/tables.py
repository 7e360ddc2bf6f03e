"""Stored tables and the ingest manifest that tells which files are new."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files beyond this many bytes are hashed in chunks of the other size.
WHOLE_UP_TO, CHUNK = 64 << 20, 4 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored data set by path; the format follows the file name and defaults to Parquet."""
    lowered = path.lower().rstrip("/")
    if lowered.endswith(".csv"):
        from feedloom.sources.csv import read_feedback_csv

        return read_feedback_csv(spark, path)
    if lowered.endswith(".json"):
        return spark.read.json(path)
    return spark.read.parquet(path)


def _hash_in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, fingerprint for batches of paths; a file is read a chunk at a time into a running digest."""
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            # Spark writes local paths as file:/a/b, the other schemes as URIs with their characters as they are.
            local = path.removeprefix("file:")
            system, place = fs.FileSystem.from_uri(local if local.startswith("/") else quote(path, safe=":/@"))
            digest = sha256(path.rsplit("/", 1)[-1].encode() + b"\0")
            with system.open_input_stream(place, buffer_size=0) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["path", "fingerprint"])


def file_fingerprints(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None, *, whole_up_to: int = WHOLE_UP_TO) -> DataFrame:
    """SHA-256 over name, a zero byte and content of every file: path, fingerprint. Files are hashed in parallel.

    Files of up to ``whole_up_to`` bytes are read whole, from any file system Spark knows. Larger ones have a task each
    that reads them in chunks through Arrow's file systems (local, HDFS, S3, GCS, ABFS), so memory does not follow the
    size of a file. Equal files have equal fingerprints either way. Empty files give no row: Spark's scan leaves them out.
    """
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load([paths] if isinstance(paths, str) else list(paths))
    name = F.element_at(F.split("path", "/"), -1)
    signature = F.sha2(F.concat(F.encode(name, "utf-8"), F.unhex(F.lit("00")), F.col("content")), 256)
    # The scan skips the content of files that the filter on length rules out.
    whole = files.filter(F.col("length") <= whole_up_to).select("path", signature.alias("fingerprint"))
    large = files.filter(F.col("length") > whole_up_to).select("path")
    return whole.unionByName(large.mapInArrow(_hash_in_chunks, "path string, fingerprint string"))


def new_files(fingerprints: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content the manifest has not seen under that name."""
    return fingerprints.join(manifest.select("fingerprint"), "fingerprint", "left_anti")
