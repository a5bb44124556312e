"""Files as DataFrames: the binary source, extraction and rows of the raw-file table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillmere.functions.text import extension, safe_name
from quillmere.schemas import EXTRACTED, struct
from quillmere.sources.formats import extract

#: Files that Python holds at once.
_SLICE = 32


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, size, modified, content) of all files under a folder, through Spark's own readers."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def extracted(files: DataFrame, name_col: str = "name", content_col: str = "content", strip_markup: bool = True, mode: str = "lenient", preferred: str | None = None) -> DataFrame:
    """``files`` without their bytes, with the columns of an extraction; a file that can't be read has an error.

    ``preferred`` is a charset that is tried before the others where bytes are not UTF-8.
    """
    kept = [f for f in files.schema.fields if f.name != content_col]
    schema = struct(", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), EXTRACTED]))
    out = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                names, contents = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (name_col, content_col))
                rows = [extract(n, c, preferred, strip_markup, mode) for n, c in zip(names, contents)]
                old = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                new = [pa.array(list(c), t.type) for c, t in zip(zip(*rows), list(out)[len(kept) :])] if rows else []
                if rows:
                    yield pa.RecordBatch.from_arrays([*old, *new], schema=out)

    return files.mapInArrow(run, schema)


def raw_rows(files: DataFrame, kb_id: str) -> DataFrame:
    """Rows of the raw-file table: base, file id, safe name, relative path, bytes."""
    file_id = F.sha2(F.concat_ws("|", F.lit(kb_id), F.col("path")), 256)
    return files.select(
        F.lit(kb_id).alias("kb_id"),
        file_id.alias("file_id"),
        "name",
        extension(F.col("name")).alias("ext"),
        F.concat_ws("/", F.lit(kb_id), file_id, safe_name(F.col("name"))).alias("rel_path"),
        "size",
        "content",
    )

