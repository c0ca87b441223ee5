"""Word-processing packages (zip archives of XML parts) as rows, and rows as packages."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = "doc string, part string, ord int, blob binary, error string"
#: Parts that the word processor writes for itself: their absence says nothing.
REGENERATED = r"^(docProps/|customXml/|word/(fontTable|webSettings|settings|theme/)|_rels/|word/_rels/|\[Content_Types\])"


def _unzip(wanted: list[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for i, info in enumerate(z.infolist()):
                            if not info.is_dir() and (wanted is None or info.filename in wanted):
                                rows.append((path, info.filename, i, z.read(info), None))
                except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError) as e:
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    types = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc", "part", "ord", "blob", "error"])

    return run


def read_parts(spark: SparkSession, path: str, wanted: list[str] | None = None, pattern: str = "*.docx") -> DataFrame:
    """``(doc, part, ord, blob, error)`` of all packages under a path; only ``wanted`` parts are inflated.

    A file that is no archive gives one row with its error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_unzip(wanted), PARTS)


def package_bytes(parts: list[tuple[str, bytes]]) -> bytes:
    """A package with these parts in this order; the same parts give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, blob in parts:
            z.writestr(zipfile.ZipInfo(name, date_time=(1980, 1, 1, 0, 0, 0)), blob, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def to_packages(parts: DataFrame) -> DataFrame:
    """``(doc, content)``: each document's parts, in their order, as one package."""

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["ord"])
        return pa.table({"doc": pa.array([rows[0]["doc"]], pa.string()), "content": pa.array([package_bytes([(r["part"], r["blob"]) for r in rows])], pa.binary())})

    return parts.select("doc", "part", "ord", "blob").where("part IS NOT NULL").groupBy("doc").applyInArrow(build, "doc string, content binary")


def write_packages(parts: DataFrame, folder: str) -> None:
    """A file per document, written by the tasks; a file is moved into place when it is whole.

    Documents keep their folders below the longest that all of them share, so that files of one name
    don't meet; two documents that would be one file are refused before anything is written.
    """
    from vellum.operators.documents import held

    made = held(to_packages(parts).select("*", F.regexp_replace(F.regexp_replace("doc", r"/+$", ""), r"^[a-zA-Z][\w+.-]*:/+", "/").alias("place")))
    ends = made.agg(F.min("place").alias("lo"), F.max("place").alias("hi")).first()
    shared = os.path.commonprefix([ends["lo"] or "", ends["hi"] or ""]).rpartition("/")[0]
    file = F.regexp_replace(F.ltrim(F.substring("place", len(shared) + 1, 1 << 30)), r"^/+", "")
    made = made.withColumn("file", F.when(file.endswith(".docx"), file).otherwise(F.concat(file, F.lit(".docx")))).select("file", "content")
    twice = made.groupBy("file").count().where("count > 1").select("file").limit(3).collect()
    if twice:
        raise ValueError(f"several documents would be one file: {', '.join(r['file'] for r in twice)}")

    def write(rows: Iterator) -> None:
        import uuid

        from pyarrow import fs

        for row in rows:
            system, root = fs.FileSystem.from_uri(folder)
            name = row["file"]
            system.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
            passing = f"{root}/{name}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(passing, compression=None) as f:
                f.write(row["content"])
            system.move(passing, f"{root}/{name}")

    made.foreachPartition(write)


def is_regenerated(part):
    """Whether a part is one that the word processor rewrites for itself."""
    return part.rlike(REGENERATED)


def missing_parts(parts: DataFrame, baseline: DataFrame) -> DataFrame:
    """Parts that the baseline has and the package lacks, regenerated ones aside."""
    return baseline.select("doc", "part").where(~is_regenerated(F.col("part"))).join(parts.select("doc", "part"), ["doc", "part"], "left_anti")


def rels_name(part):
    """The part that holds another part's relationships."""
    return F.regexp_replace(part, r"^(.*/)?([^/]+)$", "$1_rels/$2.rels")
