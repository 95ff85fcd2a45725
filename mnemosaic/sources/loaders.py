"""Documents of several formats as tables (path, text)."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError


def _reindented(raw: bytes) -> str:
    return json.dumps(json.loads(raw.decode()), indent=2, ensure_ascii=False)


def _docx_paragraphs(raw: bytes) -> list[str]:
    try:
        import docx
    except ImportError as e:
        raise ConfigError("reading .docx needs the package python-docx") from e
    return [t for p in docx.Document(io.BytesIO(raw)).paragraphs if (t := p.text.strip())]


def _pdf_pages(raw: bytes) -> list[str]:
    try:
        import pypdf
    except ImportError as e:
        raise ConfigError("reading .pdf needs the package pypdf") from e
    return [t for p in pypdf.PdfReader(io.BytesIO(raw)).pages if (t := (p.extract_text() or "").strip())]


_TEXT_OF: dict[str, Callable[[bytes], str]] = {
    ".txt": bytes.decode,
    ".md": bytes.decode,
    ".json": _reindented,
    ".docx": lambda raw: "\n\n".join(_docx_paragraphs(raw)),
    ".pdf": lambda raw: "\n\n".join(_pdf_pages(raw)),
}


def _suffix(path: str) -> str:
    return os.path.splitext(path)[1].lower()


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of a file, or of all files that a glob names; all need one supported suffix."""
    suffix = _suffix(path)
    if suffix not in _TEXT_OF:
        raise ConfigError(f"unsupported file type {suffix!r}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        raise FileNotFoundError(path)
    if suffix in (".txt", ".md"):
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    convert = _TEXT_OF[suffix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([convert(x) for x in b.column(1).to_pylist()], pa.string())], names=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(filename, file_size, extension, paragraph_count, page_count); the counts of .docx and .pdf, else NULL."""
    suffix = _suffix(path)
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    base = [name.alias("filename"), F.col("length").alias("file_size"), F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("extension")]
    kinds = {".docx": _docx_paragraphs, ".pdf": _pdf_pages}
    if suffix not in kinds:
        return files.select(*base, F.lit(None).cast("int").alias("paragraph_count"), F.lit(None).cast("int").alias("page_count"))
    count = kinds[suffix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(count(x)) for x in b.column(3).to_pylist()], pa.int32())], names=["filename", "file_size", "extension", "n"])

    counted = files.select(*base, "content").mapInArrow(run, "filename string, file_size long, extension string, n int")
    n, none = F.col("n"), F.lit(None).cast("int")
    return counted.select("filename", "file_size", "extension", (n if suffix == ".docx" else none).alias("paragraph_count"), (n if suffix == ".pdf" else none).alias("page_count"))
