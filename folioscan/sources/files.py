"""Files as rows: scan, decode, parse, with an error column instead of a failure.

A document folder is listed by Spark's binaryFile source (regular files of the folder itself; names
that start with ``.`` or ``_`` are skipped). That source leaves out files of no bytes; they are
taken from the file system's listing. TXT is decoded by Spark; Word and PDF go through a
parser on Arrow batches. ``.docx`` needs the standard library only; PDF needs an optional package
and gives error rows without it, as a binary ``.doc`` does.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the Word format.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]+$", 0)


def extension(path: Column) -> Column:
    """The lower-cased suffix with its dot; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


SCANNED = "path string, modificationTime timestamp, length long, content binary"


def _loaded(spark: SparkSession, where: list[str], listed: list) -> DataFrame:
    """The files at ``where``; ``listed`` are their states, which tell the files of no bytes."""
    if not where:
        return spark.createDataFrame([], SCANNED)
    files = spark.read.format("binaryFile").load(where)
    empty = [(f.getPath().toString(), f.getModificationTime()) for f in listed if f.isFile() and f.getLen() == 0 and f.getPath().getName()[0] not in "._"]
    if empty:
        rows = spark.createDataFrame(empty, "path string, millis long")
        files = files.unionByName(rows.select("path", F.timestamp_millis("millis").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit("").cast("binary").alias("content")))
    return files


def _at(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def scan(spark: SparkSession, directory: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """path, modificationTime, length, content of a folder's files; all files when ``extensions`` is None.

    A folder that does not exist has no files.
    """
    folder, system = _at(spark, directory)
    if not system.exists(folder):
        return spark.createDataFrame([], SCANNED)
    files = _loaded(spark, [directory], system.listStatus(folder))
    return files if extensions is None else files.filter(extension(F.col("path")).isin(*extensions))


def scan_paths(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """The files of a list of paths, and the paths of the list that are no files."""
    there, states, gone = [], [], []
    for path in paths:
        where, system = _at(spark, path)
        if system.exists(where) and system.getFileStatus(where).isFile():
            there.append(path)
            states.append(system.getFileStatus(where))
        else:
            gone.append(path)
    return _loaded(spark, there, states), gone


def land(spark: SparkSession, directory: str, name: str, content: bytes) -> str:
    """Write an uploaded file into a folder; its path."""
    path = f"{directory.rstrip('/')}/{name.rsplit('/', 1)[-1]}"
    where, system = _at(spark, path)
    stream = system.create(where, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    return path


def listing(files: DataFrame) -> DataFrame:
    """name, size, mtime (epoch seconds) in order of name; contents are not read."""
    return files.select(basename(F.col("path")).alias("name"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime")).orderBy("name")


def read_docx(content: bytes) -> str:
    """Paragraph texts of the document body, joined by line feeds."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.findall(f"{_W}p"))


def read_pdf(content: bytes) -> str:
    """Page texts, each followed by a line feed."""
    try:
        from pypdf import PdfReader
    except ImportError:
        raise RuntimeError("PDF needs the package pypdf") from None
    return "".join((page.extract_text() or "") + "\n" for page in PdfReader(io.BytesIO(content)).pages)


PARSERS: dict[str, Callable[[bytes], str]] = {".docx": read_docx, ".doc": read_docx, ".pdf": read_pdf}


def _parsed(parsers: dict[str, Callable[[bytes], str]]):
    @F.pandas_udf("text string, error string")
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, extensions in batches:
            rows = []
            for content, ext in zip(contents, extensions, strict=True):
                if ext is None:
                    rows.append((None, None))
                    continue
                try:
                    rows.append((parsers[ext](bytes(content)), None))
                except Exception as e:  # a broken file is a row of its own, not the job's end
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["text", "error"])

    return parse


def parse(files: DataFrame, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """source, file_path, text, error of each file: strict UTF-8 for TXT, a parser for other known suffixes, an error otherwise."""
    parsers = PARSERS if parsers is None else parsers
    named = files.select(basename(F.col("path")).alias("source"), F.col("path").alias("file_path"), extension(F.col("path")).alias("ext"), "content")
    ext = F.col("ext")
    rich, plain = ext.isin(*parsers) & (ext != ".txt"), F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    got = named.withColumn("got", _parsed(parsers)(F.when(rich, F.col("content")), F.when(rich, ext)))  # other contents stay in the JVM
    got = got.withColumn("plain", F.when(ext == ".txt", plain))
    text = F.when(ext == ".txt", F.col("plain")).when(rich, F.col("got.text"))
    error = F.when((ext == ".txt") & F.col("plain").isNull(), F.lit("not valid UTF-8")).when(rich, F.col("got.error")).when(ext != ".txt", F.concat(F.lit("unsupported format: "), ext))
    return got.select("source", "file_path", text.alias("text"), error.alias("error"))


def missing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Error rows of paths that are no files."""
    asked = spark.createDataFrame([(p,) for p in paths], "file_path string")
    return asked.select(basename(F.col("file_path")).alias("source"), "file_path", F.lit(None).cast("string").alias("text"), F.lit("file not found").alias("error"))


def inline(spark: SparkSession, documents: dict[str, str]) -> DataFrame:
    """source, file_path, text, error of documents given in code."""
    rows = [(name, name, text, None) for name, text in documents.items()]
    return spark.createDataFrame(rows, "source string, file_path string, text string, error string")
