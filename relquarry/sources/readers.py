"""Readers: JSON, CSV and its variants, PDF, vector files, stored documents."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import Schema
from ..storage import prepare

DELIMITERS = {".csv": ",", ".ssv": ";", ".tsv": "\t", ".psv": "|"}


def read_json(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """JSON arrays of documents, documents one per line, or either one after the other over lines; a file may hold several arrays."""
    fields = schema.struct()
    # a line goes by itself if it parses as an object or an array
    text = spark.read.text(path).where(F.trim("value") != "")
    if text.where(F.try_parse_json("value").isNull() | ~F.substring(F.trim("value"), 1, 1).isin("{", "[")).isEmpty():
        return spark.read.schema(fields).json(path)
    whole = spark.read.text(path, wholetext=True)

    @F.pandas_udf("array<string>")
    def documents(s: pd.Series) -> pd.Series:
        import json

        def cut(t: str) -> list[str]:
            out, at, decoder = [], 0, json.JSONDecoder()
            while at < len(t):
                m = re.compile(r"[\s,]*").match(t, at)
                at = m.end()
                if at >= len(t):
                    break
                try:
                    _, end = decoder.raw_decode(t, at)
                except json.JSONDecodeError:
                    end = len(t)
                out.append(t[at:end])
                at = end
            return out

        return s.map(cut)

    values = whole.select(F.explode(documents("value")).alias("v"))
    # an object counts as an array of one; what can't be parsed is a row of nulls
    docs = F.coalesce(F.from_json("v", T.ArrayType(fields)), F.array(F.lit(None).cast(fields)))
    return values.select(F.explode(docs).alias("d")).select("d.*")


def read_csv(spark: SparkSession, path: str, schema: Schema, has_header: bool = False, quoting: bool = True, flexible: bool = True, delimiter: str | None = None, skip_docs: int = 0, num_docs: int | None = None) -> DataFrame:
    """Columns by position; further columns are dropped, missing ones are null. The delimiter follows the file's ending unless given."""
    end = re.search(r"\.[a-z]sv$", path)
    delimiter = delimiter or DELIMITERS.get(end[0] if end else ".csv", ",")
    r = spark.read.option("sep", delimiter).option("header", False).option("mode", "PERMISSIVE" if flexible else "FAILFAST").option("multiLine", quoting)
    r = r.option("quote", '"' if quoting else "\0").option("escape", '"' if quoting else "\\")
    names = [f.field for f in schema.fields]
    df = r.option("enforceSchema", True).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    first = skip_docs + has_header
    if first or num_docs is not None:
        df = df.withColumn("__i", F.monotonically_increasing_id()).orderBy("__i")
        df = df.offset(first) if first else df
        df = df.limit(num_docs) if num_docs is not None else df
        df = df.drop("__i")
    return df.select(*[F.split(F.col(f"`{f.field}`"), "_").alias(f.field) if f.field_type.startswith("StringSet") else F.expr(f"try_cast(`{f.field}` as {f.spark_type.simpleString()})").alias(f.field) if f.field_type != "Point" else F.from_json(F.col(f"`{f.field}`"), f.spark_type).alias(f.field) for f in schema.fields])


def pdf_title(first_lines: str, meta_title: str | None, path: str) -> str:
    """From the metadata, else the first line of over one character among the first ten, else the file's name."""
    if meta_title and meta_title.strip():
        return meta_title.strip()
    for line in first_lines.split("\n")[:10]:
        if len(line.strip()) > 1:
            return line.strip()[:160]
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])


def pdf_date(text: str | None, modified: datetime) -> int:
    """Unix seconds of a PDF date such as D:20240131120000+01'00', else of the file; dates in the future or before 1970 are refused."""
    m = re.match(r"D?:?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:([+-])(\d\d)'?(\d\d)?)?", text or "")
    now = datetime.now(timezone.utc).timestamp()
    if m:
        y, mo, d, h, mi, s = (int(x or z) for x, z in zip(m.groups()[:6], (0, 1, 1, 0, 0, 0)))
        try:
            t = datetime(y, mo, d, h, mi, s, tzinfo=timezone.utc).timestamp()
            if m[7]:
                t -= (1 if m[7] == "+" else -1) * (int(m[8]) * 3600 + int(m[9] or 0) * 60)
            if 0 <= t <= now:
                return int(t)
        except ValueError:
            pass
    return int(modified.timestamp())


def plain_pdf(data: bytes) -> tuple[str, str | None, str | None]:
    """Text, title and date of a PDF: literal strings shown in uncompressed or Flate streams. A fuller extractor may be given instead."""
    import zlib

    out = []
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[2]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        for block in re.findall(rb"BT(.*?)ET", body, re.S):
            line = [s.replace(rb"\(", b"(").replace(rb"\)", b")") for s in re.findall(rb"\(((?:\\.|[^\\()])*)\)", block)]
            out.append(b"".join(line).decode("latin-1"))
    find = lambda k: (x := re.search(rb"/" + k + rb"\s*\(((?:\\.|[^\\()])*)\)", data)) and x[1].decode("latin-1")
    return "\n".join(out), find(b"Title"), find(b"CreationDate")


def read_pdf(spark: SparkSession, path: str, extract: Callable[[bytes], tuple[str, str | None, str | None]] = plain_pdf) -> DataFrame:
    """title, body, url, date of PDF files, also in subfolders; extract: bytes to (text, title, date)."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)

    def texts(batches: Iterator[pd.DataFrame]):
        for b in batches:
            rows = []
            for p, m, c in zip(b["path"], b["modificationTime"], b["content"]):
                text, title, date = extract(bytes(c))
                rows.append((pdf_title(text, title, p), text, p, pdf_date(date, m.to_pydatetime().replace(tzinfo=timezone.utc))))
            yield pd.DataFrame(rows, columns=["title", "body", "url", "date"])

    return files.select("path", "modificationTime", "content").mapInPandas(texts, "title string, body string, url string, date bigint")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Original files: path, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


class _Part(InputPartition):
    def __init__(self, file: str, start: int, count: int, base: int):
        self.file, self.start, self.count, self.base = file, start, count, base


def _files(path: str):
    """File system and files of a URI or path, which may name a folder; in the order of their names."""
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    info = where.get_file_info(at)
    if info.type == fs.FileType.File:
        return where, [info]
    found = where.get_file_info(fs.FileSelector(at, recursive=True))
    return where, sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


class _VecsReader(DataSourceReader):
    """Ranges of records of each file; ids count through all files."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.kind = options.get("kind", "f")
        self.rows = int(options.get("rowsperpartition", 100_000))

    @staticmethod
    def _dim(where, file: str) -> int:
        with where.open_input_file(file) as f:
            return struct.unpack("<i", f.read(4))[0]

    def partitions(self):
        where, files = _files(self.path)
        out, base = [], 0
        for f in files:
            n = f.size // (4 + 4 * self._dim(where, f.path)) if f.size else 0
            out += [_Part(f.path, i, min(self.rows, n - i), base + i) for i in range(0, n, self.rows)]
            base += n
        return out or [_Part("", 0, 0, 0)]

    def read(self, part: _Part):
        import numpy as np
        import pyarrow as pa

        if not part.count:
            return
        from pyarrow import fs

        where, _ = fs.FileSystem.from_uri(self.path if ":/" in self.path else f"file://{self.path}")
        dim = self._dim(where, part.file)
        with where.open_input_file(part.file) as f:
            f.seek(part.start * 4 * (dim + 1))
            a = np.frombuffer(f.read(part.count * 4 * (dim + 1)), "<i4").reshape(-1, dim + 1)
        if (a[:, 0] != dim).any():
            raise ValueError("vectors of several lengths in one file")
        flat = np.ascontiguousarray(a[:, 1:]).ravel()
        values = pa.array(flat.view("<f4") if self.kind == "f" else flat)
        offsets = pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.base, part.base + part.count)), pa.ListArray.from_arrays(offsets, values)], names=["id", "vector"])


def write_fvecs(vectors: DataFrame, path: str) -> None:
    """Files of float vectors in a folder, ranges of the first column in its order; a row of null or without components is refused."""
    import uuid

    from pyarrow import fs

    prepare(vectors.sparkSession)
    key, value = vectors.columns
    where, at = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    if where.get_file_info(at).type != fs.FileType.NotFound:
        where.delete_dir(at)
    where.create_dir(at, recursive=True)

    def write(batches: Iterator[pd.DataFrame]):
        import numpy as np
        from pyspark import TaskContext

        target, folder = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        name, n = f"part-{TaskContext.get().partitionId():06d}.fvecs", 0
        fresh = f"{folder}/.{name}.{uuid.uuid4().hex}"  # a task that runs twice leaves one whole file
        with target.open_output_stream(fresh) as f:
            for b in batches:
                for v in b[value]:
                    f.write(struct.pack("<i", len(v)) + np.asarray(v, "<f4").tobytes())
                    n += 1
        target.move(fresh, f"{folder}/{name}")
        yield pd.DataFrame({"n": [n]})

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors.repartitionByRange(parts, key).sortWithinPartitions(key).mapInPandas(write, "n bigint").write.format("noop").mode("overwrite").save()


class VecsSource(DataSource):
    """Files of records (int32 length, then so many 32-bit floats or integers), little-endian, a file or a folder of them; option kind: f or i. Split into ranges of records."""

    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        return "id bigint, vector array<float>" if self.options.get("kind", "f") == "f" else "id bigint, vector array<int>"

    def reader(self, schema):
        return _VecsReader(dict(self.options))


def read_vecs(spark: SparkSession, path: str, kind: str = "f") -> DataFrame:
    prepare(spark)
    spark.dataSource.register(VecsSource)
    return spark.read.format("vecs").option("kind", kind).load(path)


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    return read_vecs(spark, path, "f")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    return read_vecs(spark, path, "i")
