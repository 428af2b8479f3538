"""Sources S1-S18 and sinks K2-K10: text files, archives, JSON lines, day folders."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
from itertools import batched, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import one_line
from . import zips

# File extensions of prose.
EXTENSIONS = "md markdown mdown mdx html htm xhtml txt text rst".split()
KIND = {"html": "html", "htm": "html", "xhtml": "html", "txt": "txt", "text": "txt", "rst": "txt"}


def shared_folder(spark: SparkSession) -> str:
    """Our folder below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a folder of this machine serves a local session, as in tests; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="prosemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/prosemill"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the folder named in spark.checkpoint.dir and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """rows on at least as many partitions as there are cores, for work that costs far more than moving the text.

    A scan of one row group is one task. Scans with enough partitions, which is
    every large input, are left alone: no shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows._jdf.queryExecution().toRdd().getNumPartitions() >= cores else rows.repartition(cores)


def kind_of(rows: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("name", r"\.([^./]+)\z", 1))
    kinds = F.create_map(*(F.lit(x) for k, v in KIND.items() for x in (k, v)))
    return rows.withColumn("kind", F.coalesce(F.element_at(kinds, ext), F.lit("md")))


def read_folder(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """(name, src, kind) of prose files below path; no dot entries, node_modules or excluded substrings; BOM dropped."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("name"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("src"))
    files = files.where(~F.col("name").rlike(r"/\.[^/]|/node_modules/"))
    for x in exclude or []:
        files = files.where(~F.col("name").contains(x))
    return kind_of(files)


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, method, flags, crc, packed, size, header) of the prose entries of archives, from their directories alone.

    path may name several archives, as a glob does. Folders, dot files, what macOS adds and other kinds are left out.
    """
    fields = "name string, method int, flags int, crc long, packed long, size long, header long"
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}

    def listed(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, name = zips.filesystem(archive)
                with fs.open_input_file(name) as f:
                    for some in batched(zips.directory(f, f.size()), 10_000):
                        columns = zip(*some, strict=True)
                        yield pa.RecordBatch.from_pydict({"archive": pa.array([archive] * len(some))} | {t.split()[0]: pa.array(c, kinds[t.split()[1]]) for t, c in zip(fields.split(", "), columns, strict=True)})

    archives = spark.read.format("binaryFile").load(path).select("path")  # names alone: no archive is read here
    leaf = F.element_at(F.split("name", "/"), -1)
    prose = F.lower(leaf).rlike(r"\.(?:" + "|".join(EXTENSIONS) + r")\z") & ~leaf.startswith(".") & ~F.array_contains(F.split("name", "/"), "__MACOSX")
    return archives.mapInArrow(listed, f"archive string, {fields}").where(prose)


def read_zip(spark: SparkSession, path: str, least: int = 1 << 16, most: int = 1 << 25) -> DataFrame:
    """(name, src, kind) of the prose entries of zip archives, Zip64 included.

    Entries are dealt over the tasks by the byte range in which they lie, so one archive is read by all of them, each
    holding one entry at a time. Ranges have least to most bytes. Where only Spark's readers reach the archives, each
    is one task that streams its entries.
    """
    listed = spark.read.format("binaryFile").load(path)
    total, one = listed.agg(F.coalesce(F.sum("length"), F.lit(0)), F.min("path")).head()
    if one is None or zips.filesystem(one) is None:
        return kind_of(listed.select("path", "content").mapInPandas(_whole_archives, "name string, src string"))
    cores = spark.sparkContext.defaultParallelism
    n = max(cores, -(-total // most))
    span = min(most, max(least, total // (4 * n)))

    def read(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for archive, some in groupby(rows, key=lambda r: r["archive"]):
                fs, place = zips.filesystem(archive)
                with fs.open_input_file(place) as f:
                    for r in some:
                        text = zips.read_entry(f, zips.Entry(*(r[k] for k in zips.Entry._fields))).decode("utf-8", "replace").removeprefix("\ufeff")
                        yield pa.RecordBatch.from_pydict({"name": pa.array([f"{archive}!{r['name']}"]), "src": pa.array([text])})

    entries = zip_entries(spark, path).withColumn("range", F.floor(F.col("header") / span))
    dealt = entries.repartition(n, "archive", "range").sortWithinPartitions("archive", "header").drop("range")
    return kind_of(dealt.mapInArrow(read, "name string, src string"))


def _whole_archives(frames):
    for frame in frames:
        for name, content in zip(frame["path"], frame["content"], strict=True):
            f = io.BytesIO(content)
            for e in zips.directory(f, len(content)):
                parts = e.name.split("/")
                if "__MACOSX" not in parts and not parts[-1].startswith(".") and "." in parts[-1] and parts[-1].rpartition(".")[2].lower() in EXTENSIONS:
                    yield pd.DataFrame([(f"{name}!{e.name}", zips.read_entry(f, e).decode("utf-8", "replace").removeprefix("\ufeff"))], columns=["name", "src"])


def read_records(spark: SparkSession, path: str) -> DataFrame | None:
    """JSON lines with a fixed schema; truncated lines are dropped. None where the day is absent or has no record."""
    try:
        rows = spark.read.schema("ts string, repo string, author string, body string").option("mode", "DROPMALFORMED").json(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise
    return None if rows.isEmpty() else rows


def read_pairs(spark: SparkSession, path: str, least_words: int = 250) -> DataFrame:
    """(pair_id, register, side, text) of human/*.txt and ai/*.txt."""
    rows = read_folder(spark, path).withColumn("side", F.regexp_extract("name", r"/(human|ai)/[^/]+\.txt\z", 1)).where("side <> ''").withColumn("pair_id", F.regexp_extract("name", r"([^/]+)\.txt\z", 1))
    return rows.select("pair_id", F.split("pair_id", "-")[0].alias("register"), "side", F.col("src").alias("text")).where(F.regexp_count("text", F.lit(r"[A-Za-z0-9][A-Za-z0-9'’-]*")) >= least_words)


def day_windows(days: DataFrame, n: int = 10, minutes: int = 5) -> DataFrame:
    """N windows for each day: (day, window, start_second, seconds), one in each equal part of the day.

    The place in the part is drawn by the reference's generator, which multiplies in doubles, from a hash of the date.
    """
    part = 86_400 // n
    chars = F.split(F.date_format("day", "yyyy-MM-dd"), "")
    seed = F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % (1 << 32))
    step = lambda h: (h.cast("double") * 1103515245.0 + 12345.0) % 4294967296.0
    start = F.struct(seed.cast("double").alias("h"), F.expr("cast(array() as array<double>)").alias("all"))
    states = F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda a, _: F.struct(step(a["h"]).alias("h"), F.array_append(a["all"], step(a["h"])).alias("all")), lambda a: a["all"])
    rows = days.select("day", F.posexplode(states).alias("window", "h"))
    milliseconds = F.floor(F.col("h") / 4294967296.0 * ((part - minutes * 60) * 1000))
    return rows.select("day", "window", (F.col("window") * part + F.floor(milliseconds / 1000)).cast("long").alias("start_second"), F.lit(minutes * 60).cast("long").alias("seconds"))


def findings_tsv() -> Column:
    """K3: file, line, col, rule and match (200 characters at most), separated by tabs."""
    return F.concat_ws("\t", "file", F.col("line").cast("string"), F.col("col").cast("string"), "rule", one_line(F.col("match"), 200))


def findings_annotations() -> Column:
    """K4: CI annotation lines with the match and, where there is one, what to do."""
    text = F.regexp_replace(one_line(F.concat(F.col("match"), F.lit(" · "), F.coalesce("suggest", F.lit(""))), 200), r"[\r\n%]", " ")
    return F.concat(F.format_string("::warning file=%s,line=%d,col=%d,title=%s::", "file", "line", "col", "rule"), text)
