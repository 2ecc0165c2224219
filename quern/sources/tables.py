"""Relations in Parquet, and settings and markup bodies in files."""

from __future__ import annotations

import re
import tempfile
import uuid
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.paths import canonical
from quern.model import SCHEMAS, Facts


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # executors of local-cluster are processes of their own
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a URI, in the shared folder."""
    return f"{shared_folder(spark)}/quern/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, so a lost executor costs no recomputation."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_facts(spark: SparkSession, folder: str) -> Facts:
    """``folder/<relation>.parquet`` of each relation that is there; the schema is the engine's, columns are pruned by Spark."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    tables = {}
    for name, schema in SCHEMAS.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        if path.getFileSystem(conf).exists(path):
            tables[name] = spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
    return Facts(spark, tables)


def write_facts(facts: Facts, folder: str) -> None:
    for name, df in facts.tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


#: Element names of the settings file; its outermost element may have any name.
SETTINGS_LIST, SETTINGS_ITEM = "SkippedFolderSuffixes", "string"


def parse_settings(xml: str | None, solution_folder: str) -> tuple[str, ...]:
    """Keys of skipped folders; no file, no folders. XML comments do not count."""
    if not xml:
        return ()
    root = ElementTree.fromstring(xml.lstrip("﻿"))
    return tuple(dict.fromkeys(canonical(e.text.strip(), solution_folder) for e in root.iter(SETTINGS_ITEM) if e.text and e.text.strip()))


def render_settings(folders: list[str], root_name: str = "Settings") -> str:
    root = ElementTree.Element(root_name)
    items = ElementTree.SubElement(root, SETTINGS_LIST)
    for f in folders:
        ElementTree.SubElement(items, SETTINGS_ITEM).text = f
    return ElementTree.tostring(root, encoding="unicode", xml_declaration=True)


#: Byte order marks and the charset each stands for; the longer of two that begin alike is tested first.
MARKS = (("EFBBBF", "UTF-8"), ("FFFE0000", "UTF-32LE"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))


def decode_bodies(files: DataFrame) -> DataFrame:
    """(path, encoding, body) of binaryFile rows; without a mark a file is UTF-8. encoding is '<charset>' or '<charset>-BOM'."""
    head = F.hex(F.substring("content", 1, 4))
    encoding, body = F, F
    for mark, charset in MARKS:
        n = len(mark) // 2
        rest = F.expr(f"substring(content, {n + 1})")
        text = F.decode(rest, charset if charset != "UTF-32LE" else "UTF-32")
        if charset == "UTF-32LE":  # Spark's UTF-32 reads big-endian without a mark
            text = F.decode(F.col("content"), "UTF-32")
            text = F.when(F.substring(text, 1, 1) == "﻿", F.substring(text, F.lit(2), F.length(text))).otherwise(text)
        encoding, body = encoding.when(head.startswith(mark), F.lit(f"{charset}-BOM")), body.when(head.startswith(mark), text)
    return files.select("path", encoding.otherwise(F.lit("UTF-8")).alias("encoding"), body.otherwise(F.decode("content", "UTF-8")).alias("body"))


def read_bodies(spark: SparkSession, folder: str, pattern: str = "*.{xaml,axaml}") -> DataFrame:
    """Bodies of all files below a folder whose names match."""
    return decode_bodies(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder))


def encode_bodies(bodies: DataFrame) -> DataFrame:
    """(path, content): the reverse of decode_bodies, with the same mark."""
    content = F
    for mark, charset in MARKS:
        raw = F.encode("body", charset if charset != "UTF-32LE" else "UTF-32")
        if charset == "UTF-32LE":  # Spark's UTF-32 is big-endian: each four bytes are turned round
            raw = F.unhex(F.regexp_replace(F.hex(raw), "(..)(..)(..)(..)", "$4$3$2$1"))
        content = content.when(F.col("encoding") == f"{charset}-BOM", F.concat(F.unhex(F.lit(mark)), raw))
    return bodies.select("path", content.otherwise(F.encode("body", "UTF-8")).alias("content"))
