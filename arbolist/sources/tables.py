"""Sources and sinks: tables of expression text, parsed once and stored as Parquet.

A parsed column is a struct of key, text and nodes, of which Parquet reads what a query needs: equality and grouping read
`sx.key` alone, and containment's prefilters on it reach the scan.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parsed(df: DataFrame, text: Column | str = "sx", keep_text: bool = False) -> DataFrame:
    """df with its expression text parsed as column `sx`; keep_text: and the text as `sx_text`."""
    if keep_text:
        df = df.withColumn("sx_text", F.col(text) if isinstance(text, str) else text)
    out = df.withColumn("sx", C.parse_sexp(text))
    return out if not isinstance(text, str) or text == "sx" else out.drop(text)


def store(df: DataFrame, path: str, text: str = "sx", mode: str = "overwrite") -> DataFrame:
    """Parse, write as Parquet, and read again."""
    out = parsed(df, text)
    out.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def storage(spark: SparkSession, path: str) -> DataFrame:
    """files and bytes below a path: one row. Only names and lengths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="arbolist-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path


def write_text(df: DataFrame, path: str, nodes: str = "sx", mode: str = "overwrite") -> None:
    """Write display texts, a value a line (strings escape their line ends)."""
    df.select(C.sexp_text(nodes).alias("value")).write.mode(mode).text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Parse a value a line."""
    return parsed(spark.read.text(path), "value")


def quoted(text: Column) -> Column:
    """A string literal of the expression grammar."""
    out = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


def events_text() -> Column:
    """(event <id> (type "<type>") (user <user>) (value <cents>) (props (k <k>)))"""
    return F.format_string('(event %d (type "%s") (user %d) (value %d) (props (k %s)))', "event_id", "event_type", "user_id", F.floor(F.col("value") * 100).cast("long"), F.get_json_object("props", "$.k"))


def orders_text() -> Column:
    """(order <key> (cust <cust>) (status "<status>") (priority "<priority>"))"""
    return F.format_string('(order %d (cust %d) (status "%s") (priority "%s"))', "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def nations_text() -> Column:
    """(nation (name "<name>") (region (name "<region>")))"""
    return F.format_string('(nation (name "%s") (region (name "%s")))', "n_name", "r_name")


def lineitem_text() -> Column:
    """(* (* <quantity> (- 100 <discount %>)) (+ 100 <tax %>))"""
    pct = lambda c: F.round(F.col(c) * 100).cast("int")
    return F.format_string("(* (* %d (- 100 %d)) (+ 100 %d))", F.col("l_quantity").cast("long"), pct("l_discount"), pct("l_tax"))


def documents_text() -> Column:
    """(doc <id> (lang <lang>) (source <source>) (text "<text>"))"""
    return F.concat(F.lit("(doc "), F.col("doc_id").cast("string"), F.lit(" (lang "), F.col("lang"), F.lit(") (source "), F.col("source"), F.lit(") (text "), quoted(F.col("text")), F.lit("))"))


_stored: dict[tuple, DataFrame] = {}


def version(spark: SparkSession, path: str) -> tuple:
    """What changes when a table is written anew: its files' names, lengths and times."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(place)))


def ingested(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows with their expressions, parsed and stored once for a session, as the queries' input."""
    sources = [name, "region"] if name == "nation" else [name]
    key = (spark.sparkContext.applicationId, sf_dir, name, *(version(spark, f"{sf_dir}/{s}.parquet") for s in sources))
    if key not in _stored:
        if name == "nation":
            src = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        else:
            src = read(spark, sf_dir, name)
        text = {"events": events_text, "orders": orders_text, "nation": nations_text, "lineitem": lineitem_text, "documents": documents_text}[name]()
        src = src.withColumn("sx", text)
        cores = spark.sparkContext.defaultParallelism
        if len(src.inputFiles()) < cores:  # few files make few tasks; ranges of the first column keep its statistics narrow
            src = src.repartitionByRange(cores, src.columns[0]).sortWithinPartitions(src.columns[0])
        _stored[key] = store(src, f"{scratch(spark)}/{name}")
    return _stored[key]
