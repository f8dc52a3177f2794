"""Tab-separated sources and sinks with the reader's and writer's hazards settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions.normalize import NA_CELLS, normalize

_OPTIONS = {"sep": "\t", "header": True, "quote": '"', "escape": '"'}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str, least: int = 0) -> bool:
    """Whether ``path`` is there and holds more than ``least`` bytes."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p)) and fs.getContentSummary(p).getLength() > least


def present(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, empty or not."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_files(spark: SparkSession, folder: str, suffix: str = ".tsv") -> list[str]:
    """Sorted data files of a folder, without ground truth."""
    fs, p = _fs(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    return [n for n in names if n.endswith(suffix) and "ground_truth" not in n]


def place() -> Column:
    """Where a scanned row stands: its file, the split's start in it, and its order in the split.

    Unlike the row's number in a scan, this doesn't depend on how Spark packs files into tasks.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")
    )


def has_line_breaks(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether some quoted cell may span lines: a line holds an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_tsv(spark: SparkSession, path: str | list[str], multiline: bool | None = None) -> DataFrame:
    """All columns as strings, missing cells null, with ``ord``, a row's place in file order.

    Files are read in splits. Only cells with line breaks need ``multiline``, which reads each
    file in one task; None looks for them first, in a pass over the text in splits.
    """
    if multiline is None:
        multiline = has_line_breaks(spark, path)
    d = spark.read.options(**_OPTIONS, multiLine=multiline, inferSchema=False).csv(path)
    return d.select(*(F.when(~F.col(c).isin(NA_CELLS), F.col(c)).alias(c) for c in d.columns), place().alias("ord"))


def write_tsv(df: DataFrame, path: str, skip_existing: bool = False, single_file: bool = False) -> bool:
    """Write without quotes around empty strings; False if an output over 1,024 bytes was kept.

    The output is a folder of part files, each with a header; parts without rows are dropped.
    With ``single_file`` the parts are joined to one file at ``path``, with one header.
    """
    spark = df.sparkSession
    if skip_existing and exists(spark, path, 1024):
        return False
    rows = df.drop("ord").fillna("")
    target = f"{path}.parts" if single_file else path
    rows.write.mode("overwrite").csv(target, sep="\t", header=True, emptyValue="", quote='"', escape='"')
    head = len("\t".join(rows.columns).encode()) + 1
    fs, p = _fs(spark, target)
    parts = sorted((s for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())
    full = [s for s in parts if s.getLen() > head]
    for s in parts:
        if s.getLen() <= head and (full or s is not parts[0]):
            fs.delete(s.getPath(), False)
    if single_file:
        _join_parts(spark, fs, [s.getPath() for s in full or parts[:1]], path, head)
        fs.delete(p, True)
    return True


def _join_parts(spark: SparkSession, fs, parts: list, path: str, head: int) -> None:
    """One file of all parts, in order; the header of each but the first is left out."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs.exists(own):
        fs.delete(own, True)
    out = fs.create(own, True)
    for k, p in enumerate(parts):
        part = fs.open(p)
        part.seek(head if k else 0)
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, spark._jsc.hadoopConfiguration(), False)
        part.close()
    out.close()


def preprocess_tsv(spark: SparkSession, path: str) -> DataFrame:
    return normalize(read_tsv(spark, path))


def process_directory(spark: SparkSession, source: str, target: str) -> dict[str, bool]:
    """Normalise every data file; sources 1 to 3 get fixed names. Returns outputs and whether each was written."""
    done: dict[str, bool] = {}
    for n in list_files(spark, source):
        own = next((f"normalized_source{k}.tsv" for k in "123" if f"source{k}" in n), f"normalized_{n}")
        wrote = write_tsv(preprocess_tsv(spark, f"{source}/{n}"), f"{target}/{own}", skip_existing=True)
        done[own] = done.get(own, False) or wrote
    return done


def find_source(spark: SparkSession, folder: str, k: int, prefixes: tuple[str, ...] = ("normalized_", "test_", "train_")) -> str:
    for p in prefixes:
        if exists(spark, path := f"{folder}/{p}source{k}.tsv"):
            return path
    raise FileNotFoundError(f"source {k} in {folder}")


def load_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Union of all data files, ``ord`` ascending by file; later records win by it."""
    out = None
    for k, n in enumerate(list_files(spark, folder)):
        d = read_tsv(spark, f"{folder}/{n}").fillna("").withColumn("ord", F.struct(F.lit(k).alias("src"), "ord"))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no data files in {folder}")
    return out


def load_candidates(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path).fillna("")


def truth_lists(rows: DataFrame) -> DataFrame:
    """(s1, ids) of (source1_entity_id, matched_entity_ids, ord) rows; the last row of an id wins."""
    ids = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    d = rows.select(F.trim("source1_entity_id").alias("s1"), ids.alias("ids"), "ord").filter("s1 <> ''")
    return d.groupBy("s1").agg(F.max_by("ids", "ord").alias("ids"))


def load_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return truth_lists(read_tsv(spark, path))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Different first columns, as plain text without quoting; headers and blank lines are left out."""
    d = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)
    first, *rest = (F.col(f"`{c}`") for c in d.columns)
    own = F.trim(F.coalesce(first, F.lit("")))
    blank = (own == "") & (F.coalesce(*rest).isNull() if rest else F.lit(True))
    return d.filter(~blank).select(own.alias("id")).distinct()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value) of all lines, the header of each file included."""
    return spark.read.text(path).select(place().alias("ord"), "value")


def numbered(lines: DataFrame) -> DataFrame:
    """Adds ``line``, counted from 1 within each file, to the rows of ``read_lines``.

    ``lines`` must be staged and hold every line: numbers come from the rows' places, by sums
    over splits, of which there are far fewer than rows.
    """
    split = lines.groupBy(F.col("ord.file").alias("f_"), F.col("ord.start").alias("s_")).agg(F.min("ord.row").alias("first_"), F.count("*").alias("n_"))
    w = Window.partitionBy("f_").orderBy("s_").rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn("before_", F.coalesce(F.sum("n_").over(w), F.lit(0)))
    own = lines.join(split, (F.col("ord.file") == F.col("f_")) & (F.col("ord.start") == F.col("s_")))
    return own.withColumn("line", F.col("ord.row") - F.col("first_") + F.col("before_") + 1).drop("f_", "s_", "first_", "n_", "before_")
