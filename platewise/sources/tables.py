"""Reading and writing the text tables the analysis exchanges."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.functions.numeric import no_nan
from platewise.roles import floating_columns
from platewise.session import stage


def _reader(spark: SparkSession, sep: str, schema: T.StructType | str | None):
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("nanValue", "nan")
        .option("positiveInf", "inf")
        .option("negativeInf", "-inf")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
    )
    return reader.schema(schema) if schema is not None else reader.option("inferSchema", True)


def _nan_as_null(df: DataFrame) -> DataFrame:
    values = {c: no_nan(F.col(f"`{c}`")).alias(c) for c in floating_columns(df)}
    return df.select(*[values.get(c, F.col(f"`{c}`")) for c in df.columns])


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Tab-separated table with a header. Give a schema at scale: inference reads the data twice.

    ``nan`` is missing, ``inf`` and ``-inf`` are infinite values.
    """
    return _nan_as_null(_reader(spark, "\t", schema).csv(path))


def read_csv(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, multi_line: bool = False,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Comma-separated table, optionally only some columns.

    ``multi_line`` is for cells with line breaks, such as the headers of tag tables; each file is one task then.
    """
    df = _nan_as_null(_reader(spark, ",", schema).option("multiLine", multi_line).csv(path))
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def _column_names(header: Sequence[str]) -> list[str]:
    """Names as Spark gives them: repeated ones get their position, empty ones too."""
    names = [h.strip() for h in header]
    seen = Counter(n.lower() for n in names)
    return [f"_c{i}" if not n else f"{n}{i}" if seen[n.lower()] > 1 else n for i, n in enumerate(names)]


#: What a number in a text can look like. A value of another form is not cast: a failing cast raises and catches an
#: error inside the task, which takes far longer than the pattern.
_WHOLE = r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*$"
_REAL = (
    r"(?i)^[\x00-\x20\x7f]*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?[fd]?|inf(inity)?|nan"
    r"|0x[0-9a-f]*\.?[0-9a-f]*p[+-]?[0-9]+[fd]?)[\x00-\x20\x7f]*$"
)
_FORMS = {T.IntegerType(): _WHOLE, T.LongType(): _WHOLE, T.DoubleType(): _REAL}


def _as(c: Column, kind: T.DataType) -> Column:
    """``try_cast``, tried only on values that look like one of the kind."""
    return F.when(c.rlike(_FORMS[kind]), c.try_cast(kind)) if kind in _FORMS else c.try_cast(kind)


def _guessed(df: DataFrame, names: Sequence[str]) -> dict[str, T.DataType]:
    """The narrowest of integer, long, double and boolean that takes all values of a column; else string."""
    kinds = (T.IntegerType(), T.LongType(), T.DoubleType())

    def fits(name: str) -> Column:
        c = F.col(f"`{name}`")
        # A whole number is read once, as a long, for both of the whole kinds.
        whole = _as(c, T.LongType())
        good = [F.count(F.when(whole.between(-(1 << 31), (1 << 31) - 1), c)), F.count(whole), F.count(_as(c, T.DoubleType()))]
        good.append(F.count(F.when(F.lower(c).isin("true", "false"), c)))
        return F.struct(F.count(c).alias("n"), F.array(*good).alias("good"))

    found = df.agg(*[fits(n).alias(f"_{i}") for i, n in enumerate(names)]).first()
    out = {}
    for name, got in zip(names, found):
        match = [k for k, good in zip((*kinds, T.BooleanType()), got["good"]) if good == got["n"] > 0]
        out[name] = match[0] if match else T.StringType()
    return out


def _read_by_name(
    spark: SparkSession, path: str, sep: str, schema: T.StructType | None = None, pattern: str | None = None, recursive: bool = False
) -> DataFrame:
    """Union by column name of files whose headers may differ; adds ``_file``, the name of the file as a URL.

    Spark finds the files. One pass takes the first line of each, another reads all of them by position, whatever their
    headers; where there are several headers each row meets its file's by join. The distinct headers come to the driver,
    file names do not. Without a schema, types are guessed from all values (a third pass); no dates are guessed.
    """
    def options(reader):
        reader = reader.option("recursiveFileLookup", recursive)
        return reader.option("pathGlobFilter", pattern) if pattern else reader

    try:
        lines = options(spark.read).text(path).where(F.col("_metadata.file_block_start") == 0)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no files match {path}") from e
        raise
    lines = lines.select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("i"), "value")
    # One row per file.
    heads = stage(lines.groupBy("_file").agg(F.min_by("value", "i").alias("_head")), "file-headers")
    layouts = sorted(r["_head"] for r in heads.select("_head").distinct().collect())
    if not layouts:
        raise FileNotFoundError(f"no files match {path}")
    places: dict[str, list[tuple[str, int]]] = {}
    width = 0
    for line in layouts:
        header = _column_names(next(csv.reader([line], delimiter=sep)))
        width = max(width, len(header))
        for i, name in enumerate(header):
            places.setdefault(name, []).append((line, i))
    by_place = T.StructType([T.StructField(f"_p{i}", T.StringType()) for i in range(width)])
    # A header is skipped by Spark, not compared with the schema.
    rows = options(_reader(spark, sep, by_place).option("enforceSchema", True)).csv(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"))
    if len(layouts) > 1:
        rows = rows.join(heads, "_file")

    def value(name: str) -> Column:
        if len(layouts) == 1:
            return F.col(f"_p{places[name][0][1]}")
        at: dict[int, list[str]] = {}
        for line, i in places[name]:
            at.setdefault(i, []).append(line)
        return F.coalesce(*[F.when(F.col("_head").isin(own), F.col(f"_p{i}")) for i, own in at.items()])

    named = rows.select(*[value(n).alias(n) for n in places], "_file")
    kinds = _guessed(named, list(places)) if schema is None else {f.name: f.dataType for f in schema.fields}
    typed = [_as(F.col(f"`{n}`"), kinds.get(n, T.StringType())).alias(n) for n in places]
    return _nan_as_null(named.select(*typed, "_file"))


def _part(back: int) -> Column:
    """The piece of ``_file`` that many slashes from its end, as plain text; a plus sign stays one."""
    piece = F.substring_index(F.substring_index("_file", "/", -back), "/", 1)
    return F.url_decode(F.replace(piece, F.lit("+"), F.lit("%2B")))


def combine_instances(spark: SparkSession, root: str, file: str, schema: T.StructType | None = None) -> DataFrame:
    """The same file of every worker folder under ``root``, by column name, with ``Subfolder``."""
    df = _read_by_name(spark, f"{root}/*/{file}", "\t", schema)
    return df.withColumn("Subfolder", _part(2)).drop("_file")


def combine_parts(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """``combine_instances`` where each worker's table is a folder ``root/worker/name/part-*``."""
    df = _read_by_name(spark, f"{root}/*/{name}", "\t", schema, "part-*")
    return df.withColumn("Subfolder", _part(3)).drop("_file")


def scan_glob(
    spark: SparkSession,
    path: str,
    pattern: str,
    recursive: bool = False,
    sep: str = "\t",
    schema: T.StructType | None = None,
) -> DataFrame:
    """All files matching a name pattern, by column name, with ``subset`` = file name without suffix."""
    df = _read_by_name(spark, path, sep, schema, pattern, recursive)
    return df.withColumn("subset", F.regexp_replace(_part(1), r"\.[^.]*$", "")).drop("_file")


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Text lookup with ``#`` comment lines: every column a string, missing values empty."""
    raw = spark.read.option("header", True).option("sep", "\t").option("comment", "#").csv(path)
    return raw.na.fill("")


def read_header(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """``pos, name`` of a table's header line, duplicate names kept."""
    lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0).limit(1)
    return lines.select(F.posexplode(F.split("value", sep)).alias("pos", "name")).withColumn("name", F.trim("name"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed name per non-blank line."""
    return spark.read.text(path).select(F.trim("value").alias("feature")).where(F.col("feature") != "")


def write_list(df: DataFrame, path: str) -> None:
    df.select(F.col(df.columns[0]).cast("string").alias("value")).write.text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).option("nanValue", "nan").option(
        "positiveInf", "inf"
    ).option("negativeInf", "-inf").csv(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """One folder per stratum. Rebalancing gathers small strata and splits hot ones over tasks."""
    df.hint("rebalance", *[F.col(k) for k in keys]).write.partitionBy(*keys).parquet(path)
