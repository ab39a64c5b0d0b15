"""The rule catalog as a table, user rules, and their validation (SRC3, SRC4)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.functions.build import lit
from veilspan import schemas
from veilspan.functions import regex as rx
from veilspan.functions.ambiguity import pattern_problem
from veilspan.functions.windows import running_sum
from veilspan.sources import fixed_values
from veilspan.sources.fixed_rules import RULES

MAX_REGEX_BYTES = 2000
MAX_RULES = 1_000_000  # a catalog that runs is held by the driver and its plans, so its size is checked
MAX_REPEAT = 65_536
NOT_COMPILED = "pattern does not compile"
MATCHES_EMPTY = "pattern matches the empty string"

CUSTOM_BUCKET = "custom"


def load_catalog(spark: SparkSession, path: str | None = None, fmt: str = "json") -> DataFrame:
    """Ordered rule table.

    With a path, the rules are read from that table (columns of
    ``schemas.CATALOG``); otherwise the built-in rules are returned.
    """
    if path is not None:
        reader = spark.read.schema(schemas.CATALOG)
        if fmt == "csv":
            reader = reader.option("header", True)
        return with_flags(reader.format(fmt).load(path))
    rows = [(i, *rule) for i, rule in enumerate(RULES)]
    return with_flags(spark.createDataFrame(rows, schemas.CATALOG))


def bucket_table(catalog: DataFrame) -> DataFrame:
    """Buckets in precedence order with how many rules ``catalog`` has for each; 0 means that nothing is looked for."""
    rows = [(i, stem) for i, stem in enumerate(fixed_values.BUCKETS)]
    buckets = catalog.sparkSession.createDataFrame(rows, "bucket_ord int, bucket string")
    counts = catalog.groupBy("bucket").agg(F.count("*").alias("rules"))
    return buckets.join(counts, "bucket", "left").select(
        "bucket_ord", "bucket", F.coalesce("rules", lit(0)).cast("bigint").alias("rules")
    )


def is_single_line(regex: Column) -> Column:
    """No newline, no ``\\n`` and no inline m or s flag in the pattern text (SEL8)."""
    return ~(
        F.contains(regex, lit("\n"))
        | F.contains(regex, lit("\\n"))
        | regex.rlike("\\(\\?[ixUuR-]*[ms]")
    )


def with_flags(catalog: DataFrame) -> DataFrame:
    """Add the derived flags of SEL8 and SEL9 and whether a secret group is named."""
    single = is_single_line(F.col("regex"))
    precise = F.col("severity").isin("Critical", "High") | F.col("validator").isNotNull()
    return catalog.select(
        *schemas.CATALOG.names,
        F.contains(F.col("regex"), lit("<secret>")).alias("has_secret_group"),
        single.alias("single_line"),
        (single & precise).alias("softwrap"),
    )


def parse_severity(text: Column) -> Column:
    """critical / high / low in any case and padding; anything else is Medium (SEL6)."""
    word = F.lower(F.trim(text))
    return (
        F.when(word == "critical", "Critical")
        .when(word == "high", "High")
        .when(word == "low", "Low")
        .otherwise("Medium")
    )


def compile_problem(java: Column) -> Column:
    """Why a Java regex cannot be used, or null.  Where the engine refuses one, reflection gives null and the job goes on."""
    compiled = F.try_reflect(lit("java.util.regex.Pattern"), lit("compile"), java)
    return F.when(compiled.isNull(), NOT_COMPILED).when(F.regexp_count(lit(""), java) > 0, MATCHES_EMPTY)


def compile_errors(spark: SparkSession, patterns: Iterable[str]) -> dict[str, str | None]:
    """For each pattern a one-line reason why it cannot be used, or None; all are compiled by one job."""
    out: dict[str, str | None] = {}
    ready: list[tuple[str, str]] = []
    for pattern in dict.fromkeys(patterns):
        try:
            ready.append((pattern, rx.locating_regex(pattern)[0]))
        except rx.UnsupportedPattern as e:
            out[pattern] = str(e)
    if ready:
        table = spark.createDataFrame(ready, "pattern string, java string")
        tried = table.select("pattern", compile_problem(F.col("java")).alias("reason"))
        out |= {r["pattern"]: r["reason"] for r in tried.collect()}
    return out


def _problem(p: str | None) -> tuple[str | None, str | None]:
    """(what the text of a rule's pattern tells against it, its Java form)."""
    if p is None:
        return "missing field", None
    if p == "":
        return "pattern is empty", None
    if len(p.encode()) > MAX_REGEX_BYTES:
        return f"pattern has over {MAX_REGEX_BYTES} bytes", None
    if any(int(n) > MAX_REPEAT for n in re.findall(r"\{(\d+)", p)):
        return "repetition count too large", None
    problem = pattern_problem(p)
    if problem is not None:
        return problem, None
    try:
        return None, rx.locating_regex(p)[0]
    except rx.UnsupportedPattern as e:
        return str(e), None


def _problems(rules: DataFrame) -> DataFrame:
    """Add ``reason``: why a rule cannot be used, found in the tasks that hold the rules."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_problem(p) for p in batch.column("regex").to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "reason", "java"])

    schema = T.StructType([*rules.schema.fields, *(T.StructField(c, T.StringType()) for c in ("reason", "java"))])
    missing = F.greatest(*[F.col(c).isNull() for c in ("name", "category", "severity", "regex")])
    reason = F.when(missing, "missing field").when(F.col("reason").isNotNull(), F.col("reason"))
    return rules.mapInArrow(checked, schema).withColumn("reason", reason.otherwise(compile_problem(F.col("java"))))


def validate_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a rule table of any size into (good, rejected with reason) (SEL7).

    Rules are dealt to all tasks, which read size and ambiguity off each
    pattern's automaton and compile what is left: one job, kept for both
    results.  A column ``pos`` that tells the rules' order is kept.
    """
    columns = ["name", "category", "severity", "regex", *(["pos"] if "pos" in rules.columns else [])]
    dealt = rules.select(*columns).repartition(4 * rules.sparkSession.sparkContext.defaultParallelism)
    table = _problems(dealt).drop("java").persist()
    good = table.filter("reason is null").drop("reason")
    rejected = table.filter("reason is not null").select(
        "name",
        F.concat(
            lit("rule left out, "), F.coalesce("name", lit("no name")), lit(": "), "reason"
        ).alias("error"),
    )
    return good.withColumn("severity", parse_severity(F.col("severity"))), rejected


def load_custom_patterns(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read user rules from JSON lines: (good rules, errors) (SRC4).

    Good rules carry ``pos``, their order by file and line.  A missing file
    gives no rules and no error; a file with a line that does not parse gives
    no rules and one error.  Any other failure to read is raised.
    """
    numbered = T.StructType([*schemas.CUSTOM_RULE.fields, T.StructField("pos", T.LongType(), True)])
    empty = spark.createDataFrame([], numbered)
    no_errors = spark.createDataFrame([], "name string, error string")
    schema = T.StructType([*schemas.CUSTOM_RULE.fields, T.StructField("_corrupt_record", T.StringType(), True)])
    try:
        raw = (
            spark.read.schema(schema)
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(path)
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty, no_errors
    # lines of a file follow each other within a block, blocks by where they start
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    placed = raw.select("*", split.alias("_split"), F.monotonically_increasing_id().alias("_line")).persist()
    if placed.filter("_corrupt_record is not null").head(1):
        error = [(None, f"{path} parse error")]
        return empty, spark.createDataFrame(error, "name string, error string")
    splits = placed.select("_split").distinct()
    order = splits.select("_split", F.row_number().over(Window.orderBy("_split")).alias("_no"))
    ranked = running_sum(
        placed.join(order, "_split"), [], F.col("_no"), [F.col("_line")], F.lit(1).cast("bigint"), "_rank"
    )
    return validate_rules(ranked.select(*schemas.CUSTOM_RULE.names, (F.col("_rank") - 1).alias("pos")))


def save_custom_patterns(rules: DataFrame, path: str) -> None:
    """Write rules as JSON lines, in the order of ``pos`` where they have one."""
    if "pos" in rules.columns:
        rules = rules.orderBy("pos").coalesce(1)
    rules.select("name", "category", "severity", "regex").write.mode("overwrite").json(path)


def collect_rules(catalog: DataFrame) -> list:
    """The rules on the driver, in order; the table's size is checked."""
    rows = catalog.orderBy("ord").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return rows
