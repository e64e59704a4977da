r"""Text dumps of database tables: ``COPY table (columns) FROM stdin;``, tab-separated rows, ``\.``; many tables a file.

Files are read by lines wherever Spark splits them. A line's place in its file is its block's offset and its number within
the task, so markers are found anywhere, and each line is matched with the block it lies in by its place: nothing has to
be read in order, and no task sees a whole file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.skills import extract_skills
from ..functions.text import clean_text, json_string_list, strip, try_float, try_int
from ..storage import staged

HEADER = r"^COPY\s+(\S+)\s+\((.+)\)\s+FROM\s+stdin;$"
END = r"\."
#: Up to so many blocks of tables are sent to all executors, two places and a header each.
BROADCAST_BLOCKS = 100_000
#: Escapes of one letter, and job types of a posting.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
JOB_TYPES = ("fulltime", "parttime", "intern", "contract", "temporary", "全职", "兼职", "实习")
_TOKEN = r"(?s)\\[0-7]{1,3}|\\x[0-9A-Fa-f]{1,2}|\\.|[^\\]+|\\"
_STAMPED = r"(?s)^(.*?)(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?[+-]\d{2})$"


def unescape(c: Column) -> Column:
    r"""The text of a field, its escapes undone from left to right: \b \f \n \r \t \v, \ooo, \xhh; any other escaped character is itself."""

    def one(token: Column) -> Column:
        second = F.substring(token, 2, 1)
        code = F.when(second.rlike("[0-7]"), F.conv(F.substring(token, 2, 3), 8, 10)).when(token.rlike(r"^\\x[0-9A-Fa-f]"), F.conv(F.substring(token, 3, 2), 16, 10))
        plain = second
        for letter, char in ESCAPES.items():
            plain = F.when(second == letter, F.lit(char)).otherwise(plain)
        return F.when(~token.startswith("\\") | (token == "\\"), token).when(code.isNotNull(), F.char(code.cast("long") % 256)).otherwise(plain)

    return F.when(~F.contains(c, F.lit("\\")), c).otherwise(F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_TOKEN), 0), one), ""))


def escape(c: Column) -> Column:
    """The field as a dump has it; null is \\N."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for letter, char in ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit("\\" + letter))
    return F.coalesce(out, F.lit(r"\N"))


def _flag(c: Column) -> Column:
    return F.when(F.lower(c).isin("t", "true", "1", "yes"), True).when(F.lower(c).isin("f", "false", "0", "no"), False)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, value): places order the lines of a file."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    return rows.select("file", F.struct("start", "n").alias("place"), "value")


def blocks(lines: DataFrame) -> DataFrame:
    r"""(file, first, last, table, columns) of each table's rows, between its header and the next ``\.``, or the end of the file.

    A header is one only outside of a block: what looks like one among the rows is a row.
    """
    header = F.col("value").rlike(HEADER)
    marks = lines.filter(header | (F.col("value") == END)).withColumn("opens", header)
    order = W.partitionBy("file").orderBy("place")
    after = F.min(F.when(~F.col("opens"), F.col("place"))).over(order.rowsBetween(1, W.unboundedFollowing))
    found = marks.withColumn("before", F.lag("opens").over(order)).withColumn("last", after).filter(F.col("opens") & ~F.coalesce("before", F.lit(False)))
    names = F.transform(F.split(F.regexp_extract("value", HEADER, 2), ","), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))
    return found.select("file", F.col("place").alias("first"), "last", F.regexp_extract("value", HEADER, 1).alias("table"), names.alias("columns"))


def read_dump(spark: SparkSession, path: str, table: str | None = None, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    r"""(table, columns, fields): a row for each row of the dumps in ``path``, of one table or of all; fields still escaped.

    Lines outside of blocks and empty lines within are no rows.
    """
    lines = _lines(spark, path)
    found = staged(blocks(lines))
    ranges = found.filter(F.col("table") == table) if table else found
    ranges = ranges.withColumnRenamed("file", "of")
    ranges = F.broadcast(ranges) if ranges.count() <= broadcast_blocks else ranges
    inside = (F.col("file") == F.col("of")) & (F.col("place") > F.col("first")) & (F.col("last").isNull() | (F.col("place") < F.col("last")))
    return lines.filter("value <> ''").join(ranges, inside).select("table", "columns", F.split("value", "\t", -1).alias("fields"))


def field(c: Column) -> Column:
    r"""A field's value: \N is null, escapes are undone."""
    return F.when(c != r"\N", unescape(c))


def read_dump_table(spark: SparkSession, path: str, table: str, schema: dict[str, str]) -> DataFrame:
    """The columns of one table by their names in its header, cast tolerantly; a column that the header lacks is null."""
    rows = read_dump(spark, path, table)
    at = lambda name: F.array_position("columns", name)
    value = lambda name: F.when(at(name) > 0, field(F.try_element_at("fields", at(name).cast("int"))))
    return rows.select(*[value(n).try_cast(kind).alias(n) for n, kind in schema.items()])


def write_fields(df: DataFrame, table: str, path: str) -> None:
    """A table of fields that are escaped already as a folder of dumps, a file a task with its own header and end; streamed, whatever the size."""
    head = f"COPY {table} ({', '.join(df.columns)}) FROM stdin;"

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        yield from (pa.RecordBatch.from_arrays([b.column(0)], ["value"]) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([END, ""])], ["value"])

    rows = df.select(F.concat_ws("\t", *[F.col(f"`{c}`") for c in df.columns]).alias("value"))
    rows.mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def write_dump(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as a folder of dumps in ``path``."""
    for name, df in tables.items():
        write_fields(df.select(*[escape(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns]), name, f"{path}/{name}")


def read_jobs_dump(spark: SparkSession, path: str, table: str | None = None, types: tuple[str, ...] = JOB_TYPES, least: int = 20) -> DataFrame:
    """Openings of a dump whose rows vary in their number of fields, so that fields are found from the right and from the job type.

    Rows of fewer than ``least`` fields and rows without a job type are left out. From the right: quality flag, source, updated_at,
    created_at (with a degree before the time stamp, or else the degree is the field before), years, three vectors. The last
    field that is a job type parts title, description, company and place from pay and summary.
    """
    raw = read_dump(spark, path, table).select("fields", F.size("fields").alias("n")).filter(F.col("n") >= least)
    clean = lambda x: F.nullif(strip(field(x)), F.lit(""))
    rows = raw.select("n", F.transform("fields", clean).alias("f"))
    at = lambda i: F.try_element_at("f", i.cast("int"))
    n = F.col("n")
    stamp = lambda g: F.nullif(F.regexp_extract(at(n - 3), _STAMPED, g), F.lit(""))
    degree = F.nullif(strip(stamp(1)), F.lit(""))
    rows = rows.withColumns({"created_at": F.coalesce(stamp(2), at(n - 3)), "degree": F.coalesce(degree, at(n - 4)), "years_at": n - 4 - F.when(degree.isNull(), 1).otherwise(0)})
    end = F.col("years_at") - 4
    is_type = lambda i: F.lower(F.get("f", i.cast("int") - 1)).isin(*types)
    rows = rows.withColumn("at", F.when(end >= 1, F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(end, F.lit(1))), is_type)))).filter("at >= 4")
    some = lambda start, size: F.filter(F.slice("f", start, F.greatest(size, F.lit(0))), lambda x: x.isNotNull())
    rows = rows.withColumns({"p": some(F.lit(4), F.col("at") - 4), "s": some(F.col("at") + 9, end - F.col("at") - 8)})
    p = lambda i: F.get("p", F.lit(i))
    last = lambda name, i: F.try_element_at(name, F.lit(-i))
    parts, said = F.size("p"), F.size("s")
    split = parsing.split_title(p(0))
    whole, second = parsing.looks_like_description(p(0)), parsing.looks_like_description(p(1))
    first_is_all = (parts == 1) | (parts.isin(2, 3) & whole)
    title = F.when(first_is_all, split["title"]).otherwise(clean_text(p(0)))
    description = F.when(first_is_all, split["description"]).when((parts == 3) & second, clean_text(p(1))).when(parts > 4, F.array_join(F.slice("p", F.lit(2), F.greatest(parts - 3, F.lit(0))), "\n\n")).when(parts == 4, p(1))
    company = F.when(parts >= 4, clean_text(last("p", 2))).when((parts == 3) & (whole | ~second), clean_text(p(1))).when(parts == 2, clean_text(p(1)))
    place = F.when(parts >= 3, clean_text(last("p", 1)))
    summary = F.when(said > 3, F.array_join(F.slice("s", F.lit(1), F.greatest(said - 2, F.lit(0))), "\n\n")).otherwise(F.get("s", F.lit(0)))
    t = lambda k: at(F.col("at") + k)
    out = rows.select(
        at(F.lit(1)).alias("id"), at(F.lit(2)).alias("job_id"), at(F.lit(3)).alias("owner_org_id"), F.coalesce(title, F.lit("Untitled Role")).alias("title"), description.alias("description"), company.alias("company"), place.alias("location"),
        t(0).alias("job_type"), _flag(t(1)).alias("salary_negotiable"), *[try_int(t(k)).alias(name) for k, name in enumerate(("salary_min", "salary_max", "salary_months_min", "salary_months_max", "intern_salary_amount"), 2)], t(7).alias("intern_salary_unit"), F.coalesce(t(8), F.lit("CNY")).alias("salary_currency"),
        summary.alias("said"), F.when(said >= 3, json_string_list(last("s", 2))).otherwise(F.array().cast("array<string>")).alias("responsibilities"), F.when(said >= 2, json_string_list(last("s", 1))).otherwise(F.array().cast("array<string>")).alias("highlights"),
        try_float(at(F.col("years_at"))).alias("experience_years"), parsing.norm_degree(F.col("degree")).alias("min_degree"), "created_at", at(n - 2).alias("updated_at"), at(n - 1).alias("source"), _flag(at(n)).alias("jd_quality_passed"),
    )
    composed = parsing.compose_summary(F.col("said"), F.col("description"), F.col("title"))
    return out.withColumn("summary", composed).withColumn("skills", extract_skills(F.col("summary"))).drop("said")
