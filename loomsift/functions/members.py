"""Column expressions over archive member headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import traverses


def repeated(members: DataFrame) -> DataFrame:
    """Adds ``seen``: the name stands earlier in the same file."""
    return members.withColumn("seen", F.row_number().over(Window.partitionBy("file_id", "name").orderBy("ord")) > 1)


def tar_refusal() -> Column:
    """Why a member with the columns name, type, mode, link_target and seen is refused; the first reason counts, null: none."""
    name, mode, link = F.col("name"), F.col("mode"), F.col("link_target")

    def why(text: str) -> Column:
        return F.concat(F.lit(text), F.lit(": "), name)

    out = F.when(F.startswith(name, F.lit("/")), why("absolute path")).when(traverses(name), why("path traversal")).when(F.col("seen"), why("duplicate member"))
    out = out.when(mode.bitwiseAND(0o4000) != 0, why("setuid member")).when(mode.bitwiseAND(0o2000) != 0, why("setgid member"))
    out = out.when(F.col("type").isin("char", "block", "fifo"), why("non-regular member")).when(F.col("type") == "hardlink", why("hardlink"))
    escape = (F.col("type") == "symlink") & link.isNotNull() & (F.startswith(link, F.lit("/")) | traverses(link))
    return out.when(escape, F.concat(why("symlink escape"), F.lit(" -> "), link))


def zip_description() -> Column:
    """Of unix_mode, year, month, day and comment; ``normalized`` if there is nothing to say."""
    special = F.col("unix_mode").bitwiseAND(0o7000)
    quoted = F.col("comment")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    parts = F.concat_ws(
        ", ",
        F.when(special != 0, F.concat(F.lit("special bits 0o"), F.conv(special.cast("string"), 10, 8))),
        F.when(F.col("year") != 1980, F.format_string("mtime %d-%02d-%02d", "year", "month", "day")),
        F.when(F.col("comment") != "", F.concat(F.lit('comment "'), quoted, F.lit('"'))),
    )
    return F.when(parts == "", "normalized").otherwise(parts)


def is_suspicious_zip() -> Column:
    return F.col("unix_mode").isNull() | (F.col("year") != 1980) | (F.col("comment") != "")


def tar_description() -> Column:
    def part(c: str, empty: object) -> Column:
        return F.when(F.col(c) != empty, F.concat(F.lit(f"{c}="), F.col(c).cast("string")))

    return F.concat_ws(", ", part("mtime", 0), part("uid", 0), part("gid", 0), part("uname", ""), part("gname", ""))


def within_total_cap(members: DataFrame, cap: int) -> DataFrame:
    """Adds total (running size in order) and capped: the archive is over its cap from here on."""
    run = Window.partitionBy("file_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return members.withColumn("total", F.sum("size").over(run).cast("long")).withColumn("capped", F.col("total") > cap)


def output_order(members: DataFrame) -> DataFrame:
    """First occurrence of each name, ``mimetype`` first, then by name; adds out_ord from 0."""
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("file_id", "name").orderBy("ord"))).where("n = 1").drop("n")
    order = Window.partitionBy("file_id").orderBy(F.col("name") != "mimetype", "name")
    return first.withColumn("out_ord", (F.row_number().over(order) - 1).cast("long"))


def member_action(policy: Column) -> Column:
    """write, drop or error for a member with the boolean columns ``nested`` and ``handled``."""
    known = F.col("handled") & ~F.col("nested")
    return F.when(known, "clean").when(policy == "keep", "write").when(policy == "omit", "drop").otherwise("error")
