"""Summaries of logs, tracebacks and long outputs, made from line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions import vocab
from quillmill.functions.rows import unroll
from quillmill.functions.text import let, lines, strip
from quillmill.operators.segment import in_order

LEAST_LINES = 50
WIDTH = 200


def template(line: Column) -> Column:
    """Digits become N, so lines that differ in numbers group together."""
    return F.regexp_replace(line, r"\d+", "N")


def split_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return unroll(df, [key], lines(strip(F.col(text))), "line", "pos")


IS_ERROR = r"\b(ERROR|FATAL)\b"
IS_WARNING = r"\bWARN\b"


def log_levels(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Line count, count per level, and error and warning lines of each log."""
    level = F.regexp_extract(strip(F.col("line")), vocab.LOG_LEVEL, 1)
    error = F.col("line").rlike(IS_ERROR)
    counts = [F.count_if(F.col("level") == v).alias(v.lower()) for v in vocab.LOG_LEVELS]
    return rows.withColumn("level", level).groupBy(key).agg(
        F.count("*").alias("lines"), *counts, F.count_if(error).alias("error_count"),
        F.count_if(~error & F.col("line").rlike(IS_WARNING)).alias("warn_count"))


def _cut(line: Column) -> Column:
    return F.substring(strip(line), 1, WIDTH)


def top_errors(rows: DataFrame, key: str = "doc_id", most: int = 10) -> DataFrame:
    """First line of each distinct error, the earliest ten per log.

    Grouping by template first keeps the window small: only one row per
    distinct template and log reaches it.
    """
    errors = rows.filter(F.col("line").rlike(IS_ERROR)).withColumn("cut", _cut(F.col("line")))
    firsts = (errors.withColumn("tpl", template(F.col("cut"))).groupBy(key, "tpl")
              .agg(F.min("pos").alias("pos"), F.min_by("cut", "pos").alias("line"), F.count("*").alias("hits")))
    rank = F.row_number().over(W.partitionBy(key).orderBy("pos"))
    return firsts.withColumn("rk", rank).filter(F.col("rk") <= most).drop("rk")


def first_warnings(rows: DataFrame, key: str = "doc_id", most: int = 5) -> DataFrame:
    """The first five warning lines, one per template."""
    warned = rows.filter(~F.col("line").rlike(IS_ERROR) & F.col("line").rlike(IS_WARNING))
    rank = F.row_number().over(W.partitionBy(key).orderBy("pos"))
    head = warned.withColumn("rk", rank).filter(F.col("rk") <= most).withColumn("cut", _cut(F.col("line")))
    return (head.withColumn("tpl", template(F.col("cut"))).groupBy(key, "tpl")
            .agg(F.min("pos").alias("pos"), F.min_by("cut", "pos").alias("line")))


def summarise_logs(rows: DataFrame, key: str = "doc_id", least: int = LEAST_LINES) -> DataFrame:
    """One summary text per log of fifty lines or more: key, summary, lines, error_count, warn_count."""
    levels = log_levels(rows, key).filter(F.col("lines") >= least)
    errors = top_errors(rows, key).groupBy(key).agg(in_order("pos", "line", "errors"))
    warns = first_warnings(rows, key).groupBy(key).agg(in_order("pos", "line", "warns"))
    shown = [F.when(F.col(v.lower()) > 0, F.concat(F.lit(f"{v}="), F.col(v.lower()).cast("string")))
             for v in vocab.LOG_LEVELS]

    def section(title: str, n: str, items: str) -> Column:
        listed = F.transform(items, lambda x: F.concat(F.lit("  • "), x))
        return F.when(F.size(items) > 0, F.concat(F.lit(f"\n{title} ("), F.col(n).cast("string"), F.lit("):\n"),
                                                  F.array_join(listed, "\n")))

    summary = F.concat_ws("\n", F.lit("[LOG_SUMMARY]"),
                          F.concat(F.lit("Total lines: "), F.col("lines").cast("string")),
                          F.concat(F.lit("Level distribution: "), F.concat_ws(", ", *shown)),
                          section("ERRORS", "error_count", "errors"), section("WARNINGS", "warn_count", "warns"))
    return (levels.join(errors, key, "left").join(warns, key, "left")
            .select(key, summary.alias("summary"), "lines", "error_count", "warn_count"))


def log_summary(c: Column) -> Column:
    """The same summary for a log held in one row, without a shuffle."""
    shown = [F.struct(F.lit(v).alias("name")) for v in vocab.LOG_LEVELS]

    def firsts(found: Column, most: int) -> Column:
        """First line of each of the first ``most`` templates; distinct is by hash, so this is linear."""
        def pick(b: Column) -> Column:
            return F.transform(F.slice(F.array_distinct(b["tpl"]), 1, most),
                               lambda t: F.concat(F.lit("  • "), F.get(b["cut"], (F.array_position(b["tpl"], t) - 1).cast("int"))))

        return let(F.transform(found, _cut), lambda cut: let(
            F.struct(cut.alias("cut"), F.transform(cut, template).alias("tpl")), pick))

    def section(title: str, found: Column, listed: Column) -> Column:
        return F.when(F.size(found) > 0, F.concat(F.lit(f"\n{title} ("), F.size(found).cast("string"), F.lit("):\n"),
                                                  F.array_join(listed, "\n")))

    def build(ls: Column) -> Column:
        levels = F.transform(ls, lambda x: F.regexp_extract(strip(x), vocab.LOG_LEVEL, 1))
        counted = let(levels, lambda lv: F.transform(F.array(*shown), lambda v: F.struct(
            v["name"].alias("name"), F.size(F.filter(lv, lambda x: x == v["name"])).alias("n"))))
        spread = F.transform(F.filter(counted, lambda v: v["n"] > 0), lambda v: F.concat(v["name"], F.lit("="), v["n"].cast("string")))
        errors = F.filter(ls, lambda x: x.rlike(IS_ERROR))
        warns = F.filter(ls, lambda x: ~x.rlike(IS_ERROR) & x.rlike(IS_WARNING))
        return F.concat_ws("\n", F.lit("[LOG_SUMMARY]"), F.concat(F.lit("Total lines: "), F.size(ls).cast("string")),
                           F.concat(F.lit("Level distribution: "), F.array_join(spread, ", ")),
                           let(errors, lambda e: section("ERRORS", e, firsts(e, 10))),
                           let(warns, lambda w: section("WARNINGS", w, firsts(F.slice(w, 1, 5), 5))))

    return let(lines(strip(c)), build)


def error_templates(rows: DataFrame, line: str = "line", most: int = 20) -> DataFrame:
    """Most frequent line templates of a whole log corpus."""
    return (rows.withColumn("tpl", template(F.col(line))).groupBy("tpl")
            .agg(F.count("*").alias("hits"), F.min(line).alias("sample"))
            .orderBy(F.desc("hits"), "tpl").limit(most))


# Exception line and stack frame.
EXCEPTION = r"(?m)^(\w+(?:Error|Exception|Warning|Fault)[^:\n]*):?[ \t]*(.*?)$"
FRAME = r'File "([^"]+)", line (\d+), in (\w+)'


def _frames(text: Column, frames: int) -> Column:
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(FRAME), F.lit(1)).alias("path"),
        F.regexp_extract_all(text, F.lit(FRAME), F.lit(2)).alias("no"),
        F.regexp_extract_all(text, F.lit(FRAME), F.lit(3)).alias("func"))
    last = F.when(F.size(zipped) > frames, F.slice(zipped, -frames, frames)).otherwise(zipped)
    return F.transform(last, lambda f: F.concat(
        F.lit("  "), F.substring_index(f["path"], "/", -2), F.lit(":"), f["no"], F.lit(" in "), f["func"]))


def summarise_traceback(df: DataFrame, text: str = "text", out: str = "text_out", frames: int = 5,
                        least: int = LEAST_LINES) -> DataFrame:
    """Exception head and the last frames with two path segments.

    Short texts and texts without a traceback stay as they are.
    """
    head = F.when(F.col(text).rlike(EXCEPTION), F.concat(
        F.lit("ERR: "), F.regexp_extract(text, EXCEPTION, 1), F.lit(": "),
        F.substring(F.regexp_extract(text, EXCEPTION, 2), 1, WIDTH)))
    stack = F.when(F.size("frames") > 0, F.concat(F.lit("STACK (bottom→top):\n"), F.array_join("frames", "\n")))
    applies = (F.size(lines(strip(F.col(text)))) >= least) & F.col(text).contains("Traceback (most recent call last)")
    return (df.withColumn("frames", F.when(applies, _frames(F.col(text), frames)))
            .withColumn(out, F.when(applies, F.concat_ws("\n", F.lit("[TRACE_SUMMARY]"), head, stack))
                        .otherwise(F.col(text)))
            .drop("frames"))


def summarise_output(df: DataFrame, text: str = "text", out: str = "text_out", least: int = LEAST_LINES) -> DataFrame:
    """First and last five lines and lines with a keyword, each once, under a header."""
    n = F.size("ls")
    middle = let(F.col("ls"), lambda ls: F.filter(
        ls, lambda x, i: (i >= 5) & (i < F.size(ls) - 5) & x.rlike(vocab.IMPORTANT_LINE)))
    picked = F.concat(F.slice("ls", 1, 5), F.transform(middle, lambda x: F.substring(x, 1, WIDTH)),
                      F.slice("ls", -5, 5))
    header = F.concat(F.lit("[OUTPUT_SUMMARY: "), n.cast("string"), F.lit(" lines → "),
                      F.size("uniq").cast("string"), F.lit(" key lines]\n"))
    return (df.withColumn("ls", lines(strip(F.col(text))))
            .withColumn("uniq", F.when(n >= least, F.array_distinct(picked)))
            .withColumn(out, F.when(n >= least, F.concat(header, F.array_join("uniq", "\n"))).otherwise(F.col(text)))
            .drop("ls", "uniq"))


def summarise_log_text(df: DataFrame, text: str = "text", out: str = "text_out", least: int = LEAST_LINES) -> DataFrame:
    """Log summary of whole documents; documents below the line threshold stay."""
    long = F.size(lines(strip(F.col(text)))) >= least
    return df.withColumn(out, F.when(long, log_summary(F.col(text))).otherwise(F.col(text)))
