"""Values against tables of patterns of any size, as equi joins.

Most patterns hold a literal that every match must contain.  Of its three-letter
grams the one found in the fewest values becomes the pattern's key, so a value
meets only patterns whose rarest gram it holds.  The pattern itself decides.
Patterns without a literal are tried on every value of their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.skew import spread_join
from quillmill.functions.text import let

GRAM = 3
DEPTH = 6
# A class, and an innermost group, neither after a backslash.
CLASS = r"(?<!\\)\[(?:\\.|[^\]\[\\])+\]"
GROUP = r"(?<!\\)\((?:\\.|[^()\\])*\)"
# What the reader of literals does not read: alternatives, flags and special groups, code escapes, quoting,
# double backslashes, unions and intersections of classes, classes that begin with a bracket.
UNREAD = r"\||\(\?|\\[^dDwWsSbBtnrf\W]|\\\\|\[[^\]]*\[|&&|\[\^?\]|[\x00-\x1f]"
TOKEN = r"((?:\\.|.)(?:[*?+]|\{[^}]*\})?[+?]?)"


def compiles(pattern: Column) -> Column:
    """Whether the engine that runs the pattern accepts it; found on the executors."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def required_literal(pattern: Column) -> Column:
    """Lower-cased ASCII text of ``GRAM`` characters or more that every match holds (in either case); null if none is known."""
    flat = F.regexp_replace(pattern, CLASS, ".")
    for _ in range(DEPTH):
        flat = F.regexp_replace(flat, GROUP, ".")

    def piece(token: Column) -> Column:
        escaped = token.startswith("\\")
        sign = F.substring(token, F.when(escaped, 2).otherwise(1), F.lit(1))
        rest = F.substring(token, F.when(escaped, 3).otherwise(2), F.length(token))
        special = F.when(escaped, sign.rlike("[A-Za-z0-9]")).otherwise(sign.rlike(r"[.^$]")) | ~sign.rlike(r"[\x20-\x7e]")
        once = F.when(special, F.lit("\n")).otherwise(sign)
        return F.when(rest == "", once).when(rest.startswith("+"), F.concat(once, F.lit("\n"))).otherwise(F.lit("\n"))

    def longest(runs: Column) -> Column:
        best = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))
        return F.when(best["n"] >= GRAM, F.lower(best["run"]))

    def read(p: Column) -> Column:
        runs = F.split(F.array_join(F.transform(F.regexp_extract_all(p, F.lit(TOKEN), F.lit(1)), piece), ""), "\n")
        return F.when(~p.rlike(r"(?<!\\)[()\[\]]"), let(runs, longest))

    return F.when(~pattern.rlike(UNREAD), let(flat, read))


def grams(c: Column) -> Column:
    """Distinct ``GRAM``-letter pieces, found in one walk over the text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def _matching(value: Column, tried: Column) -> Column:
    return let(F.lower(value), lambda low: F.filter(tried, lambda t: F.coalesce(
        low.contains(t["literal"]), F.lit(True)) & F.regexp_like(value, F.concat(F.lit("(?i)"), t["pattern"]))))


def pattern_hits(values: DataFrame, patterns: DataFrame, group: list[str], owner: str, value: str = "value",
                 ) -> DataFrame:
    """Patterns found in each distinct value of their group, in either case: group, digest, owner, matched.

    ``patterns`` holds group, owner, pos and pattern, all accepted by the engine;
    ``matched`` lists an owner's patterns by pos.  ``digest`` is the value's
    SHA-256.  Null values hold nothing, values without a hit give no row, and
    either table may be empty.
    """
    place = [*group, "digest"]
    distinct = (values.filter(F.col(value).isNotNull()).select(*group, F.col(value).alias("value")).distinct()
                .withColumn("digest", F.sha2(F.col("value").cast("binary"), 256)))
    table = patterns.select(*group, owner, "pos", "pattern").withColumn("literal", required_literal(F.col("pattern")))
    entry = F.struct("pos", "pattern", "literal")

    keyed = table.filter("literal is not null").withColumn("gram", F.explode(grams(F.col("literal"))))
    wanted = keyed.select(*group, "gram").distinct()
    # A gram may lie in most values of a group: spread by the value, counted before the shuffle.
    held = spread_join(distinct.select(*place, F.explode(grams(F.lower("value"))).alias("gram")), wanted,
                       [*group, "gram"], "digest", "left_semi")
    common = held.groupBy(*group, "gram").agg(F.count("*").alias("n"))
    # A pattern with a gram that no value holds matches nothing.
    rarest = (keyed.join(common, [*group, "gram"], "left").groupBy(*group, owner, "pos", "pattern", "literal")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
              .filter("least.n > 0").withColumn("gram", F.col("least.gram")))
    met = spread_join(held, rarest.select(*group, "gram", owner, entry.alias("e")), [*group, "gram"], "digest")
    by_gram = met.groupBy(*place, owner).agg(F.collect_list("e").alias("tried"))
    free = (table.filter("literal is null").groupBy(*group, owner).agg(F.collect_list(entry).alias("tried")))
    texts = distinct.select(*place, "value")
    # Candidates of a value are unique per owner, so neither join repeats a text more often than it has owners.
    tried = by_gram.join(texts, place).select(*place, owner, "value", "tried").unionByName(
        spread_join(texts, free, group, "digest").select(*place, owner, "value", "tried"))
    found = tried.withColumn("found", _matching(F.col("value"), F.col("tried"))).filter(F.size("found") > 0)
    return (found.groupBy(*place, owner).agg(F.flatten(F.collect_list("found")).alias("found"))
            .select(*place, owner, F.transform(F.array_sort("found"), lambda t: t["pattern"]).alias("matched")))
