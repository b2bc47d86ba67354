"""Source and markup jobs.  Line and pattern work inside the row; inventories are grouped."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import vocab
from quillmill.functions.rows import unroll, unroll_fields
from quillmill.functions.text import let, lines, strip, unicode

NO_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(NO_STRINGS)


def _chain(c: Column, rules) -> Column:
    """The rules in order; one with a third entry runs only over texts with that literal, which each of its matches needs."""
    for pattern, replacement, *needed in rules:
        c = _where_needed(c, pattern, replacement, needed[0]) if needed else F.regexp_replace(c, pattern, replacement)
    return c


def _where_needed(c: Column, pattern: str, replacement: str, needed: str) -> Column:
    return let(c, lambda t: F.when(t.contains(needed), F.regexp_replace(t, pattern, replacement)).otherwise(t))


def compact_whitespace(c: Column) -> Column:
    """Right-trimmed lines, one blank line at most, single blanks inside a line."""
    one_blank = strip(F.regexp_replace(_rstrip_lines(c), r"\n{3,}", "\n\n"))
    # Runs of blanks collapse unless they start a line.
    return F.regexp_replace(one_blank, r"  (?<!\n  )(?<!^  ) *", " ")


def _rstrip_lines(c: Column) -> Column:
    """Each line without the blanks at its end; a run of blanks is read once."""
    return F.regexp_replace(c, r"[ \t\r\f\x0b](?<![ \t\r\f\x0b]{2})[ \t\r\f\x0b]*+(?![^\n])", "")


# Import lines.
FROM_IMPORT = r"^from\s+([\w.]+)\s+import\s+(.+)$"
PLAIN_IMPORT = r"^import\s+(.+)$"


def consolidate_imports(df: DataFrame, text: str = "text", out: str = "text_out") -> DataFrame:
    """Imports first: plain ones sorted, names of one module merged; then the other lines."""
    # Both kinds hold the word, so most lines are told without a pattern.
    def is_from(line: Column) -> Column:
        return line.contains("import") & strip(line).rlike(FROM_IMPORT)

    def is_plain(line: Column) -> Column:
        return line.contains("import") & strip(line).rlike(PLAIN_IMPORT)

    def names(line: Column) -> Column:
        raw = F.btrim(F.regexp_extract(line, FROM_IMPORT, 2), F.lit("()"))
        return F.filter(F.transform(F.split(raw, ","), strip), lambda n: n != "")

    def named(line: Column) -> Column:
        """(module, name) for each name of an import line, and (module, null) for the line itself."""
        return let(F.regexp_extract(line, FROM_IMPORT, 1), lambda m: F.transform(
            F.array_append(names(line), F.lit(None).cast("string")), lambda n: F.struct(m.alias("module"), n.alias("name"))))

    entry = F.sort_array(F.flatten(F.transform(F.array_distinct(F.transform(F.filter("ls", is_from), strip)), named)))
    plain = F.flatten(F.transform(F.array_distinct(F.transform(F.filter("ls", is_plain), strip)), lambda x: F.transform(
        F.split(F.regexp_extract(x, PLAIN_IMPORT, 1), ","), lambda n: F.concat(F.lit("import "), strip(n)))))

    def merged(entries: Column) -> Column:
        """One line for each module; sorted entries of a module are neighbours, and the one without a name comes first."""
        starts = F.filter(F.transform(entries, lambda e, i: F.when(
            (i == 0) | (e["module"] != F.get(entries, i - 1)["module"]), i)), lambda i: i.isNotNull())

        def line(bounds: Column) -> Column:
            own = F.slice(entries, bounds["a"] + 1, bounds["b"] - bounds["a"])
            names_of = F.array_join(F.array_distinct(F.transform(own, lambda e: e["name"])), ", ")
            shown = let(names_of, lambda j: F.when(F.length(j) > 60, F.concat(F.lit("("), j, F.lit(")"))).otherwise(j))
            return F.concat(F.lit("from "), F.get(entries, bounds["a"])["module"], F.lit(" import "), shown)

        return let(starts, lambda at: F.transform(F.transform(at, lambda a, k: F.struct(
            a.alias("a"), F.coalesce(F.get(at, k + 1), F.size(entries)).alias("b"))), line))

    froms = let(F.col("entries"), merged)
    head = F.concat("plain", "froms")
    gap = F.when(F.size("plain") + F.size("froms") > 0, F.array(F.lit(""))).otherwise(_none())
    rest = F.filter("ls", lambda x: ~x.contains("import") | (~is_from(x) & ~is_plain(x)))
    return (df.withColumn("ls", lines(F.col(text)))
            .withColumn("entries", entry)
            .withColumn("plain", F.sort_array(F.array_distinct(plain)))
            .withColumn("froms", froms)
            .withColumn(out, strip(F.array_join(F.concat(head, gap, rest), "\n")))
            .drop("ls", "entries", "plain", "froms"))


def import_inventory(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Modules of the corpus: files that import them and number of import lines."""
    row = unroll(df, [key], lines(F.col(text)), "line").select(key, strip(F.col("line")).alias("line"))
    module = F.when(F.col("line").rlike(FROM_IMPORT), F.array(F.regexp_extract("line", FROM_IMPORT, 1))).otherwise(
        F.transform(F.split(F.regexp_extract("line", PLAIN_IMPORT, 1), ","), strip))
    used = unroll(row.filter(F.col("line").rlike(FROM_IMPORT) | F.col("line").rlike(PLAIN_IMPORT)), [key], module, "module")
    # Grouped by file first, so a module imported everywhere is pre-aggregated twice.
    per_file = used.groupBy("module", key).agg(F.count("*").alias("n"))
    return per_file.groupBy("module").agg(F.count("*").alias("files"), F.sum("n").alias("uses"))


def unfence(c: Column) -> Column:
    """The first fenced block replaces the text."""
    # The block ends at the first fence that ends its line; what comes before is read in one go.
    pattern = r"(?m)^```\w*\n?((?:[^`]++|`(?!``\s*$))*+)```\s*$"
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1))).otherwise(c)


# Fixed values.  Markup comments go before the -- rule, which would cut them to "<!".
COMMENTS = (
    (r"^#!.*\n?", "", "#!"),
    (r"<!--[\s\S]*?-->", "", "<!--"),
    (r"//[^\n]*", "", "//"),
    (r"/\*[\s\S]*?\*/", "", "/*"),
    (r"--[^\n]*", "", "--"),
    (r"#[^\n]*", "", "#"),
    (r"\n\s*\n+", "\n"),
)


def drop_comments(c: Column) -> Column:
    return strip(_chain(c, COMMENTS))


def drop_comments_generic(df: DataFrame, text: str = "text", out: str = "text_out") -> DataFrame:
    """Block comments, line comments outside URLs, blank runs; with line counts."""
    pruned = _chain(F.col(text), (
        (r"/\*[\s\S]*?\*/", "", "/*"), (r"(?m)(?=//)(?<!:)//(?!/).*$", "", "//"), (r"\n{3,}", "\n\n"),
        (r"(?m)[ \t](?<![ \t]{2})[ \t]*+$", "")))
    staged = df.withColumn("pruned", pruned)
    # Only runs of lines made of other blanks remain to be collapsed; most texts have none.
    run = F.col("pruned").rlike(r"(?dm)^[ \t\r\f\x0b]*+\n[ \t\r\f\x0b]*+(?:\n|\z)")
    kept = let(F.col("ls"), lambda ls: F.filter(
        ls, lambda x, i: (strip(x) != "") | (i == 0) | (strip(F.get(ls, i - 1)) != "")))
    return (staged.withColumn("ls", lines(F.col("pruned"))).withColumn("kept", F.when(run, kept))
            .withColumn(out, F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("pruned")))
            .withColumn("kept", F.coalesce("kept", "ls"))
            .withColumns({"lines_before": F.size("ls"), "lines_after": F.size("kept"),
                          "lines_removed": F.size("ls") - F.size("kept")})
            .drop("pruned", "ls", "kept"))


def strip_hash_and_docstrings(c: Column) -> Column:
    return strip(_chain(c, ((r"#[^\n]*", "", "#"), (r'"""[\s\S]*?"""', "", '"""'), (r"'''[\s\S]*?'''", "", "'''"), (r"\n\s*\n+", "\n"))))


def basic_cleanup(c: Column) -> Column:
    return strip(_chain(c, ((r"#[^\n]*", "", "#"), (r"(?s)'''(.*?)'''", "", "'''"), (r'(?s)"""(.*?)"""', "", '"""'), (r"\n\s*\n", "\n"))))


def minify(c: Column) -> Column:
    """Comments, docstrings and type hints go; blanks collapse."""
    return strip(_chain(c, (
        (r"#[^\n]*", "", "#"), (r'"""[\s\S]*?"""', '""', '"""'), (r"'''[\s\S]*?'''", "''", "'''"),
        (unicode(r":\s*[\w\[\], |]+\s*="), " ="), (unicode(r"->\s*[\w\[\], |]+:"), ":", "->"),
        (r"\n\s*\n+", "\n"), (r"  +", " "))))


def squeeze_whitespace(c: Column) -> Column:
    return strip(_chain(c, ((r"[ \t]+", " "), (r"\n\s*\n", "\n"), (r"(?m)^\s+", ""))))


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line, F.lit(" \t\r\f\x0b")))


def _bare(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\r\f\x0b"))


def drop_unreachable(df: DataFrame, text: str = "text", out: str = "text_out") -> DataFrame:
    """After a jump, skip deeper or blank lines; drop lines that only pass."""
    start = F.struct(_none().alias("kept"), F.lit(None).cast("int").alias("skip"))

    def cut(x: Column) -> Column:
        return F.struct(x.alias("x"), _bare(x).alias("bare"))

    def step(state: Column, line: Column) -> Column:
        x, bare = line["x"], line["bare"]
        indent = F.length(x) - F.length(bare)
        skipped = state["skip"].isNotNull() & ((indent > state["skip"]) | (bare == ""))
        word = bare.startswith("return") | bare.startswith("raise") | bare.startswith("break") | bare.startswith("continue")
        jump = word & bare.rlike(r"^(return|raise|break|continue)\b")
        kept = F.struct(F.array_append(state["kept"], x).alias("kept"),
                        F.when(jump, indent).otherwise(F.lit(None).cast("int")).alias("skip"))
        passed = F.struct(state["kept"].alias("kept"), F.lit(None).cast("int").alias("skip"))
        return F.when(skipped, state).when(bare == "pass", passed).otherwise(kept)

    # A line without indent ends every skip, so the text is folded one top-level part at a time.
    parts = F.transform(F.split(F.col(text), r"\n(?=\S)"), lambda p: F.aggregate(F.transform(lines(p), cut), start, step, lambda s: s["kept"]))
    folded = F.array_join(F.flatten(parts), "\n")
    return df.withColumn(out, strip(F.regexp_replace(folded, r"\n\s*\n+", "\n")))


def drop_unreachable_plain(df: DataFrame, text: str = "text", out: str = "text_out") -> DataFrame:
    """Variant: only return and raise count, and the skip starts one level higher."""
    start = F.struct(_none().alias("kept"), F.lit(False).alias("skip"), F.lit(0).alias("base"))

    def step(state: Column, x: Column) -> Column:
        indent = _indent(x)
        jump = (x.contains("return") | x.contains("raise")) & x.rlike(r"^ *(return|raise)\b")
        kept = F.struct(F.array_append(state["kept"], x).alias("kept"), jump.alias("skip"),
                        F.when(jump, indent - 4).otherwise(state["base"]).alias("base"))
        return F.when(state["skip"] & (indent > state["base"]), state).otherwise(kept)

    # A line without indent ends every skip but that of a jump near the margin, which never ends: so the text is
    # folded one top-level part at a time, and parts after such a jump go.
    parts = F.transform(F.split(F.col(text), r"\n(?=\S)"), lambda p: F.aggregate(lines(p), start, step))
    used = let(parts, lambda ps: F.slice(ps, F.lit(1), F.coalesce(F.nullif(F.array_position(F.transform(
        ps, lambda s: s["skip"] & (s["base"] < 0)), F.lit(True)), F.lit(0)).cast("int"), F.size(ps))))
    folded = F.array_join(F.flatten(F.transform(used, lambda s: s["kept"])), "\n")
    return df.withColumn(out, strip(_chain(folded, ((r"\n\s*pass\s*\n", "\n"), (r"\n\s*\n+", "\n")))))


# Where a block starts.
BLOCK_START = r"(?m)^(?=(?:async\s+)?def\s+\w+|class\s+\w+)"
BLOCK = r"^((?:async\s+)?def\s+\w+|class\s+\w+)"
# Words that keep their meaning when names are normalised (fixed values).
KEYWORDS = ("False None True and as assert async await break class continue def del elif else except "
            "finally for from global if import in is lambda nonlocal not or pass raise return try "
            "while with yield").split()


def normalised_block(c: Column) -> Column:
    """Same shape, other names: literals become one mark, names another, layout vanishes."""
    # Keywords by their first letters, so that a name is told by a few of them.
    keep = "|".join(k + "(?:" + "|".join(w[1:] for w in own) + ")" for k, own in itertools.groupby(sorted(KEYWORDS), lambda w: w[0]))
    return strip(_chain(c, (
        (r"#[^\n]*", "", "#"),
        (r"(?=['\"])(?:'''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\"|\"[^\"\n]*\"|'[^'\n]*')", "0"),
        (r"\d(?<=\b\d)\d*(?:\.\d+)?\b", "0"),
        (r"\b(?!\W)(?!\d|(?:" + keep + r")\b)\w++", "_"),
        (r"[ \t](?<![ \t]{2})[ \t]*+\n", "\n"), (r"\n\s*\n+", "\n"), (r"[ \t]+", " "))))


def _with_blocks(df: DataFrame, text: str) -> DataFrame:
    parts = F.split(F.col(text), BLOCK_START, -1)
    return df.withColumn("parts", parts).withColumn("blocks", F.filter("parts", lambda p: p.rlike(BLOCK)))


def block_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per function or class: key, pos, block, digest of the normalised block."""
    return (unroll(_with_blocks(df, text), [key], "blocks", "block", "pos")
            .withColumn("digest", F.md5(normalised_block(F.col("block")))))


def drop_duplicate_blocks(df: DataFrame, text: str = "text", out: str = "text_out") -> DataFrame:
    """Keep the first block of each shape within a file."""
    first = let(F.col("digests"), lambda d: F.filter(
        "blocks", lambda b, i: F.array_position(d, F.get(d, i)) == i + 1))
    header = F.when(F.element_at("parts", 1).rlike(BLOCK), "").otherwise(F.element_at("parts", 1))
    return (_with_blocks(df, text)
            .withColumn("digests", F.transform("blocks", lambda b: F.md5(normalised_block(b))))
            .withColumn(out, F.when(F.size("blocks") < 2, F.col(text))
                        .otherwise(F.concat(header, F.array_join(first, "\n"))))
            .drop("parts", "blocks", "digests"))


def clone_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shapes found more than once in the corpus: copies, files and the first place."""
    blocks = block_table(df, key, text)
    per_file = blocks.groupBy("digest", key).agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return (per_file.groupBy("digest")
            .agg(F.sum("n").alias("copies"), F.count("*").alias("files"),
                 F.min(F.struct(key, "pos")).alias("f"))
            .filter("copies > 1")
            .select("digest", "copies", "files", F.col(f"f.{key}").alias("first_file"), F.col("f.pos").alias("first_pos")))


# Rewrites of temp-then-return, return-bool and else-after-return forms.
FLOW_RULES = (
    (r"(?m)(\s++)(\w++)\s*+=\s*(.++)\n\1return\s++\2\b", "$1return $3", "return"),
    (r"(?m)(\s++)(\w++)\s*+=\s*(.++)\n\1yield\s++\2\b", "$1yield $3", "yield"),
    (r"(?m)(\s*)if\s+(.+):\n\1    return True\n\1return False\b", "$1return bool($2)", "return True"),
    (r"(?m)(\s*)if\s+(.+):\n\1    return False\n\1return True\b", "$1return not bool($2)", "return True"),
    (r"(?m)(return .+)\n(\s*)else:\n", "$1\n", "else:"),
)


def flatten_flow(c: Column) -> Column:
    return _chain(c, FLOW_RULES)


SYMBOLS = {
    "function": r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\(([^)]*)\)",
    "script_function": r"function\s+(\w+)\s*\(([^)]*)\)",
    "class": r"(?m)^[ \t]*class[ \t]+(\w+)()",
    "import": r"(?m)^[ \t]*import[ \t]+([\w.]+)()",
    "from_import": r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]+([^\n]+)",
}


def symbol_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Functions with arguments, classes and imports: key, kind, name, detail, pos within its kind."""
    def found(kind: str, pattern: str) -> Column:
        names = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
        details = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2))
        return F.transform(F.arrays_zip(names.alias("n"), details.alias("d")), lambda z, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"), z["n"].alias("name"), z["d"].alias("detail")))

    return unroll_fields(df, [key], F.concat(*[found(k, p) for k, p in SYMBOLS.items()]))


# The pattern form of the symbol text.
TRANSPILE = (
    (r"function\s+(\w+)\s*\(([^)]*)\)\s*\{", "[FN:$1($2)]"),
    (r"class\s+(\w+)", "[CLS:$1]"),
    (r"(?m)import\s+(.+?)\s*;?$", "[IMP:$1]"),
    (r"//[^\n]*", ""),
    (r"\s+", " "),
)


def symbol_text(c: Column) -> Column:
    """Compact text form by pattern; the first line names the format."""
    return strip(_chain(F.concat(F.lit(vocab.SYMBOL_HEADER), c), TRANSPILE))


def strip_trailing_comments(c: Column) -> Column:
    return _chain(c, ((r"\s+#[^\n]*", "", "#"),))


def collapse_newlines(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def normalise_whitespace(c: Column) -> Column:
    """Four blanks for a tab, right-trimmed lines, one final newline."""
    spaced = F.replace(c, F.lit("\t"), F.lit("    "))
    return F.concat(strip(_rstrip_lines(spaced)), F.lit("\n"))


def clean_code_output(c: Column) -> Column:
    return normalise_whitespace(collapse_newlines(strip_trailing_comments(c)))
