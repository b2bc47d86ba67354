"""Algorithms by name: text column in, text column out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators import code, dedup, logs, opcode, quotes, ranking, rules, wordfilter

Operator = Callable[..., DataFrame]


@dataclass(frozen=True)
class Algorithm:
    """``run(df, text=..., out=...)`` adds ``out`` and keeps every other column."""
    name: str
    run: Operator
    kind: str
    level: str
    side: str = "input"
    label: str = ""


REGISTRY: dict[str, Algorithm] = {}


def register(name: str, fn: Operator, kind: str = "text", level: str = "light", side: str = "input",
             label: str = "") -> Algorithm:
    """Add an algorithm, or replace one of the same name."""
    algo = Algorithm(name, fn, kind, level, side, label or name)
    REGISTRY[name] = algo
    return algo


def column_operator(fn: Callable[[Column], Column]) -> Operator:
    def run(df: DataFrame, text: str = "text", out: str = "text_out") -> DataFrame:
        return df.withColumn(out, fn(F.col(text)))

    return run


def rule_operator(rule_list) -> Operator:
    return column_operator(lambda c: rules.rewrite(c, rule_list))


_TEXT = (
    ("hedge", column_operator(rules.remove_hedges), "light", "Filler and hedge removal"),
    ("quote", quotes.shorten_quotes, "light", "Long-quote shortening"),
    ("stopword", column_operator(wordfilter.drop_stop_words), "light", "Sentence-aware stop-word filter"),
    ("redundancy", dedup.drop_redundant, "medium", "Redundant-sentence removal"),
    ("tfidf", ranking.rank_tfidf, "medium", "TF-IDF sentence ranking"),
    ("semantic", ranking.keep_signal, "medium", "Signal-vocabulary filter"),
    ("chunking", ranking.condense, "aggressive", "Extractive condenser"),
    ("entities", ranking.keep_anchored, "aggressive", "Entity-anchor filter"),
    ("bytecode", opcode.encode_opcodes, "extreme", "Opcode rewrite"),
    ("corp_dict", rule_operator(rules.DOMAIN), "extreme", "Domain vocabulary"),
    ("stopword_flat", column_operator(wordfilter.drop_stop_words_flat), "light", "Flat stop-word filter"),
    ("light_words", column_operator(wordfilter.drop_light_words), "light", "Token-weight filter"),
    ("redundancy_plain", dedup.drop_redundant_plain, "medium", "Redundant sentences by words"),
    ("tfidf_plain", ranking.rank_tfidf_plain, "medium", "TF-IDF ranking, plain"),
    ("signal_plain", ranking.keep_signal_substring, "medium", "Signal substrings"),
    ("blocks", ranking.condense_blocks, "aggressive", "First sentences of word blocks"),
)
_CODE = (
    ("whitespace", column_operator(code.compact_whitespace), "light", "input", "Whitespace compaction"),
    ("import_dedup", code.consolidate_imports, "light", "input", "Import consolidation"),
    ("comment_prune", column_operator(code.drop_comments), "medium", "input", "Comment removal"),
    ("dead_code", code.drop_unreachable, "medium", "input", "Unreachable lines"),
    ("struct_dedup", code.drop_duplicate_blocks, "medium", "input", "Duplicate blocks"),
    ("logic_flatten", column_operator(code.flatten_flow), "aggressive", "input", "Control-flow rewrites"),
    ("symbols", column_operator(code.symbol_text), "extreme", "input", "Symbol text"),
    ("regex", column_operator(code.strip_hash_and_docstrings), "light", "input", "Comments and docstrings"),
    ("minifier", column_operator(code.minify), "medium", "input", "Minifier"),
    ("dead_code_plain", code.drop_unreachable_plain, "medium", "input", "Unreachable lines, plain"),
    ("squeeze", column_operator(code.squeeze_whitespace), "light", "input", "Whitespace squeeze"),
    ("fence", column_operator(code.unfence), "light", "output", "Code-fence extraction"),
    ("trailing_strip", column_operator(code.strip_trailing_comments), "light", "output", "Trailing comments"),
    ("newline_collapse", column_operator(code.collapse_newlines), "light", "output", "Newline collapse"),
    ("ws_normalize", column_operator(code.normalise_whitespace), "light", "output", "Whitespace normalisation"),
)
for _name, _fn, _level, _label in _TEXT:
    register(_name, _fn, "text", _level, "input", _label)
for _name, _fn, _level, _side, _label in _CODE:
    register(_name, _fn, "code", _level, _side, _label)
register("output_rules", column_operator(rules.clean_output), "text", "light", "output", "Output clean-up")
register("log_summary", logs.summarise_log_text, "code", "aggressive", "input", "Log summary")
register("trace_summary", logs.summarise_traceback, "code", "aggressive", "input", "Traceback summary")


def registered(kind: str) -> list[str]:
    """Names of all algorithms of a kind."""
    return [n for n, a in REGISTRY.items() if a.kind == kind]
