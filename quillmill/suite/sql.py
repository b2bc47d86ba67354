"""Fragments of the checking SQL (DuckDB dialect)."""

BLANKS = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def trim(c: str) -> str:
    return f"trim({c}, {BLANKS})"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def tokens(c: str) -> str:
    return f"greatest(1, length({c}) // 4)"


def pct(before: str, after: str) -> str:
    """Percent removed, rounded half up in whole numbers."""
    b, a = f"({before})::HUGEINT", f"({after})::HUGEINT"
    return f"(CASE WHEN {before} > 0 THEN ((({b}) - ({a})) * 2000 + ({b})) // (2 * ({b})) / 10.0 ELSE 0.0 END)::DOUBLE"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


def raw_sentences(c: str) -> str:
    return f"string_split(regexp_replace({trim(c)}, '([.!?])\\s+', '\\1'||chr(1), 'g'), chr(1))"


def sentences(c: str) -> str:
    return f"list_filter(list_transform({raw_sentences(c)}, lambda s: {trim('s')}), lambda s: s <> '')"


def terms(c: str, least: int = 1) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{{least},}}')"


def join(c: str, sep: str = "' '") -> str:
    return f"coalesce(array_to_string({c}, {sep}), '')"


def mark_words(c: str) -> str:
    """Wrap each word in control characters, so that word borders are exact in every script."""
    return f"regexp_replace({c}, '([\\p{{L}}\\p{{N}}_]+)', chr(2)||'\\1'||chr(3), 'g')"


def unmark(c: str) -> str:
    return f"regexp_replace({c}, '[\\x02\\x03]', '', 'g')"


def flat_filter(c: str, stop) -> str:
    return join(f"list_filter({words(c)}, lambda w: rtrim(lower(w), '.,!?') NOT IN ({quoted(stop)}))")


def stop_filter(c: str, droppable, least: int = 2) -> str:
    """Sentence-aware filter: first and last word stay, short sentences stay."""
    keep = f"list_filter(ws, lambda w, i: i = 1 OR i = len(ws) OR rtrim(lower(w), '.,!?;:') NOT IN ({quoted(droppable)}))"
    body = let(words("s"), "ws", f"CASE WHEN len(ws) <= {least} THEN s ELSE {join(keep)} END")
    return join(f"list_transform({sentences(c)}, lambda s: {body})")


def let(value: str, name: str, body: str) -> str:
    return f"(list_transform([{value}], lambda {name}: {body}))[1]"


def sentence_rows(c: str = "text", source: str = "documents", plain: bool = False, key: str = "doc_id") -> str:
    """CTE body: key, n, pos (from 0), s."""
    ss = raw_sentences(c) if plain else sentences(c)
    return (f"SELECT {key}, len(ss) AS n, unnest(generate_series(0, len(ss) - 1)) AS pos, unnest(ss) AS s "
            f"FROM (SELECT {key}, {ss} AS ss FROM {source})")
