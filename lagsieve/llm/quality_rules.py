"""A threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Everything is a built-in expression: one narrow stage, no shuffle, no user
function. Rules are (metric, least, most); a bound of None is open. A document
is kept if no base rule fails and every metric lies within its bounds.

Null and empty texts have no words, fail the base rules and are not kept.
Metrics of a text without words are 0. Repeated rows are judged one by one;
other columns of the input, whatever their names, are ignored; an empty table
gives no rows; very long texts are counted whole, as arrays within one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is for it as on "
    "der die das und ist nicht den von mit ein eine zu auf für im "
    "le la les de des et en que une un du dans pour est qui par "
    "el los las y del se por con su para al como"
).split()


@dataclass(frozen=True)
class Rule:
    metric: str
    least: float | None = None
    most: float | None = None


#: Thresholds of published web filters: mean word length, symbols and stop words a word, repeated lines, shouted and marked-up words.
RULES = (
    Rule("n_words", 10, 100_000),
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("stop_words", 1, None),
    Rule("dup_line_ratio", None, 0.30),
    Rule("shout_ratio", None, 0.30),
    Rule("ellipsis_line_ratio", None, 0.30),
    Rule("bullet_line_ratio", None, 0.90),
)
#: Base rules: fewest words, and the most words in repeated windows of five (per cent).
LEAST_WORDS, WINDOW, MOST_REPEATED_PERCENT = 10, 5, 20

_S = r"[\\x20\\x09-\\x0D]"


def let(value: str, name: str, body: str) -> str:
    """SQL: body with `name` standing for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeated_words(words: str, n: int = WINDOW) -> str:
    """SQL: how many words of the array lie in n-word windows found twice or more, the first included.

    Only a text with a repeated window sorts its windows with their places.
    """
    grams, wide = "h", f"size(h) - {n - 1}"
    for k in range(2, n + 1):
        grams = f"zip_with(slice({grams}, 1, {wide}), slice(h, {k}, {wide}), (a, b) -> xxhash64(a, b))"
    placed = "sort_array(transform(g, (x, i) -> struct(x AS g, i AS i)))"
    twice = "sort_array(transform(filter(s, (x, k) -> get(s, k - 1).g = x.g OR get(s, k + 1).g = x.g), x -> x.i))"
    total = f"aggregate(p, struct({-n} AS last, 0L AS total), (a, i) -> struct(i AS last, a.total + least({n}, i - a.last) AS total), a -> a.total)"
    body = let(grams, "g", f"CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE {let(placed, 's', let(twice, 'p', total))} END")
    return f"CASE WHEN size({words}) < {n} THEN 0L ELSE {let(f'transform({words}, w -> xxhash64(w))', 'h', body)} END"


def metrics(text: str) -> dict[str, str]:
    """SQL of every raw count, over columns _words and _lines made first."""
    stop, longest = ", ".join(f"'{w}'" for w in STOP_WORDS), max(map(len, STOP_WORDS))
    return {
        "n_words": "CAST(size(_words) AS BIGINT)",
        "word_chars": "CAST(length(array_join(_words, '')) AS BIGINT)",
        "n_symbols": f"CAST(regexp_count({text}, '[#*$%&|<>]') AS BIGINT)",
        "n_dup_lines": "CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT)",
        "n_repeat_words": repeated_words("_words"),
        "n_lines": "CAST(size(_lines) AS BIGINT)",
        "stop_words": f"CAST(size(filter(_words, w -> length(w) <= {longest} AND lower(w) IN ({stop}))) AS BIGINT)",
        "n_shouted": "CAST(size(filter(_words, w -> endswith(w, '!!'))) AS BIGINT)",
        "n_ellipsis_lines": r"CAST(size(filter(_lines, l -> l RLIKE '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')) AS BIGINT)",
        "n_bullet_lines": r"CAST(size(filter(_lines, l -> l RLIKE '^[\\x20\\x09]*[•*-]')) AS BIGINT)",
    }


#: Ratios over the raw counts; 0 where there is nothing to divide by.
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "shout_ratio": ("n_shouted", "n_words"),
    "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
}


def quality(documents: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the counts, the ratios, base_failed, and kept."""
    df = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    df = df.select("doc_id", "_text", F.expr(rf"filter(split(_text, '{_S}+'), w -> w <> '')").alias("_words"), F.expr(rf"filter(split(_text, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')").alias("_lines"))
    df = df.select("doc_id", *[F.expr(sql).alias(name) for name, sql in metrics("_text").items()])
    ratio = {k: F.when(F.col(d) > 0, F.col(n).cast("double") / F.col(d)).otherwise(F.lit(0.0)) for k, (n, d) in RATIOS.items()}
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    passed = ~failed
    for r in rules:
        value = ratio.get(r.metric, F.col(r.metric))
        if r.least is not None:
            passed = passed & (value >= r.least)
        if r.most is not None:
            passed = passed & (value <= r.most)
    return df.select("*", *[v.alias(k) for k, v in ratio.items()], failed.alias("base_failed"), passed.alias("kept"))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op2_quality_rules(spark, sf_dir):
    return quality(runtime.table(spark, sf_dir, "documents")).select(*COLUMNS)


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    ratio = {k: f"(CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / {d} ELSE 0 END)" for k, (n, d) in RATIOS.items()}
    bounds = []
    for r in rules:
        value = ratio.get(r.metric, r.metric)
        bounds += [f"{value} >= {r.least}"] * (r.least is not None) + [f"{value} <= {r.most}"] * (r.most is not None)
    s = r"[\x20\x09-\x0D]"
    return rf"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{s}+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, list_aggregate(words[i:i + {WINDOW - 1}], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM a WHERE len(words) >= {WINDOW})),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c >= 2),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY doc_id),
m AS (
  SELECT a.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{s}+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(words, lambda w: lower(w) IN ({stop}))) AS BIGINT) AS stop_words,
         CAST(len(list_filter(words, lambda w: w LIKE '%!!')) AS BIGINT) AS n_shouted,
         CAST(len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines,
         CAST(len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09]*[•*-]'))) AS BIGINT) AS n_bullet_lines
  FROM a LEFT JOIN n USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {' AND '.join(bounds)}) AS kept
FROM (SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words) AS base_failed FROM m)
"""
