"""Quality rules: a threshold table compiled into one Spark projection.

The metrics of a text are plain SQL expressions (no user functions), the
rules are rows of a threshold table, and ``apply_rules`` compiles the table
into one more projection over the metrics.  No shuffle, no join: the plan is
a scan and projections, so it scales with the number of scan tasks.

Defined results
  null text      counts as a text without words (all metrics 0, not kept)
  empty text     as null
  repeated rows  every row is judged by itself; equal texts get equal verdicts
  extra columns  carried through untouched; a column of the input that has the
                 name of an added one is replaced by it
  no text column an error
  empty table    empty result with the same columns

The stop words are of English, French, German and Spanish: texts in other
languages fail that rule, and a corpus that has them passes its own ``rules``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: function words of the four languages the rule looks for
STOP_WORDS = (
    "the be to of and that have with in is it for was on as "
    "de la le les des et en un une du que est pour "
    "der die das und zu den von ein ist mit sich "
    "el los las y se del por con una").split()

WS = r"[ \\t\\n\\x0B\\f\\r]"


@dataclass(frozen=True)
class Rule:
    """A text fails the rule when ``metric`` is below ``low`` or above ``high``."""
    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: the threshold table; ratios are per word or per line
RULES = (
    Rule("too_short", "n_words", low=50),
    Rule("too_repetitive", "100 * n_repeat_words - 50 * n_words", high=0),
    Rule("word_length", "word_chars / n_words", low=3.0, high=10.0),
    Rule("symbols", "n_symbols / n_words", high=0.1),
    Rule("stop_words", "n_stop_words / n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines / n_lines", high=0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", high=0.3),
    Rule("bullet_lines", "n_bullet_lines / n_lines", high=0.9),
)
BASE_RULES = ("too_short", "too_repetitive")


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and ``body`` with ``name`` bound to it.

    A lambda body that names an expression would evaluate it for every
    element; a lambda variable is evaluated once per row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeat_words_sql(words: str) -> str:
    """Words lying in 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash.  Texts without a repeated window (the
    distinct count equals the count) skip the sort.  In a sorted list of
    window starts, start s adds min(3, s - previous start) new words.
    """
    starts = ("array_sort(transform(filter(s, (x, j) -> (j > 0 AND s[j - 1].h = x.h) OR "
              "(j + 1 < size(s) AND s[j + 1].h = x.h)), x -> x.i))")
    covered = ("aggregate(" + starts + ", named_struct('p', -3, 'n', 0), "
               "(a, i) -> named_struct('p', i, 'n', a.n + least(3, i - a.p)), a -> a.n)")
    sorted_windows = "sort_array(transform(hs, (h, i) -> named_struct('h', h, 'i', i)))"
    body = (f"CASE WHEN size(array_distinct(hs)) = size(hs) THEN 0 "
            f"ELSE {let(sorted_windows, 's', covered)} END")
    hashes = "transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2]))"
    return let(words, "ws", f"CASE WHEN size(ws) < 3 THEN 0 ELSE {let(hashes, 'hs', body)} END")


def metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the metric columns (all ``bigint``) to ``df``."""
    if text not in df.columns:
        raise ValueError(f"no column {text}")
    t = F.coalesce(F.col("_in")[text], F.lit(""))
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    # the input as one value, so that no name of its columns meets one of these
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_in")).withColumns({
        "_w": F.array_remove(F.split(t, "[ \\t\\n\\x0B\\f\\r]+"), ""),
        "_l": F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("bigint"),
    })
    e = {
        "n_words": "size(_w)",
        "word_chars": "char_length(array_join(_w, ''))",
        "n_dup_lines": "size(_l) - size(array_distinct(_l))",
        "n_repeat_words": repeat_words_sql("_w"),
        "n_stop_words": f"size(filter(_w, w -> lower(w) IN ({stop})))",
        "n_lines": "size(_l)",
        "n_ellipsis_lines": f"size(filter(_l, x -> rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…'))",
        "n_bullet_lines": "size(filter(_l, x -> substr(ltrim(x), 1, 1) IN ('-', '*', '•')))",
    }
    added = [F.col("n_symbols"), *[F.expr(v).cast("bigint").alias(k) for k, v in e.items()]]
    names = ["n_symbols", *e]
    return rows.select(*[F.col("_in")[c].alias(c) for c in df.columns if c not in names], *added)


def rule_failed(rule: Rule):
    """The rule as one boolean column; a ratio without denominator is 0."""
    num, _, den = rule.metric.partition(" / ")
    value = F.expr(f"CASE WHEN {den} = 0 THEN 0D ELSE CAST({num} AS DOUBLE) / {den} END" if den else rule.metric)
    failed = F.lit(False)
    if rule.low is not None:
        failed = failed | (value < F.lit(rule.low))
    if rule.high is not None:
        failed = failed | (value > F.lit(rule.high))
    return failed


def apply_rules(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``df`` with metrics, ``failed_rules`` (names), ``base_failed`` (a base
    rule failed) and ``kept`` (no rule failed)."""
    m = metrics(df, text)
    names = F.array_compact(F.array(*[F.when(rule_failed(r), F.lit(r.name)) for r in rules]))
    base = [rule_failed(r) for r in RULES if r.name in BASE_RULES]
    m = m.withColumns({"failed_rules": names, "base_failed": base[0] | base[1]})
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_clean(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``df`` that fail no rule, with the columns of ``df``.

    A filter on ``kept`` would be pushed below the projection and evaluate
    every metric again for each rule that names it; a row is therefore kept
    by exploding an array of one or no row."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    judged = apply_rules(df.select(row.alias("_row"), F.col(f"`{text}`").alias(text)), text, rules)
    return judged.select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row")).select("_row.*")


QUERY_COLUMNS = ("doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words "
                 "base_failed kept failed_rules").split()


def metrics_sql(table: str = "documents", columns: str = "doc_id, text") -> str:
    """DuckDB CTEs ending in ``judged``: the input columns, metrics and verdicts."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    ws = r"[\x20\x09-\x0D]"
    cond = []
    for r in RULES:
        num, _, den = r.metric.partition(" / ")
        v = f"(CASE WHEN {den} = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / {den} END)" if den else f"({r.metric})"
        parts = [f"{v} < {r.low}"] * (r.low is not None) + [f"{v} > {r.high}"] * (r.high is not None)
        cond.append(f"CASE WHEN {' OR '.join(parts)} THEN '{r.name}' END")
    return rf"""toks AS (
  SELECT row_number() OVER () AS rid, {columns}, coalesce(text, '') AS tx,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM {table}),
wins AS (
  SELECT rid, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM toks)),
reps AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
repw AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS p FROM reps) GROUP BY rid),
mets AS (
  SELECT t.*, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(tx, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words, len(l) AS n_lines,
         len(list_filter(l, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ellipsis_lines,
         len(list_filter(l, lambda x: substr(ltrim(x, ' '), 1, 1) IN ('-', '*', '•'))) AS n_bullet_lines
  FROM toks t LEFT JOIN repw r USING (rid)),
judged AS (
  SELECT *, failed_rules = [] AS kept FROM (
    SELECT *, list_filter([{', '.join(cond)}], lambda x: x IS NOT NULL) AS failed_rules,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
    FROM mets))"""


SQL = f"WITH {metrics_sql()} SELECT {', '.join(QUERY_COLUMNS)} FROM judged"


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_rules(docs).select(*QUERY_COLUMNS)
