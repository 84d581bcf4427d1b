"""Quality rules with thresholds that follow the data, by DataFrame functions only.

Each text gets a few rates in thousandths, by integer arithmetic. For every language and source a histogram of each
rate is kept: 0 to 63 by single values, then 32 bins for each doubling, so that a quantile is off by a thirty-second
at most. Such histograms are mergeable quantile sketches whose result doesn't depend on the order of merging: a cell's
count is a sum, so partial counts combine before the shuffle, and a recomputed task gives the same cells. The sketches
of the sources of a language merge into the language's, and those into one of all rows.

A threshold is a fence: a quantile of the sketch, and beyond it FACTOR times its distance to another quantile (RULES says which), so that it
follows the level and the spread that the rate has in this language and source. Junk hardly moves it: rates that clean texts have too are measured
towards the side junk isn't on, and rates that are mostly 0 from their last hundredth. LEAST points and a sixteenth (two of the sketch's bins) only keep a group without any spread from rejecting what
differs by a rounding. So that small sources have steady fences, LANG_ROWS rows of the language's sketch and ALL_ROWS of that of all
rows are merged into every source's, whatever its size. A text is kept if it passes the base rules (at least
50 words, at most half of them in repeated 3-word windows) and no rate lies beyond its fence. Texts that fail the base
rules don't enter the sketches, so that junk can't widen the fences.

The sketches are stored; the join with their thresholds is left to the optimizer, which broadcasts them if their
measured size allows it and otherwise splits the rows of hot sources.

Rows: a null text has no words and fails; so does an empty one. A null language or source is a group of its own.
Repeated rows count each; very long texts are measured whole; an empty table gives an empty table. Other columns are passed on, whatever their names.
3-word windows are compared within a text by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import stored, workspace

#: Rows of a language's sketch, and of that of all rows, that are merged into the one of each of its sources.
LANG_ROWS, ALL_ROWS = 200, 50
#: rate -> (from this percentile on, the distance to this one, times this factor); fences of low values lie below
RULES = {
    "punctuation": (50, 10, 6),  # ASCII punctuation and symbols per character of words
    "dup_lines": (99, 50, 2),  # repeated lines per line
    "repeats": (99, 50, 2),  # words in repeated windows per word
    "long_words": (50, 10, 6),  # characters per word
    "short_words": (50, 90, 6),  # the same, for its low values
}
LOW = {"short_words"}
#: Points that a fence lies beyond its first percentile at least, and a sixteenth of that more.
LEAST = 5
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def features(text: Column) -> list[tuple[str, Column]]:
    """Columns to add one after the other; later ones use those before."""
    t = F.coalesce(text, F.lit(""))
    w, h = F.col("__w"), F.col("__h")
    hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    sorted_ = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    lines_ = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeats = F.element_at(F.transform(F.array(sorted_), lambda s: covered(s)), 1)
    return [
        ("__w", words(text)),
        ("__h", hashes),
        ("__l", lines_),
        ("n_lines", F.size("__l").cast("long")),
        ("n_words", F.size(w).cast("long")),
        ("word_chars", F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long")),
        ("n_symbols", (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long")),
        ("n_punctuation", (F.length(t) - F.length(F.translate(t, PUNCTUATION, ""))).cast("long")),
        ("n_dup_lines", F.element_at(F.transform(F.array(F.col("__l")), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1).cast("long")),
        ("n_repeat_words", F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeats).cast("long")),
    ]


def rate(name: str) -> Column:
    """A rate in thousandths, rounded down."""
    least = F.lit(1)
    top, bottom = {"punctuation": ("n_punctuation", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}.get(name, ("word_chars", "n_words"))
    return F.call_function("div", F.col(top) * 1000, F.greatest(F.col(bottom), least))


def cell(value: Column) -> Column:
    """The lower end of the histogram's bin that a value is in."""
    shift = (F.length(F.bin(value)) - 6).cast("int")
    return F.when(value < 64, value).otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` and the columns n_words, word_chars, n_symbols, n_punctuation, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    out = docs
    for name, column in features(F.col("__text")):
        out = out.withColumn(name, column)
    return out.drop("__w", "__h", "__l", "__text").withColumn("base_failed", base_failed())


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, rule, bin, n: a histogram of each rate for each language and source."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), cell(rate(name)).alias("bin")) for name in RULES)))
    return rows.filter(~F.col("base_failed")).select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.rule", "x.bin").agg(F.count("*").alias("n"))


def thresholds(cells: DataFrame) -> DataFrame:
    """lang, source, fences: rule -> fence, from a source's sketch with the rows merged into it."""
    rules = ", ".join(f"named_struct('rule', '{k}', 'low', {str(k in LOW).lower()}, 'a', {a}L, 'b', {b}L, 'factor', {f}L)" for k, (a, b, f) in RULES.items())
    return cells.sparkSession.sql(
        f"""
        WITH own AS (SELECT lang, source, rule, bin, 1000 * n AS n FROM {{cells}}),
        groups AS (SELECT DISTINCT lang, source, rule FROM own),
        by_lang AS (SELECT lang, rule, bin, sum(n) AS n FROM own GROUP BY lang, rule, bin),
        of_lang AS (SELECT lang, rule, bin, n * {LANG_ROWS * 1000} DIV sum(n) OVER (PARTITION BY lang, rule) AS n FROM by_lang),
        by_all AS (SELECT rule, bin, sum(n) AS n FROM by_lang GROUP BY rule, bin),
        of_all AS (SELECT rule, bin, n * {ALL_ROWS * 1000} DIV sum(n) OVER (PARTITION BY rule) AS n FROM by_all),
        merged AS (
          SELECT lang, source, rule, bin, sum(n) AS n FROM (
            SELECT * FROM own
            UNION ALL SELECT g.lang, g.source, g.rule, bin, n FROM groups g JOIN of_lang l ON g.lang <=> l.lang AND g.rule = l.rule
            UNION ALL SELECT g.lang, g.source, g.rule, bin, n FROM groups g JOIN of_all a ON g.rule = a.rule)
          GROUP BY lang, source, rule, bin),
        run AS (SELECT m.*, r.low, r.a, r.b, r.factor, sum(n) OVER (PARTITION BY lang, source, m.rule ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, m.rule) AS total
                FROM merged m JOIN (SELECT inline(array({rules}))) r ON m.rule = r.rule),
        q AS (SELECT lang, source, rule, any_value(low) AS low, any_value(factor) AS factor, min(CASE WHEN 100 * upto >= a * total THEN bin END) AS x,
                     min(CASE WHEN 100 * upto >= b * total THEN bin END) AS y FROM run GROUP BY lang, source, rule)
        SELECT lang, source, map_from_entries(collect_list(struct(rule, CASE WHEN low THEN x - greatest(factor * abs(x - y), {LEAST} + x DIV 16) ELSE x + greatest(factor * abs(x - y), {LEAST} + x DIV 16) END))) AS fences
        FROM q GROUP BY lang, source
        """,
        cells=cells,
    )


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` (measured, stored, with lang and source), and ``failed``, the rules that reject them, and ``kept``."""
    with workspace(rows.sparkSession):
        limits = thresholds(stored(sketches(rows), "sketches")).select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("fences").alias("__fences"))
        limits = stored(limits, "fences", keep=True)

    def beyond(name: str) -> Column:
        fence = F.element_at("__fences", F.lit(name))
        return F.when(rate(name) < fence if name in LOW else rate(name) > fence, F.lit(name))

    failed = F.array_compact(F.array(F.when(F.col("base_failed"), F.lit("base")), *map(beyond, RULES)))
    joined = rows.join(limits, rows["lang"].eqNullSafe(limits["__lang"]) & rows["source"].eqNullSafe(limits["__source"]), "left")
    return joined.withColumn("failed", failed).withColumn("kept", F.size("failed") == 0).drop("__lang", "__source", "__fences")


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the measures and the verdict of each document."""
    light = docs.select("doc_id", "lang", "source", F.col("text").alias("__text"))
    return judged(stored(measured(light), "measured"))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents kept, with their columns."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "lang", "source", F.col("text").alias("__text"))
    return judged(stored(measured(packed), "measured")).filter("kept").select("__row.*")


#: DuckDB SQL for the measures of a table ``{docs}``; ``rid`` tells rows apart.
MEASURED_SQL = r"""
d AS (SELECT row_number() OVER () AS rid, * FROM {docs}),
w AS (SELECT rid, list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
m0 AS (SELECT d.*, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
              (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::BIGINT AS n_symbols,
              (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '__PUNCTUATION__', '')))::BIGINT AS n_punctuation,
              len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
       FROM d JOIN w USING (rid) LEFT JOIN r USING (rid)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             n_punctuation * 1000 // greatest(word_chars, 1) AS punctuation, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines,
             n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, word_chars * 1000 // greatest(n_words, 1) AS long_words,
             word_chars * 1000 // greatest(n_words, 1) AS short_words FROM m0)
"""


def judged_sql(docs: str = "documents") -> str:
    """DuckDB SQL: CTEs up to ``judged``, the measured rows with ``kept``."""
    rules = ", ".join(f"('{k}', {str(k in LOW).lower()}, {a}, {b}, {f})" for k, (a, b, f) in RULES.items())
    measured_ = MEASURED_SQL.replace("{docs}", docs).replace("__PUNCTUATION__", PUNCTUATION.replace("'", "''"))
    return f"""{measured_},
rules(rule, low, a, b, factor) AS (VALUES {rules}),
rates AS (SELECT rid, lang, source, base_failed, unnest([{", ".join(f"{{'rule': '{k}', 'v': {k}}}" for k in RULES)}], recursive := true) FROM m),
cells AS (SELECT lang, source, rule, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bin, count(*) AS n
          FROM rates WHERE NOT base_failed GROUP BY ALL),
of_lang AS (SELECT lang, rule, bin, n * {LANG_ROWS * 1000} // sum(n) OVER (PARTITION BY lang, rule) AS n FROM (SELECT lang, rule, bin, sum(n) * 1000 AS n FROM cells GROUP BY ALL)),
of_all AS (SELECT rule, bin, n * {ALL_ROWS * 1000} // sum(n) OVER (PARTITION BY rule) AS n FROM (SELECT rule, bin, sum(n) * 1000 AS n FROM cells GROUP BY ALL)),
groups AS (SELECT DISTINCT lang, source, rule FROM cells),
merged AS (SELECT lang, source, rule, bin, sum(n) AS n FROM (
    SELECT lang, source, rule, bin, n * 1000 AS n FROM cells
    UNION ALL SELECT g.lang, g.source, g.rule, bin, n FROM groups g JOIN of_lang l ON g.lang IS NOT DISTINCT FROM l.lang AND g.rule = l.rule
    UNION ALL SELECT g.lang, g.source, g.rule, bin, n FROM groups g JOIN of_all o ON g.rule = o.rule) GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, rule) AS total FROM merged JOIN rules USING (rule)),
q AS (SELECT lang, source, rule, low, factor, min(CASE WHEN 100 * upto >= a * total THEN bin END) AS x, min(CASE WHEN 100 * upto >= b * total THEN bin END) AS y FROM run GROUP BY ALL),
fence AS (SELECT lang, source, rule, low, CASE WHEN low THEN x - greatest(factor * abs(x - y), {LEAST} + x // 16) ELSE x + greatest(factor * abs(x - y), {LEAST} + x // 16) END AS fence FROM q),
bad AS (SELECT DISTINCT rid FROM rates r JOIN fence f ON r.rule = f.rule AND r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
        WHERE CASE WHEN low THEN v < fence ELSE v > fence END),
judged AS (SELECT m.*, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM m)
"""
