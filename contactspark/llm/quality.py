"""Quality rules: a table of thresholds over measures of whole texts, compiled into Spark expressions.

All measures are built-in functions over arrays of words and lines; no user functions run. A
measure that is needed more than once is bound once (`let`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, let, words

#: Frequent function words by language.
STOP_WORDS = {
    "en": "the of and to in a is that it for was with on as be by this at are from",
    "fr": "de et le la les des en du un une que est pour dans au qui par sur pas avec",
    "es": "de la el los y en que a del se por las un con no una su es para lo al",
    "de": "der und die zu den von das mit sich des für auf ist im dem ein nicht eine als in",
}
#: What may stand around a word and does not belong to it when it is looked up among the stop words.
PUNCTUATION = ".,;:!?\"'()[]"


@dataclass(frozen=True)
class Rule:
    """Keeps texts whose ratio `part / whole` lies between two bounds (inclusive); an empty whole passes."""

    name: str
    part: str
    whole: str
    least: float
    most: float


#: Lengths are judged on the mean word, so that long texts are not suspect as such.
RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbol_ratio", "n_symbols", "n_words", 0.0, 0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, 1.0),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", 0.0, 0.6),
)
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def repeated_words(w: Column) -> Column:
    """Words of the array that lie in a window of three words found twice or more in it.

    Windows are compared by a 64-bit hash. Sorting (hash, position) pairs brings equal windows
    together, and the union of the windows' positions is a sum over gaps, so the work is n log n.
    """

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        steps = F.sequence(F.lit(0), n - 1)
        return F.when(n > 0, F.aggregate(steps, F.lit(0), lambda acc, j: acc + F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - F.get(starts, j), F.lit(3))))).otherwise(0)

    def found(pairs: Column) -> Column:
        def again(j: Column) -> Column:
            h = F.get(pairs, j)["h"]
            return F.coalesce(h == F.get(pairs, j - 1)["h"], F.lit(False)) | F.coalesce(h == F.get(pairs, j + 1)["h"], F.lit(False))

        at = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), again)
        return let(F.sort_array(F.transform(at, lambda j: F.get(pairs, j)["i"])), covered)

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, found))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, of))


def measures(text: Column, lang: Column, stop_words: dict[str, str]) -> Column:
    """A struct of all counts of one text. Stop words are those of all languages, whatever the case; null where the language has no list."""
    stops = sorted({w for words_ in stop_words.values() for w in words_.split()})
    listed = lang.isNull() | lang.isin(*stop_words)
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(listed, F.size(F.filter(w, lambda x: F.lower(F.btrim(x, F.lit(PUNCTUATION))).isin(*stops)))).cast("long").alias("n_stop_words"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    symbols = F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))
    return F.struct(let(words(t), of_words).alias("w"), let(lines, of_lines).alias("l"), symbols.cast("long").alias("n_symbols"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one Boolean expression over the columns of counts."""
    out = F.lit(True)
    for r in rules:
        ratio = F.col(r.part) / F.nullif(F.col(r.whole), F.lit(0))
        out &= F.coalesce(ratio.between(r.least, r.most), F.lit(True))
    return out


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, lang: str | None = None, stop_words: dict[str, str] = STOP_WORDS) -> DataFrame:
    """df with the counts n_words, word_chars, n_stop_words, n_repeat_words, n_lines, n_dup_lines and
    n_symbols and the Booleans base_failed and kept.

    Null and empty texts have no words, so they fail the base rule and are not kept. Rows do not
    affect one another: repeated rows get the same verdict. Columns of the new names are replaced. lang names a column of
    languages: texts of a language without a list of stop words have a null n_stop_words and pass its rule; a null language
    is taken for one that has a list, as are all texts without such a column.
    """
    m = measures(F.col(text), F.col(lang) if lang else F.lit(None).cast("string"), stop_words)
    new = ("n_words", "word_chars", "n_stop_words", "n_repeat_words", "n_lines", "n_dup_lines", "n_symbols", "base_failed", "kept")
    rest = [F.col(f"row.`{c}`") for c in df.columns if c not in new]
    counted = df.select(F.struct(*df.columns).alias("row"), m.alias("m")).select(*rest, "m.w.*", "m.l.*", "m.n_symbols")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same for DuckDB."""
    checks = " and ".join(f"coalesce({r.part} / nullif({r.whole}, 0) between {r.least} and {r.most}, true)" for r in rules)
    stops = ", ".join(f"'{w}'" for w in sorted({w for words_ in STOP_WORDS.values() for w in words_.split()}))
    listed = ", ".join(f"'{x}'" for x in STOP_WORDS)
    around = PUNCTUATION.replace("'", "''")
    return rf"""
with t as (select doc_id, lang, coalesce(text, '') as t from documents),
w as (select doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
g as (select doc_id, unnest(ws) as a, unnest(ws[2:]) as b, unnest(ws[3:]) as c, unnest(range(1, len(ws) + 1)) as i from w where len(ws) > 2),
k as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as k from g where c is not null),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from k where k > 1) group by doc_id),
m as (select w.doc_id, len(ws)::bigint as n_words, length(list_aggregate(list_concat([''], ws), 'string_agg', ''))::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(ls) as n_lines,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
        case when lang is null or lang in ({listed}) then len(list_filter(ws, lambda x: lower(trim(x, '{around}')) in ({stops}))) end as n_stop_words
      from w left join r on r.doc_id = w.doc_id),
b as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {checks} as kept from b
"""
