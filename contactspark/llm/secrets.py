"""Secret scans: regular expressions behind a trigram inverted index, in built-in functions only.

From each rule's pattern a Boolean query over trigrams is derived: any match holds, for one of some
alternatives, all trigrams of that alternative's fixed strings. The index has a posting (trigram,
document) for each trigram that a query asks for and that a text holds, both in lower case; grouping
postings by document intersects them, and the documents of a rule are those where an alternative has
all its trigrams. Only these are searched with the rule's pattern; rules without a mandatory trigram search
all texts.
"""

from __future__ import annotations

import itertools
import re._constants as op
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import between, blocks, let

#: The most alternatives that a query may have, and characters that a class is spelled out for.
MOST_ALTERNATIVES = 64
MOST_SPELLED = 8
SPANS = "array<struct<start:bigint,place:int,end:bigint,kind:string>>"
#: Matches of one text whose places are worked out together.
TOGETHER = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if `group` of it has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the base rules, in the order of their kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("repository_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/-]+=*)", 1, 20),
)
BASE_KINDS = ("assign", "access", "hex")


def fixed_strings(pattern: str) -> list[list[str]]:
    """Alternatives of a pattern, each the list of the fixed strings that a match holds, in lower case."""
    Alternative = list[str]  # the last string is still growing

    def add(alternatives: list[Alternative], options: list[Alternative]) -> list[Alternative]:
        """Each alternative followed by each option; as soon as that is too many, by an unknown string."""
        if len(alternatives) * len(options) > MOST_ALTERNATIVES:
            return add(alternatives, [["", ""]])
        return [[*a[:-1], a[-1] + o[0], *o[1:]] for a, o in itertools.product(alternatives, options)]

    def spelled(items: list) -> list[Alternative]:
        chars = set()
        for kind, value in items:
            if kind is op.LITERAL:
                chars.add(chr(value).lower())
            elif kind is op.RANGE and value[1] - value[0] < MOST_SPELLED:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return [["", ""]]
        return [[c] for c in sorted(chars)] if len(chars) <= MOST_SPELLED else [["", ""]]

    def walk(items) -> list[Alternative]:
        out = [[""]]
        for kind, value in items:
            if kind is op.LITERAL:
                out = add(out, [[chr(value).lower()]])
            elif kind is op.IN:
                out = add(out, spelled(value))
            elif kind is op.SUBPATTERN:
                out = add(out, walk(value[-1]))
            elif kind is op.BRANCH:
                out = add(out, [x for branch in value[1] for x in walk(branch)])
            elif kind is op.MAX_REPEAT and value[1] == 1:
                inner = walk(value[2])
                out = add(out, inner if value[0] else [[""], *inner])
            elif kind is op.MAX_REPEAT and value[0] > 0:
                out = add(out, [[*x, ""] for x in walk(value[2])])
                out = add(out, [["", ""]])
            else:
                out = add(out, [["", ""]])
        return out

    return walk(parser.parse(pattern))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams of which a match's text holds one whole set; none where some alternative has no trigram."""
    sets = {frozenset(s[i : i + 3] for s in a for i in range(len(s) - 2)) for a in fixed_strings(pattern)}
    if frozenset() in sets:
        return []
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def postings(df: DataFrame, trigrams: list[str], key: str, text: str) -> DataFrame:
    """The inverted index: (trigram, key) for each of the trigrams in each text."""
    held = let(F.lower(F.coalesce(F.col(text), F.lit(""))), lambda x: F.array_compact(F.array(*(F.when(F.contains(x, F.lit(t)), F.lit(t)) for t in trigrams))))
    return df.select(F.col(key).alias("doc"), F.explode(held).alias("trigram"))


def candidates(df: DataFrame, rules: tuple[Rule, ...], key: str, text: str) -> DataFrame:
    """(doc, kinds): the kinds of rules whose trigram query a document fulfils."""
    queries = [(r.kind, n, s) for r in rules for n, s in enumerate(trigram_query(r.pattern))]
    trigrams = sorted({t for _, _, s in queries for t in s})
    asked = F.create_map(*(x for t in trigrams for x in (F.lit(t), F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n"), F.lit(len(s)).alias("size")) for k, n, s in queries if t in s)))))
    found = postings(df, trigrams, key, text).select("doc", F.explode(F.element_at(asked, F.col("trigram"))).alias("q"), "trigram")
    whole = found.groupBy("doc", "q.kind", "q.n", "q.size").agg(F.count_distinct("trigram").alias("held")).where("held = size")
    return whole.groupBy("doc").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """Array of (start, place, end, kind) of a rule's leftmost non-overlapping matches that count, in code points."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    each = F.arrays_zip(F.split(text, rule.pattern, -1).alias("before"), matches.alias("match"), judged.alias("judged"))
    nothing = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.length(x["judged"]) >= rule.least, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def steps(items: Column) -> Column:
        """All steps, some at a time, as each one copies the spans that it appends to."""

        def some(acc: Column, g: Column) -> Column:
            part = F.aggregate(F.slice(items, g + 1, TOGETHER), F.struct(acc["at"].alias("at"), nothing.alias("spans")), step)
            return let(part, lambda p: F.struct(p["at"].alias("at"), F.array_append(acc["lists"], p["spans"]).alias("lists")))

        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPANS}>").alias("lists"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.size(items) - 1, F.lit(TOGETHER)), zero, some)["lists"])

    found = let(each, steps)
    quick = rule.pattern
    if not rule.group and quick.endswith("]+"):  # what counts has so many characters at least in its last run, whatever the width of the rest
        widest = parser.parse(quick[: quick.rindex("[")]).getwidth()[1]
        quick = f"{quick[:-1]}{{{max(1, rule.least - widest)},}}"
    return F.when(F.rlike(text, F.lit(quick)), found).otherwise(nothing)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with secret_spans: an array of (start, place, end, kind), by start and then by the rule's place.

    Null and empty texts have no spans. Rows of equal keys are looked at each by its own text, null keys
    as well; spans of different rules may overlap. A column of the new name is replaced.
    """
    indexed = [r for r in rules if trigram_query(r.pattern)]
    rows = df.drop("secret_spans")
    if indexed:
        kinds = candidates(df, tuple(indexed), key, text).toDF("\1doc", "\1kinds")
        rows = rows.join(kinds.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("\1doc")), "left")
    else:
        rows = rows.withColumns({"\1doc": F.lit(None), "\1kinds": F.lit(None).cast("array<string>")})

    def of(x: Column) -> Column:
        nothing = F.array().cast(SPANS)
        lists = []
        for place, r in enumerate(rules):
            wanted = F.coalesce(F.array_contains("\1kinds", r.kind), F.lit(False)) if r in indexed else F.lit(True)
            lists.append(F.when(wanted, spans_of(x, r, place)).otherwise(nothing))
        return F.sort_array(F.concat(*lists))

    return rows.withColumn("secret_spans", of(F.coalesce(F.col(text), F.lit("")))).drop("\1doc", "\1kinds")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def shown(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Spans that are folded together; an array that grows by one at a time costs the square of its length.
CHUNK = 512


def redacted(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced. The work follows the text and the number of spans, however many there are."""

    def gaps(chunk: Column) -> Column:
        """Where a gap between runs ends in these spans: its start and end."""
        done = F.slice(spans, 1, chunk * CHUNK)
        reached = F.coalesce(F.array_max(F.transform(done, lambda s: s["end"])), F.lit(0)).cast("long")

        def step(acc: Column, s: Column) -> Column:
            gap = F.array(F.struct(acc["at"].alias("start"), s["start"].cast("long").alias("end")))
            found = F.when(s["start"] >= acc["at"], F.concat(acc["gaps"], gap)).otherwise(acc["gaps"])
            return F.struct(F.greatest(acc["at"], s["end"].cast("long")).alias("at"), found.alias("gaps"))

        start = F.struct(reached.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("gaps"))
        return F.aggregate(F.slice(spans, chunk * CHUNK + 1, F.lit(CHUNK)), start, step, lambda acc: acc["gaps"])

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int")), gaps))
    rest = F.struct(F.array_max(F.transform(spans, lambda s: s["end"].cast("long"))).alias("start"), F.length(text).cast("long").alias("end"))
    out = let(blocks(text), lambda parts: F.array_join(F.transform(F.concat(found, F.array(rest)), lambda g: between(parts, g["start"], g["end"])), by))
    return F.when(F.size(spans) > 0, out).otherwise(text)


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same for DuckDB, each rule on all texts."""
    parts = []
    for place, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            rf"""select doc_id, {place} as place, '{r.kind}' as kind, start, start + length(m[i]) as stop from (
        select doc_id, m, g, i, list_sum(list_transform(b[:i], lambda x: length(x))) + list_sum(list_concat([0], list_transform(m[:i - 1], lambda x: length(x)))) as start
        from (select *, unnest(range(1, len(m) + 1)) as i from (
          select doc_id, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {r.group}) as g, regexp_split_to_array(t, '{pattern}') as b from d)))
      where length(g[i]) >= {r.least}"""
        )
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    counts = ", ".join(f"count(*) filter (where kind = '{k}')::bigint as n_{k}" for k in BASE_KINDS)
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
s as ({" union all ".join(parts)})
select d.doc_id, {counts},
       sha256(coalesce(string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, place) filter (where kind in ({base})), '')) as base_sha256,
       coalesce(string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, place), '') as spans
from d left join s on s.doc_id = d.doc_id group by d.doc_id
"""
