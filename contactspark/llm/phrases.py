"""Collocations: phrases whose words stand together more often than their parts explain.

Each word of a piece of text opens one window: itself and the words that follow, up to the longest phrase's length, padded at
the end. Only these windows are counted. Their lead columns are rolled up, so that every shorter phrase is the sum of the windows that
begin with it, and the empty one the number of words: each occurrence of a phrase begins at one word.

Most windows begin with a phrase that is too rare to matter. Passes before this one count words and pairs of neighbours by hash in a
table of fixed size, then longer phrases, but only those without a rare pair. Where a cell's count is below the least, its phrases are rarer still, so is
whatever holds them, and a window ends (is padded) before it would hold one; a rare word opens an empty window, which only counts as a word. Cells that phrases
share let through more than need be, never less, so all counts that matter are exact. The bits of the cells are broadcast: 40 MB whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import bounded
from .bpe import few
from .cells import added_up
from .common import in_order, stored
from .tokens import coded, cut_words

LONGEST = 5
LEAST = 100
TOP = 2000
#: Percent of a phrase's occurrences from which on a longer one stands for it.
SHARE = 100
UNKNOWN = "und"
BLANK, STOP = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Cells of the tables of hashed words and pairs, and of longer phrases.
CELL_BITS, LONG_BITS = 28, 26
#: Windows that a task holds before equal ones are added up, and goes on with if that leaves half of them or fewer.
HELD = 600_000
#: Buckets of windows.
BUCKET_BITS = 10
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Pieces:
    """The words of a batch: their numbers, the words by number, the language of each, and whether each goes on the piece of the one before."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        words, owner, self.goes_on = cut_words(texts, BLANK, STOP, lower=True)
        self.code, self.words = coded(words)
        known = pc.fill_null(langs, UNKNOWN).dictionary_encode()
        self.langs = known.dictionary
        self.lang = known.indices.to_numpy(zero_copy_only=False).astype("i8")[owner]

    def hashes(self) -> np.ndarray:
        """A hash of each word in its language."""
        digest = xxhash.xxh64_intdigest
        of_word = np.fromiter(map(digest, self.words.to_pylist()), "u8", len(self.words))
        of_lang = np.fromiter(map(digest, self.langs.to_pylist()), "u8", len(self.langs))
        return of_word[self.code] ^ (of_lang[self.lang] * MIX)

    def phrases(self, longest: int, tables: list[np.ndarray | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each size of phrase from 1 on: where they start, their hashes, and at which words one starts that may be frequent.

        tables: the bits of words, pairs, and so on, by which a phrase is judged; None lets all through. Phrases are those whose parts may be frequent.
        """
        h = self.hashes()
        g, at, may = h, np.arange(len(h)), np.ones(len(h), bool)
        for k, table in zip(range(1, longest + 1), tables, strict=True):
            if k > 1:
                at = np.flatnonzero(may[:-1] & may[1:] & (self.goes_on[1:] | (k > 2)))
                g[at] = (g[at] * MIX ^ (g[at] >> np.uint64(31))) + h[at + k - 1]
            else:
                g = h.copy()
            may = np.zeros(len(h), bool)
            may[at] = True if table is None else is_open(table, g[at])
            yield at, g[at], may


def cell_of(g: np.ndarray, bits: int) -> np.ndarray:
    return ((g ^ (g >> np.uint64(32))) * TURN >> np.uint64(64 - bits)).astype("u4")


def is_open(table: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether the bits of the hashes' cells are set."""
    cell = cell_of(g, (8 * len(table)).bit_length() - 1)
    return (table[cell >> np.uint32(3)] >> (cell & np.uint32(7)).astype("u1") & 1).astype(bool)


def open_cells(df: DataFrame, least: int, longest: int, known: list[np.ndarray], bits: int) -> np.ndarray:
    """One bit a cell, in bytes: whether phrases of up to `longest` words that the known tables (of the shorter ones) let through occur `least` times or more
    together in that cell. df has text and lang."""
    shared = df.sparkSession.sparkContext.broadcast(known)

    def cells(b: pa.RecordBatch) -> list[np.ndarray]:
        tables = shared.value
        found = Pieces(b["text"], b["lang"]).phrases(longest, [*tables, *[None] * (longest - len(tables))])
        return [cell_of(g, bits) for k, (_, g, _) in enumerate(found) if k >= len(tables)]

    return added_up(df, "text", cells, bits, lambda total: np.packbits(total >= least, bitorder="little"), least)


def tables_of(df: DataFrame, least: int, longest: int) -> list[np.ndarray]:
    """The tables of words, pairs and longer phrases, by size."""
    short = open_cells(df, least, min(2, longest), [], CELL_BITS)
    if longest < 3:
        return [short] * longest
    return [short, short, *[open_cells(df, least, longest, [short, short], LONG_BITS)] * (longest - 2)]


def windows(df: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """lang, w1, w2, ... (as many as tables) and n: the distinct padded windows, and how often each occurs. df has text and lang.

    Tasks add up what they have met and send it by bucket of the windows' hashes, many windows a row; buckets are added up one after the other.
    """
    longest = len(tables)
    names = [f"w{k + 1}" for k in range(longest)]
    columns = ["lang", *names]
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def met(b: pa.RecordBatch) -> pa.Table | None:
        """The windows of a slice of a batch, with their buckets."""
        pieces = Pieces(b["text"], b["lang"])
        total = len(pieces.code)
        if not total:
            return None
        found = list(pieces.phrases(longest, shared.value))
        pad = len(pieces.words)
        head = np.where(found[0][2], pieces.code, pad)
        key, rows = pieces.lang * (pad + 1) + head, np.arange(total)
        parts = []  # windows are told apart column by column; those that have ended take no part in the next
        for k in range(1, longest + 1):
            distinct, first, which, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            go = found[k][2][rows] if k < longest else np.zeros(len(rows), bool)
            ended = n - np.bincount(which[go], minlength=len(distinct))
            some = np.flatnonzero(ended)
            at = rows[first[some]]
            starts, g, _ = found[k - 1]
            bucket = (g[np.searchsorted(starts, at)] * TURN >> np.uint64(64 - BUCKET_BITS)).astype("i4")
            bucket[head[at] == pad] = 0  # windows of rare words are all alike
            parts.append((bucket, pieces.lang[at], [head[at], *(pieces.code[at + j] for j in range(1, k)), *[np.full(len(at), pad)] * (longest - k)], ended[some]))
            rows = rows[go]
            if not len(rows):
                break
            key = which[go] * pad + pieces.code[rows + k]
        strings = pa.concat_arrays([pieces.words.cast(pa.string()), pa.array([""], pa.string())])
        lang = pieces.langs.take(pa.array(np.concatenate([x[1] for x in parts]))).cast(pa.string())
        cells = [strings.take(pa.array(np.concatenate([x[2][j] for x in parts]))) for j in range(longest)]
        return pa.table([pa.array(np.concatenate([x[0] for x in parts])), lang, *cells, pa.array(np.concatenate([x[3] for x in parts]))], names=["bucket", *columns, "n"])

    def added(held: list[pa.Table]) -> pa.Table:
        """Equal windows as one."""
        return pa.concat_tables(held).group_by(["bucket", *columns], use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["bucket", *columns, "n"])

    def sent(t: pa.Table) -> pa.RecordBatch:
        """A row for each bucket."""
        t = t.sort_by("bucket").combine_chunks()
        bucket = t["bucket"].to_numpy()
        edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)].astype("i4")
        items = pa.StructArray.from_arrays([t[c].chunk(0) for c in (*columns, "n")], names=[*columns, "n"])
        return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.ListArray.from_arrays(pa.array(edges), items)], names=["bucket", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for whole in batches:
            for b in few(whole, "text"):
                if (t := met(b)) is not None:
                    held.append(t)
                if sum(x.num_rows for x in held) > HELD:
                    held = [added(held)]
                    if held[0].num_rows > HELD // 2:
                        yield sent(held.pop())
        if held:
            yield sent(added(held))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # of one bucket, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            bucket, size = b["bucket"].to_numpy(), pc.list_value_length(b["items"]).to_numpy()
            items = pa.Table.from_struct_array(b["items"].flatten())
            t = items.add_column(0, "bucket", pa.array(np.repeat(bucket, size)))
            held = [added([*held, t])]
            last = pc.equal(held[0]["bucket"], int(bucket[-1]))
            yield from held[0].filter(pc.invert(last)).drop(["bucket"]).to_batches()
            held = [held[0].filter(last)]
        if held:
            yield from held[0].drop(["bucket"]).to_batches()

    item = ", ".join(f"{c}:string" for c in columns) + ", n:bigint"
    parts = df.mapInArrow(run, f"bucket int, items array<struct<{item}>>").repartition("bucket").sortWithinPartitions("bucket")
    return parts.mapInArrow(add_up, ", ".join(f"{c} string" for c in columns) + ", n long")


def phrase_counts(df: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, size, phrase, words and f of all phrases of 1 to `longest` words that occur `least` times or more in texts of a language, and the number of
    all its words as the phrase of size 0. df has text and lang; stored."""
    names = [f"w{k + 1}" for k in range(longest)]
    met = windows(df, tables_of(df, least, longest))
    columns = ", ".join(names)
    rolled = df.sparkSession.sql(f"select lang, {columns}, sum(n) as f, {longest} - bit_count(grouping_id()) as size from {{met}} group by lang, rollup({columns})", met=met)
    last = F.element_at(F.array(F.lit("-"), *names), (F.col("size") + 1).cast("int"))  # padding ends a phrase before this
    whole = rolled.where((last != "") & ((F.col("f") >= least) | (F.col("size") == 0)))
    words = F.slice(F.array(*names), F.lit(1), F.col("size").cast("int"))
    return stored(whole.select("lang", F.col("size").cast("int").alias("size"), F.array_join(words, " ").alias("phrase"), words.alias("words"), "f"), "phrases")


def part(first: Column, size: Column) -> Column:
    """Some of a phrase's words as a phrase."""
    return F.array_join(F.slice("words", first, size), " ")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases of 2 to `longest` words.

    Texts are lower-cased (A to Z), and cut into pieces at punctuation and line ends, which no phrase crosses. a: how often the phrase
    occurs, `least` times or more; l and r: how often the parts occur of the cut that scores lowest (ties: the earliest); n: all words of the
    language; score: 1000 a n / (l r), rounded down. A phrase that lies within a longer one with `share` percent of its occurrences is left
    out. Ties go by a, then by the phrase. Sums of over 64 bits are decimals. A null language is `und`; null and empty texts have no words;
    repeated rows count each time; other columns are not read; an empty table gives no rows.
    """
    docs = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = phrase_counts(docs, least, longest)
    f = known.where("size > 0").select(F.col("lang").alias("of"), F.col("phrase").alias("some"), F.col("f").alias("n_some"))
    long = known.where("size > 1")
    cuts = long.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumn("left", part(F.lit(1), F.col("k"))).withColumn("right", part(F.col("k") + 1, F.size("words") - F.col("k"))).drop("words")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(f.withColumnRenamed("n_some", name), (F.col("lang") == F.col("of")) & (F.col(side) == F.col("some"))).drop("of", "some")
    total = known.where("size = 0").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    cuts = cuts.join(bounded(total), F.col("lang") == F.col("of")).drop("of")
    score = F.expr("(cast(1000 * a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    # a phrase is within a longer one just as often as within one that is longer by a word, or oftener
    inner = long.where("size > 2").select("lang", F.col("f").alias("longer"), F.explode(F.array(part(F.lit(1), F.size("words") - 1), part(F.lit(2), F.size("words") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {share} * a")
    placed = in_order(left, [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")], {"at": None})
    first = bounded(placed.groupBy(F.col("lang").alias("of")).agg(F.min("at").alias("first")))
    ranked = placed.join(first, F.col("lang") == F.col("of")).withColumn("rank", F.col("at") - F.col("first") + 1)
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE) -> str:
    """The same for DuckDB."""
    sizes = ", ".join(map(str, range(1, longest + 1)))
    return rf"""
with d as (select coalesce(lang, '{UNKNOWN}') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: w[i:i + size - 1])) as words from w, unnest([{sizes}]) as s(size)),
f as (select lang, size, words, count(*) as f from g group by all having count(*) >= {least}),
n as (select lang, sum(len(w)) as n from w group by lang),
c as (select lang, words, size, f as a, unnest(range(1, size)) as k from f where size > 1),
s as (select c.lang, c.words, c.a, c.k, x.f as l, y.f as r, n.n, (1000 * c.a::hugeint * n.n::hugeint) // (x.f::hugeint * y.f::hugeint) as score
      from c join f x on x.lang = c.lang and x.words = c.words[:k] join f y on y.lang = c.lang and y.words = c.words[k + 1:] join n on n.lang = c.lang),
b as (select lang, words, arg_min({{a: a, l: l, r: r, score: score, n: n}}, (score, k)) as m from s group by lang, words),
i as (select lang, words, max(f) as f from (select lang, f, unnest([words[:size - 1], words[2:]]) as words from f where size > 2) group by lang, words),
k as (select b.lang, array_to_string(b.words, ' ') as phrase, m.a, m.l, m.r, m.n, m.score from b left join i on i.lang = b.lang and i.words = b.words where i.f is null or 100 * i.f < {share} * m.a),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from k)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from r where rank <= {top}
"""
