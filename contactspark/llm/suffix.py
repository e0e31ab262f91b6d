"""Removal of long repeats by bucket-pointer refinement, as for a suffix array, over the whole corpus.

Two positions start the same string of `span` bytes if they stay in one bucket as buckets are refined
from a few bytes to `span`. Not every position is dealt out: each string of `span` bytes has an anchor, its
32-byte substring with the least hash, which depends on nothing but the string. Neighbouring starts share
their anchor, about one for every 35 bytes. So:

1.  Initial buckets: anchors by the hash of their 32 bytes. Within a bucket, anchors whose whole context (all
    strings that they stand for) is equal form a class; all of a class but the first are repeats. Copies
    that one task meets twice are settled there, so a class sends a row per task to its bucket.
    A bucket of which one task alone meets many classes is dealt out by class instead, so that a line which stands
    amid different text all over the corpus does not send all its places to one task.
2.  Refinement: only where a bucket has several classes, the contexts of each class's first are compared.
    Starts get bucket identifiers of 8 bytes' depth, and buckets are then refined by sorting on
    pairs of the identifiers at a start and at a later offset, so that each round reuses the identifiers of the
    one before: 8, 16, 32, 64, `span`. Starts that share a bucket with an earlier one are repeats.
    A bucket of very many classes is dealt out further, string by string, so no group is held whole.
3.  The repeats of each document are merged and cut out.

Buckets and classes go by two independent 64-bit hashes, that is 128 bits for one decision; contexts and strings are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import few
from .common import giving_back, numbered, stored

SPAN = 100
ANCHOR = 32
#: Bits of a hash that count when the least is looked for; the rest of a word numbers places.
PLACE_BITS = 24
#: Bytes of a text that are looked at together; longer ones are walked in overlapping pieces.
PIECE = 1_000_000
#: Classes of a bucket in one gathering of anchors from which on the bucket is dealt out by class.
WIDESPREAD = 16
#: Classes of one bucket from which on its strings are dealt out one by one.
CROWDED = 4096
#: Tasks that the anchors of one crowded bucket are dealt to when they are marked.
SALTS = 64
#: Anchors that a map task gathers before it settles and sends them; bytes of context compared at once; strings a task remembers.
GATHER, COMPARE, REMEMBERED = 400_000, 1_500_000, 300_000

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], "u8")
REPEAT, COMPARED = 0, 1
#: Kinds of anchors: one by bucket, a repeat for sure, one dealt out by class, and the mark of a bucket that has such.
PLAIN, KNOWN, SPREAD, MARK = range(4)
LEAST, LAST = -(1 << 63), (1 << 63) - 1


def find_anchors(texts: list[bytes], span: int = SPAN) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of `span` bytes: hash, hash of the context, text number, first and last start.

    The context of an anchor runs from its first start to `span` bytes after its last; starts count from the text's own
    start. The texts hold 2 ** PLACE_BITS bytes at most.
    """
    none = (np.zeros(0, "i8"),) * 5
    sizes = np.array([len(t) for t in texts], "i8")
    joined, ends = b"".join(texts), np.cumsum(sizes)
    if len(joined) < span:
        return none
    h = (np.frombuffer(joined, "u1").astype("u8") + np.uint64(1)) * MULTIPLIERS[0]
    for k, m in enumerate(MULTIPLIERS):  # strings of 2, 4, ... 32 bytes
        h = h ^ (h >> np.uint64(31))
        h = h[: -(1 << k)] * m + h[1 << k :]
    h ^= h >> np.uint64(29)
    h *= MULTIPLIERS[4]
    h ^= h >> np.uint64(32)
    bits = np.uint64(PLACE_BITS)
    least = (h >> bits << bits) | np.arange(len(h), dtype="u8")  # of equal hashes the leftmost
    width, n = span - ANCHOR + 1, 1
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    least = np.minimum(least[: len(least) - (width - n)], least[width - n :])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype("i8")
    start, text = np.arange(len(at)), np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    inside = start + span <= ends[text]
    start, at, text = start[inside], at[inside], text[inside]
    if not len(start):
        return none
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    lo, hi, a, d = start[new], start[np.r_[new[1:] - 1, len(start) - 1]], at[new], text[new]
    digest = xxhash.xxh3_64_intdigest
    c = np.array([digest(joined[s:e], o) for s, e, o in zip(lo.tolist(), (hi + span).tolist(), (a - lo).tolist(), strict=True)], "u8")
    begin = (ends - sizes)[d]
    return h[a].view("i8"), c.view("i8"), d, lo - begin, hi - begin


def pieces(texts: list[bytes], span: int = SPAN) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in groups of about PIECE bytes: their numbers, the offset of each piece, and the pieces. Pieces of a long text overlap by span - 1 bytes."""
    numbers, offsets, group, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - span + 1), PIECE):
            piece = t[at : at + PIECE + span - 1] if len(t) > PIECE else t
            if group and size + len(piece) > PIECE:
                yield numbers, offsets, group
                numbers, offsets, group, size = [], [], [], 0
            numbers.append(i)
            offsets.append(at)
            group.append(piece)
            size += len(piece)
    if group:
        yield numbers, offsets, group


def joined_runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts, those next to each other in one document put together."""
    by = np.lexsort((lo, doc))
    doc, lo, hi = doc[by], lo[by], hi[by]
    edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] != hi[:-1] + 1)][: len(doc)])
    return doc[edge], lo[edge], hi[np.r_[edge[1:] - 1, len(doc) - 1]] if len(edge) else hi


def anchor_rows(docs: DataFrame, text: str, span: int) -> DataFrame:
    """(h, c, doc, lo, hi, kind) of all anchors, each where its kind is to be settled."""

    def settled(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, c, doc, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((lo, doc, c, h))
        h, c, doc, lo, hi = (x[by] for x in (h, c, doc, lo, hi))
        bucket = np.r_[True, h[1:] != h[:-1]]
        new = bucket | np.r_[True, c[1:] != c[:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        known = (doc > doc[first]) | (lo > lo[first])
        runs = joined_runs(doc[known], lo[known], hi[known])
        classes = np.bincount(np.cumsum(bucket) - 1, new)
        wide = np.repeat(classes >= WIDESPREAD, np.diff(np.r_[np.flatnonzero(bucket), len(h)]))
        marked = h[bucket][classes >= WIDESPREAD]
        kind = np.where(wide, SPREAD, PLAIN)[~known]
        nothing, zero = np.full(len(marked), 0), np.zeros(len(runs[0]), "i8")
        columns = (
            (h[~known], zero, marked), (c[~known], zero, np.full(len(marked), LEAST)), (doc[~known], runs[0], nothing), (lo[~known], runs[1], nothing), (hi[~known], runs[2], nothing),
            (kind, np.full(len(zero), KNOWN), np.full(len(marked), MARK)),
        )
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in columns[:5]] + [pa.array(np.concatenate(columns[5]), pa.int32())], names=["h", "c", "doc", "lo", "hi", "kind"])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for whole in batches:
            for b in few(whole, text, 700_000):
                keys = b["doc"].to_numpy()
                for numbers, offsets, group in pieces([(t or "").encode() for t in b[text].to_pylist()], span):
                    h, c, d, lo, hi = find_anchors(group, span)
                    if len(h):
                        shift = np.array(offsets)[d]
                        parts.append((h, c, keys[np.array(numbers)[d]], lo + shift, hi + shift))
                        held += len(h)
                    if held > GATHER:
                        yield settled(parts)
                        parts, held = [], 0
        if parts:
            yield settled(parts)

    found = docs.select("doc", text).mapInArrow(run, "h long, c long, doc long, lo long, hi long, kind int")
    to = F.when(F.col("kind") == KNOWN, F.xxhash64("doc", "lo")).when(F.col("kind") == SPREAD, F.xxhash64("h", "c")).otherwise(F.col("h"))
    return found.repartition(to).sortWithinPartitions("h", "c", "doc", "lo")


def settle_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors by h, c, doc, lo to repeats and, from buckets of several classes, each class's first.

    Two rows at most are carried from batch to batch: the first of the open bucket and of its open class. A mark counts as a class, so
    that all others of its bucket are compared, and stands first.
    """
    carried = None  # columns and whether each row has been given out
    for b in batches:
        columns = [b[n].to_numpy(zero_copy_only=False) for n in ("h", "c", "doc", "lo", "hi", "kind")]
        known = columns[5] == KNOWN
        h, c, doc, lo, hi, sort = (x[~known] for x in columns)
        out = [tuple(x[known] for x in columns[2:5]) + (np.full(known.sum(), REPEAT), columns[0][known])]
        if len(h):
            given, n = sort == MARK, 0
            if carried:
                n = len(carried[6])
                h, c, doc, lo, hi, sort, given = (np.r_[x, y] for x, y in zip(carried, (h, c, doc, lo, hi, sort, given), strict=True))
            row = np.arange(len(h))
            new_bucket = np.r_[True, h[1:] != h[:-1]]
            new_class = new_bucket | np.r_[True, c[1:] != c[:-1]]
            first = np.maximum.accumulate(np.where(new_class, row, 0))
            again = ((doc > doc[first]) | (lo > lo[first])) & (row >= n) & (sort != MARK)
            bucket = np.cumsum(new_bucket) - 1
            several = np.bincount(bucket, new_class)[bucket] > 1
            spread = np.bincount(np.cumsum(new_class) - 1, sort == SPREAD)[np.cumsum(new_class) - 1] > 0
            compare = new_class & (several | spread) & ~given
            for pick, kind in ((again, REPEAT), (compare, COMPARED)):
                out.append((doc[pick], lo[pick], hi[pick], np.full(pick.sum(), kind), h[pick]))
            given |= compare
            keep = np.unique([np.flatnonzero(new_bucket)[-1], first[-1]])
            carried = tuple(x[keep] for x in (h, c, doc, lo, hi, sort, given))
        merged = [np.concatenate(x) for x in zip(*out, strict=True)]
        again = merged[3] == REPEAT
        runs = joined_runs(*(x[again] for x in merged[:3]))
        merged = [np.r_[x[~again], y] for x, y in zip(merged, (*runs, np.full(len(runs[0]), REPEAT), np.zeros(len(runs[0]), "i8")), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(merged, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc", "lo", "hi", "kind", "h"])


def refine(contexts: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context number, offset and bucket identifier of each start of a string of `span` bytes in the contexts."""
    sizes = np.array([len(x) for x in contexts], "i8")
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(contexts) + bytes(8), "u1")
    first = np.zeros(len(raw) - 8, "u8")
    for i in range(8):  # strings of 8 bytes are their own identifiers
        first = (first << np.uint64(8)) | raw[i : len(raw) - 8 + i].astype("u8")
    ids = np.unique(first, return_inverse=True)[1].reshape(-1)
    depth = 8
    while depth < span:
        step = min(depth, span - depth)
        pair = ids[:-step] * np.int64(len(raw)) + ids[step:]
        ids = np.unique(pair, return_inverse=True)[1].reshape(-1)
        depth += step
    number = np.repeat(np.arange(len(contexts)), sizes)[: len(ids)]
    start = np.arange(len(ids))
    inside = start + span <= ends[number]
    return number[inside], (start - (ends - sizes)[number])[inside], ids[inside]


def compare_contexts(batches: Iterator[pa.RecordBatch], span: int = SPAN) -> Iterator[pa.RecordBatch]:
    """Contexts (h, one, context, doc, lo), ordered so, to the starts that repeat an earlier start of their bucket."""
    held: list[tuple] = []
    size, before = 0, None

    def settled(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        number, offset, ids = refine([r[2] for r in rows], span)
        doc, start = np.array([r[3] for r in rows], "i8")[number], np.array([r[4] for r in rows], "i8")[number] + offset
        by = np.lexsort((start, doc, ids))
        doc, start, ids = doc[by], start[by], ids[by]
        first = np.maximum.accumulate(np.where(np.r_[True, ids[1:] != ids[:-1]], np.arange(len(ids)), 0))
        late = (doc > doc[first]) | (start > start[first])
        doc, start = doc[late], start[late]
        by = np.lexsort((start, doc))
        doc, start = doc[by], start[by]
        joint = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)][: len(doc)]
        edge = np.flatnonzero(joint)
        return doc[edge], start[edge], start[np.r_[edge[1:] - 1, len(start) - 1]] if len(edge) else start

    for b in batches:
        out = []
        single = []
        for r in zip(*(b[n].to_pylist() for n in ("h", "one", "context", "doc", "lo")), strict=True):
            if r[2] is None:  # a repeat for sure
                single.append((r[3], r[4], r[4]))
            elif r[1]:  # one string: equal strings stand next to each other, the earliest first
                if before and before[0] == r[0] and before[2] == r[2]:
                    if (r[3], r[4]) > (before[3], before[4]):
                        single.append((r[3], r[4], r[4]))
                else:
                    before = r
            else:
                if size > COMPARE and held[-1][0] != r[0]:
                    out.append(settled(held))
                    held, size = [], 0
                held.append(r)
                size += len(r[2])
        if single:
            out.append(joined_runs(*(np.array(x, "i8") for x in zip(*single, strict=True))))
        for doc, lo, hi in out:
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo), pa.array(hi)], names=["doc", "lo", "hi"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in settled(held)], names=["doc", "lo", "hi"])


def contexts(docs: DataFrame, firsts: DataFrame, text: str, span: int) -> DataFrame:
    """(h, one, context, doc, lo) of the classes' firsts; those of crowded buckets string by string.

    A task sends a string again only if it stands earlier than where the task has met it before; other places are repeats for
    sure and have no context.
    """
    crowded = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED).select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("one"))
    marked = firsts.withColumn("salt", F.pmod(F.xxhash64("doc", "lo"), F.lit(SALTS)).cast("int")).join(stored(crowded, "crowded"), ["h", "salt"], "left")
    lists = marked.groupBy("doc").agg(F.collect_list(F.struct("h", "lo", "hi", F.coalesce("one", F.lit(False)).alias("one"))).alias("found"))

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, tuple[int, int]] = {}
        digest = xxhash.xxh3_128_intdigest
        for whole in batches:
            for b in few(whole, text):
                rows = []
                for doc, t, found in zip(b["doc"].to_pylist(), b[text].to_pylist(), b["found"].to_pylist(), strict=True):
                    raw = (t or "").encode()
                    for x in found:
                        if not x["one"]:
                            rows.append((x["h"], False, raw[x["lo"] : x["hi"] + span], doc, x["lo"]))
                            continue
                        for p in range(x["lo"], x["hi"] + 1):
                            s = raw[p : p + span]
                            d = digest(s)
                            before = met.get(d)
                            if before and before < (doc, p):
                                rows.append(((d ^ doc) % (1 << 63), True, None, doc, p))
                                continue
                            if before != (doc, p) and (before or len(met) < REMEMBERED):
                                met[d] = (doc, p)
                            rows.append(((d >> 64) - (1 << 63), True, s, doc, p))
                for i in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 5000], strict=True), (pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["h", "one", "context", "doc", "lo"])

    joined = docs.join(lists.hint("shuffle_hash"), "doc")  # with all columns of docs, so that the shuffle of docs serves again in the end
    return joined.mapInArrow(run, "h long, one boolean, context binary, doc long, lo long")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """df with n_bytes, kept (binary), and removed: the array of maximal removed runs (start, end) in bytes.

    A byte goes if a string of `span` bytes over it also starts earlier: in a row of a smaller key, or earlier
    in the same text. Keys are integers; a null key counts as larger than all others. Rows that share a key, or lack one, are documents of their
    own, in one order or another, so only the first copy of what they share stays. Null and empty texts have no bytes. Columns
    of the new names are replaced. An empty table gives no rows.
    """
    new = ("n_bytes", "kept", "removed")
    df = numbered(df, key, "\1row")
    rest = [c for c in df.columns if c not in (*new, "\1row")]
    docs = df.select(F.coalesce("\1row", F.lit(LAST)).alias("doc"), F.col(text).alias("\1text"), *(F.col(c).alias(f"\1c{i}") for i, c in enumerate(rest) if c != text))
    found = stored(anchor_rows(docs, "\1text", span).mapInArrow(giving_back(settle_classes), "doc long, lo long, hi long, kind int, h long"), "repeats")
    firsts = contexts(docs, found.where(F.col("kind") == COMPARED), "\1text", span)
    compared = firsts.repartition("h").sortWithinPartitions("h", "one", "context", "doc", "lo").mapInArrow(giving_back(lambda b: compare_contexts(b, span)), "doc long, lo long, hi long")
    runs = found.where(F.col("kind") == REPEAT).select("doc", "lo", "hi").union(compared)
    lists = runs.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))

    schema = df.select(*rest).schema.add("n_bytes", "long").add("kept", "binary").add("removed", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    named = ["\1text" if c == text else f"\1c{i}" for i, c in enumerate(rest)]

    @giving_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in few(whole, "\1text"):
                sizes, kept, removed = [], [], []
                for t, mine in zip(b["\1text"].to_pylist(), b["runs"], strict=True):
                    raw, a, z = (t or "").encode(), np.zeros(0, "i8"), np.zeros(0, "i8")
                    if mine.is_valid:
                        a, z = mine.values.field("lo").to_numpy(), np.minimum(mine.values.field("hi").to_numpy() + span, len(raw))
                    by = np.argsort(a, kind="stable")
                    a, z = a[by], np.maximum.accumulate(z[by]) if len(a) else z
                    joint = np.flatnonzero(np.r_[True, a[1:] > z[:-1]][: len(a)])
                    starts, stops = a[joint].tolist(), z[np.r_[joint[1:] - 1, len(a) - 1]].tolist() if len(a) else []
                    sizes.append(len(raw))
                    removed.append([{"start": s, "end": e} for s, e in zip(starts, stops, strict=True)])
                    kept.append(b"".join([raw[s:e] for s, e in zip([0, *stops], [*starts, len(raw)], strict=True)]) if starts else raw)
                yield pa.RecordBatch.from_arrays([*(b[c] for c in named), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, kind)], names=[*rest, *new])

    return docs.join(lists.hint("shuffle_hash"), "doc", "left").mapInArrow(cut, schema)
