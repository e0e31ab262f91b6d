"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of labelled rows. The terms of a text are its words (runs of letters, lower case), all of them; their document
frequencies are counted over all documents, those of the examples' terms one by one and those of other terms, which add to
nothing but a text's length, by hash in a table of fixed size. Examples stand in blocks, like ones
together; for each term the index keeps its postings and the highest weight in each block that has it. A
text's weights times these maxima bound its similarity to a block, so that after the most promising
blocks only those whose bound reaches the k-th best similarity are scored: the k nearest are exact.

A neighbour's vote weighs as much as its similarity, nearly all of it by the part that comes from terms on which the labels depend; a few votes
go to the share of label 1, so that faint similarities decide nothing. Votes are calibrated on the examples themselves, each scored without
itself, and without its label in what is known of its terms.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import few
from .cells import added_up
from .common import distinct_sample, stored

#: About so many examples of each label are learned from; this bounds the vocabulary, the index and what is broadcast.
EXAMPLES_PER_LABEL = 2000
#: Log-likelihood ratio of a term and the label (chi-square with one degree of freedom) from which on the term's part of a similarity counts in full.
FULL_RATIO = 24.0
#: The part of a similarity that votes whatever its terms, and the weight of the votes for the share of label 1.
LEAST_PART, PRIOR = 0.01, 0.01
NEIGHBOURS = 100
#: Cells of the table of document frequencies of terms that no example has, and the bits that tell such terms apart within a batch.
CELL_BITS, HASH_BITS = 20, 40
BLOCK = 128
FIRST_BLOCKS = 2
CACHE_ENTRIES = 400_000
#: A term that at least this share of the examples has keeps a weight for every one of them, as a row of a matrix.
DENSE_SHARE = 1 / 16
#: Terms with fewer postings for each of their blocks are scored before blocks are bounded.
THIN = 3
#: Texts that are multiplied with that matrix together.
TOGETHER = 128
LETTERS = re.compile(r"[^\W\d_]+")
PUNCTUATION = ".,;:!?'\"()[]"


def terms_of(chunk: str) -> list[str]:
    """The words of one white-space-delimited chunk."""
    return LETTERS.findall(chunk.lower())


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size of them) for each start, one after the other."""
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


class Terms:
    """Counts of terms in texts; keeps the terms of odd chunks it has met (bounded). Terms of the vocabulary have their places as ids, others a hash beyond."""

    def __init__(self, vocabulary: list[str]):
        self.ids = {t: i for i, t in enumerate(vocabulary)}
        self.words = pa.array(vocabulary, pa.string())
        self.known: dict[str, tuple[int, ...]] = {}

    def other(self, term: str) -> int:
        """The id of a term that is not in the vocabulary."""
        return len(self.ids) + (xxhash.xxh64_intdigest(term) >> 64 - HASH_BITS)

    def look(self, chunk: str) -> tuple[int, ...]:
        found = self.known.get(chunk)
        if found is None:
            ids = self.ids
            found = tuple(ids[t] if t in ids else self.other(t) for t in terms_of(chunk))
            if len(self.known) < CACHE_ENTRIES:
                self.known[chunk] = found
        return found

    def of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many terms each chunk has, and their ids, one after the other. Single words are looked up together, other chunks one by one."""
        word = pc.utf8_lower(pc.ascii_trim(chunks, characters=PUNCTUATION))
        one = pc.utf8_is_alpha(word).to_numpy(zero_copy_only=False) & ~pc.match_substring_regex(chunks, "[\u0130\u03a3]").to_numpy(zero_copy_only=False)  # two letters whose case isn't simple
        place = pc.fill_null(pc.index_in(word, value_set=self.words), -1).to_numpy().astype("i8")
        unseen = np.flatnonzero(one & (place < 0))
        place[unseen] = np.fromiter(map(self.other, word.take(pa.array(unseen)).to_pylist()), "i8", len(unseen))
        size, odd = one.astype("i8"), np.flatnonzero(~one)
        found = list(map(self.look, chunks.take(pa.array(odd)).to_pylist()))
        size[odd] = np.fromiter(map(len, found), "i8", len(found))
        begin = np.cumsum(size) - size
        flat = np.empty(size.sum(), "i8")
        flat[begin[one]] = place[one]
        flat[spans(begin[odd], size[odd])] = np.fromiter(itertools.chain.from_iterable(found), "i8")
        return size, flat

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges (one more than texts), and between them the ids of each text's terms, rising, and how often each occurs.

        A batch is cut at white space and its distinct chunks are looked up once each; the rest is arithmetic on arrays.
        """
        lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        chunks = lists.flatten().dictionary_encode()
        code = chunks.indices.to_numpy()
        size, flat = self.of_chunks(chunks.dictionary)
        doc = np.repeat(np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy()), size[code])
        term = flat[spans((np.cumsum(size) - size)[code], size[code])]
        distinct, rank = np.unique(term, return_inverse=True)
        wide = max(1, len(distinct))
        cell, n = np.unique(doc * wide + rank, return_counts=True)
        return np.searchsorted(cell, np.arange(len(texts) + 1) * wide), distinct[cell % wide] if len(distinct) else cell, n


def weights(t: np.ndarray, n: np.ndarray, idf: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the vocabulary's terms in a text and their weights, where the weights of all its terms have length one."""
    own = t < len(idf)
    t, rest = t[own], others[(t[~own] - len(idf)) & len(others) - 1]
    w, rest = (1 + np.log(n[own])) * idf[t], (1 + np.log(n[~own])) * rest
    return t, w / max(np.sqrt((w * w).sum() + (rest * rest).sum()), 1e-12)


def telling(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How far the labels depend on each term, from 0 to 1: a and b of the n1 and n0 examples of label 1 and 0 have it."""
    n, both = n1 + n0, a + b

    def part(seen: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        """A cell's share of the log-likelihood ratio: seen against what the margins lead one to expect."""
        some = np.maximum(seen, 1)
        return np.where(seen > 0, seen * np.log(some * max(n, 1) / np.maximum(of * size, some)), 0.0)

    ratio = 2 * (part(a, both, n1) + part(b, both, n0) + part(n1 - a, n - both, n1) + part(n0 - b, n - both, n0))
    return np.clip(ratio / FULL_RATIO, 0, 1) ** 2


class BlockMaxIndex:
    """Postings by term and block, with the highest weight of each term in each block where it occurs.

    The postings of the most frequent terms are rows of a matrix with a weight for every example; their part of a similarity is
    known for all examples before blocks are bounded, and so is that of terms with so few postings a block that bounds cost as much.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        """vectors: term ids and weights of each example; an example's number is its place here."""
        having = np.bincount(np.concatenate([t for t, _ in vectors] or [np.zeros(0, "i8")]), minlength=n_terms)
        commonest = [t[np.argmax(having[t])] if len(t) else n_terms for t, _ in vectors]  # tells languages apart
        heaviest = [t[np.argmax(w)] if len(t) else n_terms for t, w in vectors]
        self.order = np.lexsort((np.arange(len(vectors)), heaviest, commonest)) if vectors else np.zeros(0, "i8")  # like examples share a block
        n = max(1, -(-len(vectors) // BLOCK))
        place = np.repeat(np.arange(len(vectors)), [len(vectors[i][0]) for i in self.order])
        term = np.concatenate([vectors[i][0] for i in self.order] or [np.zeros(0, "i8")])
        weight = np.concatenate([vectors[i][1] for i in self.order] or [np.zeros(0)])
        frequent = np.flatnonzero(having > max(1.0, DENSE_SHARE * len(vectors)))
        self.row = np.full(n_terms, -1)
        self.row[frequent] = np.arange(len(frequent))
        thick = self.row[term] >= 0
        self.dense = np.zeros((len(frequent), len(vectors)))
        self.dense[self.row[term[thick]], place[thick]] = weight[thick]
        place, term, weight = place[~thick], term[~thick], weight[~thick]
        by = np.lexsort((place, term))
        self.place, self.weight = place[by].astype("i4"), weight[by]
        cell = term[by] * n + place[by] // BLOCK
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
        self.edges, self.block = np.r_[first, len(cell)], (cell[first] % n).astype("i4")
        self.cells = np.searchsorted(cell[first], np.arange(n_terms + 1) * n)  # the cells of term t are those from cells[t] to cells[t + 1]
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.blocks = n
        self.thin = self.edges[self.cells[1:]] - self.edges[self.cells[:-1]] < THIN * np.diff(self.cells)

    def score(self, both: np.ndarray, text: np.ndarray, a: np.ndarray, z: np.ndarray, w: np.ndarray, u: np.ndarray) -> None:
        """Adds what the postings from a to z of some cells give to the similarities and to their shares, texts by places; w, u: the weight, and the share of it, of
        each cell's term in the text that asks for it."""
        texts, n = both.shape[1:]
        size = z - a
        at = spans(a, size)
        to, weight = np.repeat(text * n, size), self.weight[at]
        to += self.place[at]
        for total, x in zip(both, (w, u), strict=True):
            x = np.repeat(x, size)
            x *= weight
            total += np.bincount(to, x, texts * n).reshape(texts, n)

    def all_nearest(self, vectors: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, leave_out: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each vector (term ids, weights, and a share of each) the numbers, similarities and shares of them of the k most similar examples with
        a term in common; ties by number."""
        for i in range(0, len(vectors), TOGETHER):
            yield from self.nearest(vectors[i : i + TOGETHER], k, leave_out[i : i + TOGETHER] if leave_out else None)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, leave_out: list[int] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """As above for a few texts at once."""
        texts, n = len(vectors), len(self.order)
        if not n:
            yield from [(np.zeros(0, "i8"), np.zeros(0), np.zeros(0))] * texts
            return
        text = np.repeat(np.arange(texts), [len(v[0]) for v in vectors])
        t, w, u = (np.concatenate([v[i] for v in vectors]) for i in range(3))
        u = u * w
        row = self.row[t]
        asked = np.zeros((2, texts, len(self.dense)))
        asked[0, text[row >= 0], row[row >= 0]] = w[row >= 0]
        asked[1, text[row >= 0], row[row >= 0]] = u[row >= 0]
        both = (asked.reshape(2 * texts, -1) @ self.dense).reshape(2, texts, n)
        text, t, w, u = text[row < 0], t[row < 0], w[row < 0], u[row < 0]
        thin = self.thin[t]
        self.score(both, text[thin], self.edges[self.cells[t[thin]]], self.edges[self.cells[t[thin] + 1]], w[thin], u[thin])
        sims, told = both
        text, t, w, u = text[~thin], t[~thin], w[~thin], u[~thin]
        size = self.cells[t + 1] - self.cells[t]
        cells, text, w, u = spans(self.cells[t], size), np.repeat(text, size), np.repeat(w, size), np.repeat(u, size)
        block = text * self.blocks + self.block[cells]
        bound = np.maximum.reduceat(sims, np.arange(0, n, BLOCK), axis=1) + np.bincount(block, w * self.most[cells], texts * self.blocks).reshape(texts, -1)
        first = np.zeros_like(bound, bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        begin, end = self.edges[cells], self.edges[cells + 1]
        pick = first.reshape(-1)[block]
        self.score(both, text[pick], begin[pick], end[pick], w[pick], u[pick])
        short = min(k + 1, n)  # one more, for the one left out
        kth = np.partition(sims, n - short, axis=1)[:, n - short] if n > k else np.zeros(texts)  # of sums that may lack something
        rest = ~first & (bound + 1e-9 >= np.maximum(kth, 1e-9)[:, None])
        pick = rest.reshape(-1)[block]
        self.score(both, text[pick], begin[pick], end[pick], w[pick], u[pick])  # the nearest stand in blocks that are scored, so their shares are whole
        kth = np.partition(sims, n - short, axis=1)[:, n - short]
        at, place = np.nonzero((sims > 1e-12) & (sims >= kth[:, None] - 1e-9))
        for j, (a, z) in enumerate(itertools.pairwise(np.searchsorted(at, np.arange(texts + 1)).tolist())):
            number, found, of = self.order[place[a:z]], sims[j, place[a:z]], told[j, place[a:z]]
            if leave_out:
                other = number != leave_out[j]
                number, found, of = number[other], found[other], of[other]
            best = np.lexsort((number, -np.round(found, 9)))[:k]
            yield number[best], found[best], of[best]


def increasing_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least squares by a non-decreasing step function (pool adjacent violators): both ends of each step and their values."""
    groups: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        groups.append([x[i], x[i], y[i] * w[i], w[i]])
        while len(groups) > 1 and (groups[-2][1] == groups[-1][0] or groups[-2][2] * groups[-1][3] >= groups[-1][2] * groups[-2][3]):
            _, at, s, n = groups.pop()
            groups[-1] = [groups[-1][0], at, groups[-1][2] + s, groups[-1][3] + n]
    return np.array([g[k] for g in groups for k in (0, 1)]), np.array([g[2] / g[3] for g in groups for _ in (0, 1)])


class Model:
    """The index with the labels of its examples and the calibration of the votes."""

    def __init__(self, vocabulary: list[str], having: np.ndarray, idf: np.ndarray, others: np.ndarray, keys: list, counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float):
        """having: how many examples of label 0 and 1 have each term; others: the idf of terms of each cell; share: of label 1 among all labelled rows."""
        self.vocabulary, self.having, self.idf, self.others, self.keys, self.labels, self.share = vocabulary, having, idf, others, keys, labels, share
        self.sizes = [int((labels == y).sum()) for y in (0, 1)]
        self.tells = telling(having[1], having[0], self.sizes[1], self.sizes[0])
        self.index = BlockMaxIndex([weights(*c, idf, others) for c in counts], len(vocabulary))
        self.x, self.y, self.lone_score = np.zeros(1), np.zeros(1), 0.0
        self.handle = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"handle": None}

    def shared(self, sc):
        """The model as a broadcast variable, sent once, whatever it is calibrated to meanwhile."""
        self.handle = self.handle or sc.broadcast(self)
        return self.handle

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Fits the chance of label 1 to the votes of the examples (NaN without a neighbour)."""
        share = self.share
        own = np.where(labels == 1, share / max(1, (labels == 1).sum()), (1 - share) / max(1, (labels == 0).sum())) * max(1, len(labels))
        lone = np.isnan(votes)
        self.lone_score = float((own * labels * lone).sum() + 0.5 * share) / float((own * lone).sum() + 0.5) if len(labels) else 0.0
        self.x, self.y = increasing_fit(votes[~lone], labels[~lone], own[~lone]) if (~lone).any() else (np.zeros(1), np.array([share]))

    def vote(self, number: np.ndarray, similarity: np.ndarray, told: np.ndarray) -> float:
        """The share of label 1 among the neighbours by the weight of their votes."""
        if not len(number):
            return math.nan
        weight = told + LEAST_PART * similarity
        return float((weight * self.labels[number]).sum() + PRIOR * self.share) / float(weight.sum() + PRIOR)

    def nearest(self, edges: np.ndarray, t: np.ndarray, n: np.ndarray, own: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The nearest examples, their similarities and the parts of these that tell, for texts as Terms.count gives them. own: the texts are these examples, which are left out."""
        vectors = []
        for i, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            terms, w = weights(t[a:z], n[a:z], self.idf, self.others)
            if own is None:
                tells = self.tells[terms]
            else:
                y = int(self.labels[own[i]])
                tells = telling(self.having[1][terms] - y, self.having[0][terms] - (1 - y), self.sizes[1] - y, self.sizes[0] - (1 - y))
            vectors.append((terms, w, tells))
        return self.index.all_nearest(vectors, NEIGHBOURS, own)

    def score(self, number: np.ndarray, similarity: np.ndarray, told: np.ndarray, calibration: tuple[np.ndarray, np.ndarray, float]) -> float:
        """The calibrated score, between the fitted steps by line."""
        x, y, lone = calibration
        return float(np.interp(self.vote(number, similarity, told), x, y)) if len(number) else lone


def fit(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from EXAMPLES_PER_LABEL usable rows of labels for each label, those of the smallest hashes of the key; all where there are fewer.

    Keys with a null or without a text, or with both labels, teach nothing; of several texts of one key the first in
    order does. Examples are bounded, and so is their vocabulary, so both may go through the driver; document frequencies are
    counted over all rows of docs.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = labels.where(usable & F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null")
    good = rows.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("key", "label")
    totals = {r["label"]: r["count"] for r in good.groupBy("label").count().collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    picked = distinct_sample(good, "label", ["key"], EXAMPLES_PER_LABEL)
    sample = stored(docs.where("text is not null").join(F.broadcast(picked), "key").groupBy("key", "label").agg(F.min("text").alias("text")), "toxic-examples")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for b in batches:
            for t, y in zip(b["text"].to_pylist(), b["label"].to_pylist(), strict=True):
                found.update((x, y) for x in {x for w in set(t.split()) for x in terms_of(w)})
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["term", "label", "n"])

    seen = sample.mapInArrow(terms, "term string, label int, n long").groupBy("term").agg(*(F.sum(F.expr(f"if(label = {y}, n, 0)")).alias(f"n{y}") for y in (0, 1)))
    found = seen.toArrow().sort_by("term")
    vocabulary, having = found["term"].to_pylist(), np.array([found["n0"].to_numpy(), found["n1"].to_numpy()])
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(vocabulary)
    apart = 1 << CELL_BITS  # the terms of the vocabulary have cells of their own from here on
    counters: list[Terms] = []

    def cells(b: pa.RecordBatch) -> list[np.ndarray]:
        if not counters:
            counters.append(Terms(shared.value))
        _, t, _ = counters[0].count(b["text"])
        known = len(counters[0].ids)
        return [np.where(t < known, apart + t, (t - known) & apart - 1)]

    df = added_up(docs.select("text"), "text", cells, max(CELL_BITS + 1, (apart + len(vocabulary)).bit_length()), lambda total: total.astype("<f4")).astype("f8")
    every = docs.count()
    idf, others = (np.log((1 + every) / (1 + x)) + 1e-3 for x in (df[apart : apart + len(vocabulary)], df[:apart]))
    others = np.maximum(others, 1e-3)  # a cell may hold more terms than there are documents

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Terms(shared.value)
        for b in batches:
            edges, t, n = counter.count(b["text"])
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, kind)) for x, kind in ((t, pa.int32()), (n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b["key"], b["label"], *lists], names=["key", "label", "t", "n"])

    schema = T.StructType([sample.schema["key"], sample.schema["label"], T.StructField("t", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.LongType()))])
    found = sample.mapInArrow(vectors, schema).toArrow().sort_by("key")
    counts = [(t.values.to_numpy().astype("i8"), n.values.to_numpy()) for t, n in zip(found["t"], found["n"], strict=True)]
    model = Model(vocabulary, having, idf, others.astype("f4"), found["key"].to_pylist(), counts, found["label"].to_numpy().astype("i8"), share)
    raw = model.shared(sc)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = raw.value
        number, counter = {k: i for i, k in enumerate(m.keys)}, Terms(m.vocabulary)
        for b in batches:
            out = [m.vote(*near) for near in m.nearest(*counter.count(b["text"]), [number[k] for k in b["key"].to_pylist()])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), b["label"]], names=["vote", "label"])

    spread = sample.repartition(max(1, sc.defaultParallelism), "key")  # scoring takes longer than reading
    own = spread.mapInArrow(votes, "vote double, label int").toArrow().sort_by([("vote", "ascending"), ("label", "ascending")])
    model.calibrate(own["vote"].to_numpy(), own["label"].to_numpy().astype("i8"))
    return model


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", evidence: int = 3) -> DataFrame:
    """docs with score (0 to 1), predicted (1 from 0.5 on) and evidence: the nearest examples' keys, similarities and labels.

    Null and empty texts, and texts without a word of any example, get the share of label 1 among examples that
    have no neighbour either; without examples every score is 0. Columns of the new names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted", "evidence")]
    item = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("label", T.IntegerType())])
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(item))])
    shared, calibration = model.shared(docs.sparkSession.sparkContext), (model.x, model.y, model.lone_score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        counter = Terms(m.vocabulary)
        for whole in batches:
            kind = pa.list_(pa.struct([(key, whole.schema.field(key).type), ("similarity", pa.float64()), ("label", pa.int32())]))
            for b in few(whole, text):
                found = list(m.nearest(*counter.count(b[text])))
                score = np.array([m.score(*near, calibration) for near in found])
                proof = [[{key: m.keys[i], "similarity": float(s), "label": int(m.labels[i])} for i, s in zip(n[:evidence].tolist(), sims[:evidence].tolist(), strict=True)] for n, sims, _ in found]
                yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(score), pa.array((score >= 0.5).astype("i4")), pa.array(proof, kind)], names=[*keep, "score", "predicted", "evidence"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
