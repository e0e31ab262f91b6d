"""Byte-pair encoding and decoding of whole texts with a public vocabulary file.

A text is cut at ASCII white space first: no merge and no match of the vocabulary's own pattern
crosses it, so a chunk's ids do not depend on its neighbours. Chunks repeat, so each batch encodes
its distinct ones, and each task keeps the ids of chunks and pieces it has met (bounded caches, which
only save time). New chunks are normalised, split by the vocabulary's pattern and merged with a
priority queue of merge ranks over a doubly linked list of symbols; entries whose symbols have merged
in the meantime are stale and skipped.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import cut_words

#: Chunks, and pieces, whose ids a coder keeps, and the bytes that each of them has at most.
CACHE_ENTRIES = 500_000
CACHE_BYTES = 64
#: Symbols of a piece from which on they and their links are kept in arrays.
LONG = 4096
#: New pieces that the library encodes as one text.
TOGETHER = 500


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the rest follow from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in plain else next(moved) for b in range(256)]


def edges(sizes: np.ndarray | list[int]) -> np.ndarray:
    """Where rows of these sizes, one after the other, begin and end."""
    out = np.zeros(len(sizes) + 1, "i8")
    np.cumsum(sizes, out=out[1:])
    return out


def taken(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of many rows of ids: the ids one after the other, and how many each row has."""
    n = sizes[which]
    to = edges(n)
    return ids[np.repeat(edges(sizes)[which] - to[:-1], n) + np.arange(to[-1])], n


class Kept:
    """The ids of strings that were met, in arrays. It takes what comes first, which is what is frequent, and then stays as it is."""

    def __init__(self, most: int):
        self.most = most
        self.strings, self.ids, self.sizes = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, "i8")

    def encode(self, strings: pa.Array, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings, one after the other, and how many each has. make does the same for distinct strings that are not kept."""
        coded = strings.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.strings)
        unknown = place.is_null()
        at = place.fill_null(0).to_numpy().astype("i8")
        ids, sizes = self.ids, self.sizes
        if len(new := coded.dictionary.filter(unknown)):
            at[unknown.to_numpy(zero_copy_only=False)] = len(sizes) + np.arange(len(new))
            made, n = make(new)
            ids, sizes = np.concatenate([ids, made]), np.concatenate([sizes, n])
            short = np.flatnonzero(pc.binary_length(new).to_numpy() <= CACHE_BYTES)[: self.most - len(self.sizes)]
            if len(short):
                self.strings = pa.concat_arrays([self.strings, new.take(pa.array(short))])
                made, n = taken(made, n, short)
                self.ids, self.sizes = np.concatenate([self.ids, made]), np.concatenate([self.sizes, n])
        return taken(ids, sizes, at[coded.indices.to_numpy()])


class WordBpe:
    """Encoder and decoder for a vocabulary file of the kind "BPE with word ends"."""

    def __init__(self, file_text: str, merge: str = "queue"):
        """merge: "queue" merges with the own priority queue; "library" leaves new pieces to the tokenizers library."""
        spec = json.loads(file_text)
        self.file_text, self.merge = file_text, merge
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.end: str = spec["model"]["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.splitter = regex.compile(f"{split['pattern']['Regex']}|\n")
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.byte_ids = [self.vocab[c] for c in alphabet]
        self.last_ids = [self.vocab[c + self.end] for c in alphabet]
        self.chunks, self.pieces = Kept(CACHE_ENTRIES), Kept(CACHE_ENTRIES)

    @cached_property
    def ranks(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Rank and outcome of each pair of ids that merges."""
        out = {}
        for rank, pair in enumerate(json.loads(self.file_text)["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            out[self.vocab[left], self.vocab[right]] = (rank, self.vocab[left + right])
        return out

    @cached_property
    def strings(self) -> list[str]:
        """Vocabulary strings by id."""
        out = [""] * (max(*self.vocab.values(), *self.special.values(), -1) + 1)
        for token, i in (*self.vocab.items(), *self.special.items()):
            out[i] = token
        return out

    def merged(self, piece: str) -> list[int]:
        """The ids of one piece: the lowest rank merges first, the leftmost of equals first."""
        raw = piece.encode()
        ids = [self.byte_ids[b] for b in raw[:-1]]
        ids.append(self.last_ids[raw[-1]])
        ranks, n = self.ranks, len(ids)
        if n == 1:
            return ids
        before, after = range(-1, n - 1), range(1, n + 1)
        if n > LONG:  # four bytes a link instead of a list's forty
            ids, before, after = array("i", ids), array("i", before), array("i", after)
        else:
            before, after = [*before], [*after]
        queue = []  # rank and place in one number
        for i in range(n - 1):
            if r := ranks.get((ids[i], ids[i + 1])):
                queue.append(r[0] * n + i)
        heapq.heapify(queue)
        pop, push, look = heapq.heappop, heapq.heappush, ranks.get
        while queue:
            top = pop(queue)
            i = top % n
            j = after[i]
            if j >= n:
                continue
            pair = look((ids[i], ids[j]))
            if pair is None or pair[0] != top // n:
                continue  # stale: one of the two has merged since
            new = pair[1]
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := look((new, ids[k])):
                    push(queue, r[0] * n + i)
            h = before[i]
            if h >= 0 and (r := look((ids[h], new))):
                push(queue, r[0] * n + h)
        return [x for x in ids if x >= 0]

    @cached_property
    def library(self):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.file_text)

    @cached_property
    def ends(self) -> np.ndarray:
        """Which ids end a piece."""
        return np.array([bool(self.end) and x.endswith(self.end) for x in self.strings], bool)

    def ids_of_pieces(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new pieces, one after the other, and how many each has."""
        pieces, ids, sizes = new.to_pylist(), array("I"), []

        def merge(some: list[str]) -> None:
            for p in some:
                found = self.merged(p)
                ids.extend(found)
                sizes.append(len(found))

        if self.merge != "library":
            merge(pieces)
        else:
            parts = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
            joined = [" ".join(p) for p in parts]
            for part, text, e in zip(parts, joined, self.library.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                found = np.array(e.ids, "<u4")
                stops = np.flatnonzero(self.ends[found]) + 1
                if len(stops) == len(part) and unicodedata.is_normalized("NFC", text):  # every piece ends with an id of its own, and no other id does
                    ids.frombytes(found.tobytes())
                    sizes += np.diff(stops, prepend=0).tolist()
                else:  # a piece that spells a special token stands for itself, and marks after a letter of two characters in lower case keep their order
                    merge(part)
        return np.array(ids, "<u4"), np.array(sizes, "i8")

    def ids_of_chunks(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of new chunks, which are normalised (composed, lower case letter by letter) and split by the vocabulary's pattern."""
        text = "\n".join(new.to_pylist())
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        found = pa.array(self.splitter.findall(text.lower()), pa.string())  # with the ends of lines between the chunks
        ends = pc.equal(found, "\n")
        at = np.flatnonzero(ends.to_numpy(zero_copy_only=False))
        ids, sizes = self.pieces.encode(found.filter(pc.invert(ends)), self.ids_of_pieces)
        return ids, np.diff(edges(sizes)[[0, *(at - np.arange(len(at))), len(sizes)]])

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Texts without special tokens to little-endian 32-bit ids."""
        chunks, owner, _ = cut_words(pa.array(texts, pa.string()))
        ids, sizes = self.chunks.encode(chunks, self.ids_of_chunks)
        ends = (4 * edges(sizes)[np.searchsorted(owner, np.arange(len(texts) + 1))]).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Texts to little-endian 32-bit ids; special tokens inside a text are cut out before anything else."""
        if not self.special_pattern:
            return self.encode_plain([t or "" for t in texts])
        parts, owner = [], []
        for i, t in enumerate(texts):
            cut = self.special_pattern.split(t) if t and any(s in t for s in self.special) else [t or ""]
            parts += cut
            owner += [i] * len(cut)
        plain = self.encode_plain(["" if p in self.special else p for p in parts])
        if len(parts) == len(texts):
            return plain
        out = [b""] * len(texts)
        for p, i, ids in zip(parts, owner, plain, strict=True):
            out[i] += np.array([self.special[p]], "<u4").tobytes() if p in self.special else ids
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Vocabulary strings joined as a decoder-less file is decoded: by one space; unknown ids are skipped."""
        strings = self.strings
        return " ".join([strings[i] for i in ids.tolist() if 0 <= i < len(strings)])


def few(batch: pa.RecordBatch, column: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts hold about so many bytes each, so that memory does not follow the batch size."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), "i8")
    at = np.cumsum(size) // chars
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


_OWN: dict[tuple[int, str], WordBpe] = {}


def coder(file_text: str, merge: str) -> WordBpe:
    """One coder for each Python worker, as workers serve many tasks."""
    key = (hash(file_text), merge)
    if key not in _OWN:
        _OWN[key] = WordBpe(file_text, merge)
    return _OWN[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", merge: str = "queue") -> DataFrame:
    """df with a column of token ids (array of int) for the whole text of each row.

    The vocabulary file is read on the driver and broadcast (its size does not follow the data).
    Null and empty texts give an empty array; rows are kept as they are, repeated ones too; a column
    of the same name as the new one is replaced.
    """
    keep = [c for c in df.columns if c != ids]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(shared.value, merge)
        for whole in batches:
            for b in few(whole, text):
                found = bpe.encode(b[text].to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype="i4")
                values = pa.array(np.frombuffer(b"".join(found), "<i4"))
                yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.ListArray.from_arrays(pa.array(ends), values)], names=[*keep, ids])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode_documents(df: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that its column of ids decodes to. Null and empty arrays give an empty text; ids
    outside the vocabulary are skipped; a column of the new name is replaced."""
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(shared.value, "queue")
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                lists = part[ids]
                values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                texts = [bpe.decode(values[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(texts, pa.string())], names=[*keep, text])

    return df.select(*keep).mapInArrow(run, schema)

