"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked pairs of ids.

Documents are encoded once; the ids are kept, and each pass aligns them again. The distinct pairs get a minimal perfect
hash; every task counts into a dense vector indexed by it, vectors are summed as a tree, and the last pass looks the
counts up. Keys are compared, so a pair the hash was not built for cannot take another one's count.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .wordhash import BASE, U, in_worker, mix, slices

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
SHARD_PAIRS = 16_384  # of a part of the hash, about
HELD_PAIRS = 4_000_000  # up to so many, hash and counts (72 MB) are broadcast; beyond, pairs meet their counts in a join
FAN_IN = 16  # vectors that one task of the sum reads, for each part of the hash
FLUSH_PAIRS = 1_000_000
CACHED_CHUNKS = 300_000  # of a Python worker: about 100 MB


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---- tokens and their bytes -------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others
    follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """The byte-level vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(words.values()) + 1)
        for word, number in words.items():
            if all(c in letters for c in word):
                self.bytes[number] = bytes(letters[c] for c in word)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """The piece vocabulary, which puts a blank in front of a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for k in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(k)
            self.bytes.append(bytes([int(piece[1:-1], 16)]) if self.model.is_byte(k) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Pair(NamedTuple):
    """Two vocabularies; ``size_a`` and ``size_b`` are the byte lengths of their tokens."""

    a: ByteLevel
    b: Pieces
    size_a: np.ndarray
    size_b: np.ndarray


def _pair(path_a: str | None, path_b: str | None) -> Pair:
    at = path_a or _path(TOKENIZER_A), path_b or _path(TOKENIZER_B)

    def build() -> Pair:
        a, b = ByteLevel(at[0]), Pieces(at[1])
        return Pair(a, b, *(np.array([len(x) for x in v.bytes]) for v in (a, b)))

    return in_worker(f"pair {at}", build)


_BLANK_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def chunks(text: str) -> list[str]:
    """A blank and ``text``, cut in front of every blank that follows another character than white space. Both
    vocabularies cut there: the byte-level one's words begin with their blank, and no piece holds a blank behind another
    character. So chunks are encoded one by one, and equal chunks alike."""
    if text[:1] == " " or _BLANK_AFTER_SPACE.search(text):
        return _CUT.split(" " + text)
    return [" " + w for w in text.split(" ")]


class Encoder:
    """Ids of chunks by both vocabularies, kept by chunk."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.lead = len(pair.b.encode(["a"])[0])  # ids of a letter in front of a chunk: no blank is added to the chunk then
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.good = np.empty(0, bool)
        # of each side: ids of every chunk, and the ids one after the other
        self.sides = [(np.empty(0, np.int64), np.empty(0, "<u4")) for _ in range(2)]

    def _learn(self, new: list[str]) -> None:
        a, b, size_a, size_b = self.pair
        # The first vocabulary gives every byte back and cuts in front of a blank, but not one behind white space: all
        # chunks but those that end with it are encoded as one text.
        tails = [w for w in new if w[-1].isspace()]
        new = [w for w in new if not w[-1].isspace()] + tails
        raw = [w.encode() for w in new]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat_a = np.array([i for x in a.encode(["".join(new[: len(new) - len(tails)]), *tails]) for i in x], "<u4")
        at = np.searchsorted(np.cumsum(size_a[flat_a]), np.cumsum(size)) + 1
        ids_b = [x[self.lead :] for x in b.encode(["a" + w for w in new])]
        n_b = np.fromiter(map(len, ids_b), np.int64, len(ids_b))
        flat_b = np.fromiter(itertools.chain.from_iterable(ids_b), "<u4", int(n_b.sum()))
        good = np.bincount(np.repeat(np.arange(len(new)), n_b), size_b[flat_b], len(new)) == size
        if not good.all() or b"".join([b.bytes[i] for i in flat_b.tolist()]) != b"".join(raw):
            good = np.array([b"".join([b.bytes[i] for i in x]) == w for x, w in zip(ids_b, raw)], bool)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.good = np.append(self.good, good)
        for k, (n, ids) in enumerate(((np.diff(at, prepend=0), flat_a), (n_b, flat_b))):
            self.sides[k] = np.append(self.sides[k][0], n), np.append(self.sides[k][1], ids)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both vocabularies for every text, none where the bytes differ."""
        cut = [chunks(t) if t else [] for t in texts]
        if len(self.number) > CACHED_CHUNKS:
            self.forget()
        new = list({w: None for words in cut for w in words if w not in self.number})
        if new:
            self._learn(new)
        number = self.number
        word = np.array([number[w] for words in cut for w in words], np.int64)
        first = np.concatenate([[0], np.cumsum([len(words) for words in cut])])
        sides = []
        for size, ids in self.sides:
            start, n = np.cumsum(size) - size, size[word]
            bound = np.concatenate([[0], np.cumsum(n)])
            take = np.arange(bound[-1]) + np.repeat(start[word] - bound[:-1], n)
            sides.append((ids[take], bound[first]))
        wrong = np.concatenate([[0], np.cumsum(~self.good[word])])
        usable = wrong[first[1:]] == wrong[first[:-1]]
        none = np.empty(0, "<u4")
        (ids_a, at_a), (ids_b, at_b) = sides
        return [
            (ids_a[at_a[k] : at_a[k + 1]], ids_b[at_b[k] : at_b[k + 1]]) if usable[k] else (none, none)
            for k in range(len(texts))
        ]


def _encode(path_a: str | None, path_b: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = in_worker(f"pair encoder {path_a} {path_b}", lambda: Encoder(_pair(path_a, path_b)))
        for part in slices(batches, "text", 1 << 20):
            got = encoder.encode(part.column("text").to_pylist())
            a, b = (pa.array([x[side].tobytes() for x in got], pa.binary()) for side in (0, 1))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "a": a, "b": b})

    return run


# ---- alignment --------------------------------------------------------------


class Links(NamedTuple):
    """Aligned documents of a batch. ``first_a``, ``first_b``: each document's first token; ``ends``: the last byte
    of each group; ``group_a``, ``group_b``: group of each token; ``doc``, ``key``: document and pair of each link, in order."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    group_doc: np.ndarray
    doc: np.ndarray
    key: np.ndarray


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lists = column.to_pylist()
    first = np.concatenate([[0], np.cumsum([len(x) // 4 for x in lists])])
    return np.frombuffer(b"".join(lists), "<u4").astype(np.int64), first


def align(part: pa.RecordBatch, pair: Pair) -> Links:
    """Groups and links of a batch (a, b) of ids. Both sides cover the same bytes, so that one running count of bytes
    places the tokens of all documents; each stretch between two neighbouring ends, of either side, is one link."""
    a, first_a = _ids(part.column("a"))
    b, first_b = _ids(part.column("b"))
    size_a = pair.size_a[a]
    n_bytes = int(size_a.sum())
    marks = np.zeros((2, n_bytes + 1), bool)
    marks[0, np.cumsum(size_a)] = True
    marks[1, np.cumsum(pair.size_b[b])] = True
    every = np.flatnonzero(marks[0] | marks[1])
    ends_a, ends_b = marks[0, every], marks[1, every]
    # tokens that end before each stretch does
    link_a, link_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    both = ends_a & ends_b
    group = np.cumsum(both) - both
    doc_of_a = np.repeat(np.arange(part.num_rows), np.diff(first_a))
    doc = doc_of_a[link_a]
    return Links(a, b, first_a, first_b, group[ends_a], group[ends_b], doc[both], doc, a[link_a] * len(pair.size_b) + b[link_b])


def _distinct_links(links: Links) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links) of the different pairs of each document."""
    kinds, kind = np.unique(links.key, return_inverse=True)
    both = np.sort(links.doc * max(len(kinds), 1) + kind)
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    doc, kind = np.divmod(both[at], max(len(kinds), 1))
    return doc, kinds[kind], np.diff(np.append(at, len(both)))


def _id_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return slices(batches, "a", 1 << 20)


# ---- minimal perfect hash ----------------------------------------------------


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.view(U) + U((level + 1) * BASE % (1 << 64)))


def perfect_levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of different ``keys``: on each level the keys that are alone at their place set its bit, the others
    go on to the next level. A key's number is how many bits are set before its own."""
    levels, rest = [], keys
    while len(rest):
        size = max(64, 2 * len(rest))
        at = (_level_hash(rest, len(levels)) % U(size)).astype(np.int64)
        single = np.bincount(at, minlength=size) == 1
        levels.append(single)
        rest = rest[~single[at]]
    return levels


class PairIndex:
    """The hash of all parts together: numbers 0..n-1, parts one after the other. ``parts`` are (sizes of the levels,
    packed bits, keys by number) in the order of their numbers."""

    def __init__(self, parts: list[tuple[list[int], bytes, np.ndarray]]):
        self.keys = np.concatenate([k for _, _, k in parts]) if parts else np.empty(0, np.int64)
        depth = max((len(s) for s, _, _ in parts), default=0)
        self.size = np.zeros((len(parts), depth), np.int64)
        for k, (s, _, _) in enumerate(parts):
            self.size[k, : len(s)] = s
        flat = self.size.ravel()
        self.start = (np.cumsum(flat) - flat).reshape(self.size.shape)
        self.bits = (
            np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8), count=sum(s)) for s, p, _ in parts]).astype(bool)
            if parts
            else np.empty(0, bool)
        )
        self.rank = np.cumsum(self.bits, dtype=np.int32) - 1
        self.bound = np.concatenate([[0], np.cumsum([len(k) for _, _, k in parts])]).astype(np.int64)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys the hash was not built for."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        part = shard_of(keys, len(self.size))
        open_ = np.arange(len(keys))
        for level in range(self.size.shape[1]):
            size = self.size[part[open_], level]
            open_, size = open_[size > 0], size[size > 0]
            at = self.start[part[open_], level] + (_level_hash(keys[open_], level) % size.astype(U)).astype(np.int64)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        out[(out >= 0) & (self.keys[out] != keys)] = -1
        return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys.view(U)) % U(shards)).astype(np.int64)


def _build_part(rows: pd.DataFrame) -> pd.DataFrame:
    keys = np.sort(rows["pair"].to_numpy(np.int64))
    levels = perfect_levels(keys)
    bits = np.concatenate(levels)
    number = numbering(levels)
    by_number = np.empty_like(keys)
    by_number[number(keys)] = keys
    return pd.DataFrame(
        {
            "shard": [int(rows["shard"].iloc[0])],
            "sizes": [[len(x) for x in levels]],
            "bits": [np.packbits(bits).tobytes()],
            "keys": [by_number.tobytes()],
        }
    )


def numbering(levels: list[np.ndarray]):
    """Numbers of keys within one part."""
    sizes = [len(x) for x in levels]
    start = np.concatenate([[0], np.cumsum(sizes)])
    bits = np.concatenate(levels)
    rank = np.cumsum(bits) - 1

    def number(keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(sizes):
            at = start[level] + (_level_hash(keys[open_], level) % U(size)).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out

    return number


# ---- passes ------------------------------------------------------------------


def _pairs(path_a: str | None, path_b: str | None):
    """Different pairs of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, size = _pair(path_a, path_b), [], 0

        def out() -> pa.RecordBatch:
            return pa.record_batch({"pair": pa.array(np.unique(np.concatenate(held)))})

        for part in _id_slices(batches):
            held.append(np.unique(align(part, pair).key))
            size += len(held[-1])
            if size > FLUSH_PAIRS:
                held = [np.unique(np.concatenate(held))]
                size = 0
                if len(held[0]) > FLUSH_PAIRS:
                    yield out()
                    held = []
        if held:
            yield out()

    return run


def _shards(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keys = np.asarray(part.column("pair"))
            yield pa.record_batch({"pair": part.column("pair"), "shard": pa.array(shard_of(keys, shards))})

    return run


def _count(held, path_a: str | None, path_b: str | None):
    """One dense vector of a task: for every number, in how many of its documents the pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, index = _pair(path_a, path_b), held.value
        total = np.zeros(len(index.keys), np.int64)
        for part in _id_slices(batches):
            number = index.number(_distinct_links(align(part, pair))[1])
            if (number < 0).any():
                raise RuntimeError("a pair is missing from the hash: the encoded documents changed between passes")
            np.add.at(total, number, 1)
        node = TaskContext.get().partitionId()
        for shard, (lo, hi) in enumerate(zip(index.bound[:-1], index.bound[1:])):
            if total[lo:hi].any():
                yield pa.record_batch(
                    {"shard": pa.array([shard]), "node": pa.array([node]), "counts": pa.array([total[lo:hi].tobytes()], pa.binary())}
                )

    return run


def _sum(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(rows["counts"].iloc[0], np.int64).copy()
    for more in rows["counts"].iloc[1:]:
        total += np.frombuffer(more, np.int64)
    head = rows.iloc[0]
    return pd.DataFrame({"shard": [head["shard"]], "node": [head["node"]], "counts": [total.tobytes()]})


def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of every id's decimal with ',', '|', ';' or nothing behind it."""
    texts = [f"{k}{sep}".encode() for sep in (",", "|", ";", "") for k in range(size)]
    length = np.array([len(t) for t in texts])
    return np.array(texts).view(np.uint8).reshape(len(texts), -1), length


def _groups_text(links: Links, n: int, size: int) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` of every document."""
    table, length = in_worker(f"decimals {size}", lambda: _decimals(size))
    groups = len(links.group_doc)
    in_a, in_b = np.bincount(links.group_a, minlength=groups), np.bincount(links.group_b, minlength=groups)
    # a group's first ids, then its second ones
    at_a = np.arange(len(links.a)) + (np.cumsum(in_b) - in_b)[links.group_a]
    at_b = np.arange(len(links.b)) + np.cumsum(in_a)[links.group_b]
    what = np.empty(len(links.a) + len(links.b), np.int64)
    what[at_a], what[at_b] = links.a, links.b
    last = np.cumsum(in_a + in_b)  # behind each group
    if groups:
        what[last - 1] += 2 * size
        what[last - in_b - 1] += size
        closing = np.append(links.group_doc[1:] != links.group_doc[:-1], True)
        what[last[closing] - 1] += size
    sizes = length[what]
    flat = table[what][np.arange(table.shape[1]) < sizes[:, None]]
    bytes_upto = np.concatenate([[0], np.cumsum(sizes)])
    tokens_upto = links.first_a + links.first_b
    offsets = bytes_upto[tokens_upto].astype(np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes()))


def _shape(links: Links, n: int, pair: Pair) -> dict[str, pa.Array]:
    return {
        "n_a": pa.array(np.diff(links.first_a)),
        "n_b": pa.array(np.diff(links.first_b)),
        "n_groups": pa.array(np.bincount(links.group_doc, minlength=n)),
        "n_links": pa.array(np.bincount(links.doc, minlength=n)),
        "groups": _groups_text(links, n, max(len(pair.size_a), len(pair.size_b))).cast(pa.string()),
    }


_SHAPE = "n_a long, n_b long, n_groups long, n_links long, groups string"


def _look_up(held, path_a: str | None, path_b: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        index, counts, best = held.value
        for part in _id_slices(batches):
            links, n = align(part, pair), part.num_rows
            number = index.number(links.key)
            found = number >= 0
            doc, number = links.doc[found], number[found]
            sums = np.zeros(n, np.int64)
            np.add.at(sums, doc, counts[number])
            yield pa.record_batch(
                {"doc_id": part.column("doc_id")}
                | _shape(links, n, pair)
                | {"n_best": pa.array(np.bincount(doc[best[number]], minlength=n)), "count_sum": pa.array(sums)}
            )

    return run


def _link_rows(path_a: str | None, path_b: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        for part in _id_slices(batches):
            doc, key, n = _distinct_links(align(part, pair))
            rows = np.asarray(part.column("row"))
            yield pa.record_batch({"row": pa.array(rows[doc]), "pair": pa.array(key), "n": pa.array(n)})

    return run


def _shapes(path_a: str | None, path_b: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        for part in _id_slices(batches):
            shape = _shape(align(part, pair), part.num_rows, pair)
            yield pa.record_batch({"row": part.column("row"), "doc_id": part.column("doc_id")} | shape)

    return run


def _by_index(ids: DataFrame, pairs: DataFrame, n: int, path_a: str | None, path_b: str | None, fan_in: int) -> DataFrame:
    sc = ids.sparkSession.sparkContext
    shards = max(1, -(-n // SHARD_PAIRS))
    parts = (
        pairs.mapInArrow(_shards(shards), "pair long, shard long")
        .groupBy("shard")
        .applyInPandas(_build_part, "shard long, sizes array<long>, bits binary, keys binary")
    )
    # HELD_PAIRS keys at most
    rows = {r["shard"]: (list(r["sizes"]), bytes(r["bits"]), np.frombuffer(r["keys"], np.int64)) for r in parts.toLocalIterator()}
    nothing: tuple = ([], b"", np.empty(0, np.int64))
    index = PairIndex([rows.get(s, nothing) for s in range(shards)])
    held = sc.broadcast(index)
    vectors = ids.mapInArrow(_count(held, path_a, path_b), "shard long, node long, counts binary")
    width = ids.rdd.getNumPartitions()
    while width > 1:
        width = -(-width // fan_in)
        up = vectors.withColumn("node", F.floor(F.col("node") / fan_in))
        vectors = up.groupBy("shard", "node").applyInPandas(_sum, "shard long, node long, counts binary")
    counts = np.zeros(len(index.keys), np.int64)
    for r in vectors.toLocalIterator():  # HELD_PAIRS numbers at most
        counts[index.bound[r["shard"]] : index.bound[r["shard"] + 1]] += np.frombuffer(r["counts"], np.int64)
    size_b = len(_pair(path_a, path_b).size_b)
    a = index.keys // size_b
    most = np.zeros(int(a.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, a, counts)
    return ids.select("doc_id", "a", "b").mapInArrow(
        _look_up(sc.broadcast((index, counts, counts == most[a])), path_a, path_b),
        f"doc_id long, {_SHAPE}, n_best long, count_sum long",
    )


def _by_join(ids: DataFrame, path_a: str | None, path_b: str | None) -> DataFrame:
    size_b = len(_pair(path_a, path_b).size_b)
    rows = ids.select("row", "a", "b").mapInArrow(_link_rows(path_a, path_b), "row long, pair long, n long")
    counted = stage(rows.groupBy("pair").agg(F.count(F.lit(1)).alias("count")), "link-counts")
    owner = F.expr(f"pair div {size_b}").alias("id_a")
    most = counted.groupBy(owner).agg(F.max("count").alias("most"))
    known = counted.select("pair", "count", owner).join(most, "id_a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    sums = rows.join(known, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(F.lit(0))).alias("n_best"),
        F.sum(F.col("n") * F.col("count")).alias("count_sum"),
    )
    shapes = ids.mapInArrow(_shapes(path_a, path_b), f"row long, doc_id long, {_SHAPE}")
    zero = F.lit(0).cast("long")
    return shapes.join(sums, "row", "left").drop("row").withColumns(
        {"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)}
    )


def token_links(
    docs: DataFrame,
    path_a: str | None = None,
    path_b: str | None = None,
    held_pairs: int = HELD_PAIRS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of every row of ``docs(doc_id, text)``.

    A blank and the text are encoded by two vocabularies. Byte offsets at which tokens of both end cut them into groups,
    written as ``a1,a2|b1;a3|b2,b3``. Two tokens are linked if their bytes overlap; a pair of ids counts the documents of
    the corpus that hold it linked. ``count_sum`` adds the counts of a document's links, ``n_best`` are its links whose
    count is the highest of their first id, ties included.

    NULL and empty texts, and texts that a vocabulary does not give back byte by byte, have no tokens: zeros and an
    empty ``groups``. Repeated rows are documents of their own, rows without doc_id too; other columns are ignored.

    The pairs are bounded by the two vocabularies. Up to ``held_pairs`` of them the hash and the counts are broadcast;
    beyond, the pairs of each document are joined to their counts, with the same result.
    """
    ids = stage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(_encode(path_a, path_b), "doc_id long, a binary, b binary")
        .withColumn("row", F.monotonically_increasing_id()),
        "token-ids",
    )
    pairs = stage(ids.select("a", "b").mapInArrow(_pairs(path_a, path_b), "pair long").distinct(), "token-pairs")
    n = pairs.count()
    if n > held_pairs:
        return _by_join(ids, path_a, path_b)
    return _by_index(ids, pairs, n, path_a, path_b, fan_in)


def digests(found: DataFrame) -> DataFrame:
    """:func:`token_links` with the checksum of ``groups``, '' where a text has no tokens, in its place."""
    return found.withColumn(
        "groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    ).drop("groups")
