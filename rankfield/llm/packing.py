"""Best-fit packing by the sum-of-squares rule.

Token ids of every document are cut into pieces of one sequence's length at most. Pieces are dealt to
packers by hash and placed from long to short: among the open bins that a piece fits, it goes where the
sum over residual gaps of the squared number of open bins with that gap becomes smallest; only where no
open bin fits, a new one is opened.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .wordhash import U, in_worker, mix, powers, slices

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
PACKER_PIECES = 4_000  # pieces of a packer, about: some thousand sequences, of which one stays open
PARTITIONS = 20_000  # tasks the packers are dealt to, at most
CACHED_WORDS = 1_500_000  # of a Python worker: about 100 MB
_SLOTS = 22  # bits of the table that finds them

_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def tokenizer_path() -> str:
    """The public vocabulary's place on this machine; it is installed wherever tasks run."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _tables():
    """For every code point: its class for word splitting, its lower case, and whether only the
    tokenizer itself can lower it (its lower case depends on context or has several characters)."""
    kind = np.full(0x110000, _OTHER, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    odd = np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        category = unicodedata.category(ch)
        if category[0] == "L":
            kind[c] = _LETTER
        elif category[0] == "N":
            kind[c] = _DIGIT
        low = ch.lower() if not 0xD800 <= c < 0xE000 else ch
        if low != ch:
            if len(low) == 1:
                lower[c] = ord(low)
            else:
                odd[c] = True
    kind[_SPACES] = _SPACE
    odd[0x3A3] = True
    return kind, lower, odd


class Encoder:
    """Token ids of texts as the tokenizer gives them, with the ids of a word looked up by its hash.

    The vocabulary's splitter cuts a text into words that are encoded one by one, so equal words have
    equal ids. Texts that hold a special token's string or letters with irregular lower case go
    through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind, self.lower, self.odd = in_worker("code-points", _tables)
        self.forget()

    def forget(self) -> None:
        self.key = np.zeros(1 << _SLOTS, U)  # hash of the word in each slot
        self.word = np.full(1 << _SLOTS, -1, np.int32)  # its number, -1 if the slot is free
        self.size = np.zeros(1 << 16, np.uint8)  # ids of each word
        self.start = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 17, np.uint32)
        self.words = self.used = 0

    def plain(self, text: str) -> bool:
        return not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        out: list = [None] * len(texts)
        fast = []
        for k, text in enumerate(texts):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            if "<|" in text and not self.plain(texts[k]):
                out[k] = self._whole(texts[k])
            else:
                fast.append((k, text))
        if fast:
            # A blank after each text keeps words apart; blanks have no ids.
            codes = np.frombuffer("".join(t + " " for _, t in fast).encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.concatenate([[0], np.cumsum([len(t) + 1 for _, t in fast])])
            odd = np.zeros(len(codes), bool) if codes.max(initial=0) < 128 else self.odd[codes]
            low = self.lower[codes]
            start, end = self._words(self.kind[low], low)
            ids, first = self._look_up(low, start, end)
            bound = first[np.searchsorted(start, at)]
            for j, (k, _) in enumerate(fast):
                if odd[at[j] : at[j + 1]].any():
                    out[k] = self._whole(texts[k])
                else:
                    out[k] = ids[bound[j] : bound[j + 1]]
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _words(self, kind: np.ndarray, low: np.ndarray):
        """Bounds of letter runs, single digits, runs of other characters, and English endings."""
        n = len(kind)
        cut = np.ones(n + 1, bool)
        cut[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        mark = np.flatnonzero(low == 39)
        mark = mark[cut[mark]]  # an apostrophe that begins a run
        if len(mark):
            follow = np.concatenate([low, np.zeros(3, np.uint32)])
            one, two = follow[mark + 1], follow[mark + 2]
            pair = one.astype(np.int64) * 256 + np.minimum(two, 255)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
            size = np.where(short, 2, np.where(long, 3, 0))
            mark, size = mark[size > 0], size[size > 0]
            cut[mark + 1] = False
            cut[(mark + 2)[size == 3]] = False
            cut[mark + size] = True
        start = np.flatnonzero(cut)
        start, end = start[:-1], start[1:]
        word = kind[start] != _SPACE
        return start[word], end[word]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words by hash, -1 for unknown ones."""
        slot = (h >> U(64 - _SLOTS)).astype(np.int64)
        out = self.word[slot]
        wrong = np.flatnonzero((out >= 0) & (self.key[slot] != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << _SLOTS) - 1)
            out[wrong] = self.word[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.key[slot[wrong]] != h[wrong])]
        return out

    def _add(self, h: np.ndarray, text: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(text, add_special_tokens=False)]
        size = np.array([len(g) for g in got], np.int64)
        if size.max() > 255:
            self.size = self.size.astype(np.int64)
        flat = np.array([i for g in got for i in g], np.uint32)
        while self.words + len(h) > len(self.size):
            self.size, self.start = np.append(self.size, self.size * 0), np.append(self.start, self.start * 0)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, self.ids * 0)
        number = np.arange(self.words, self.words + len(h))
        self.size[number], self.start[number] = size, self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(flat)] = flat
        self.words, self.used = self.words + len(h), self.used + len(flat)
        slot = (h >> U(64 - _SLOTS)).astype(np.int64)
        while len(h):
            free = self.word[slot] < 0
            self.word[slot[free]] = number[free]  # of several, the last one gets the slot
            placed = self.word[slot] == number
            self.key[slot[placed]] = h[placed]
            h, number = h[~placed], number[~placed]
            slot = (slot[~placed] + 1) & ((1 << _SLOTS) - 1)

    def _look_up(self, low: np.ndarray, start: np.ndarray, end: np.ndarray):
        """All ids in a row, and where the ids of each word begin (one more entry than words)."""
        up, down = powers(len(low) + 1)
        p = np.zeros(len(low) + 1, U)
        np.cumsum(mix(low.astype(U) + U(1)) * up[: len(low)], out=p[1:])
        h = mix((p[end] - p[start]) * down[start] + (end - start).astype(U))
        word = self._find(h)
        if (word < 0).any():
            missing = np.flatnonzero(word < 0)
            fresh, first = np.unique(h[missing], return_index=True)
            if self.words + len(fresh) > CACHED_WORDS:
                self.forget()
                missing = np.arange(len(h))
                fresh, first = np.unique(h, return_index=True)
            some = missing[first]
            self._add(fresh, [low[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(start[some], end[some])])
            word = self._find(h)
        begin, size = self.start[word], self.size[word].astype(np.int64)
        first_id = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(first_id[-1]) + np.repeat(begin - first_id[:-1], size)
        return self.ids[take], first_id


def _pieces(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = path or tokenizer_path()
        encoder = in_worker(f"encoder {place}", lambda: Encoder(place))
        end = np.array([END_ID], np.uint32)
        for part in slices(batches, "text", 1 << 19):
            texts = part.column("text").fill_null("").to_pylist()
            doc = part.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for k, ids in enumerate(encoder.encode(texts)):
                ids = np.concatenate([ids, end])
                for number, start in enumerate(range(0, len(ids), capacity)):
                    piece = ids[start : start + capacity]
                    rows.append((doc[k], number, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes())))
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def place_all(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every length, in order, by the sum-of-squares rule among open bins.

    Taking a bin of gap g for a piece of size s changes the sum of squared counts by
    2 * (count[g - s] - count[g]) + 2, or by 1 - 2 * count[g] where the bin is filled up: gaps of full
    bins are not counted. Ties take the smallest gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    made = 0
    for k, s in enumerate(lengths.tolist()):
        if s == capacity:
            where[k], offset[k] = made, 0
            made += 1
            continue
        fits = count[s:]
        # delta / 2, with the filled-up bin's 1 - 2n as (2 - 2n) / 2 - 1/2
        delta = (count[: capacity + 1 - s] - fits) * 2 + 2
        delta[0] = 1 - 2 * fits[0]
        delta[fits == 0] = np.iinfo(np.int64).max
        g = int(delta.argmin()) + s
        if count[g]:
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            b, g = made, capacity
            made += 1
        where[k], offset[k] = b, capacity - g
        left = g - s
        if left:
            open_bins[left].append(b)
            count[left] += 1
    return where, offset


def pack(
    docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, packer_pieces: int = PACKER_PIECES
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs(doc_id, text)``.

    A document is its ids followed by id 1, so NULL and empty texts are one id. Documents of more than
    ``capacity`` ids are cut; pieces are placed gapless from offset 0 of their sequence. Repeated rows are
    documents of their own; rows without doc_id are packed too. Other columns are ignored.

    Pieces are dealt to packers of about ``packer_pieces`` by hash, however often a doc_id repeats; each
    packer leaves at most a few sequences unfilled. A task takes its packers one after the other and holds
    the numbers of one packer's pieces, no ids.
    """
    pieces = stage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"
        ),
        "pieces",
    )
    total = pieces.count()
    packers = max(1, -(-total // packer_pieces))
    # The row number tells repeated rows apart; the pieces are on disk, so it stays when a task is run again.
    number = F.monotonically_increasing_id()
    dealt = pieces.withColumn("packer", F.pmod(F.xxhash64("doc_id", "piece", number), F.lit(packers)).cast("int"))

    def placed(table: pa.Table, packer: int) -> Iterator[pa.RecordBatch]:
        where, offset = place_all(np.asarray(table.column("length")), capacity)
        table = table.drop_columns(["packer"]).append_column("sequence_id", pa.array((packer << 32) + where))
        yield from table.append_column("offset", pa.array(offset)).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A packer's pieces are held until the next packer's begin."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            packer = np.asarray(batch.column("packer"))
            turn = np.flatnonzero(np.diff(packer)) + 1
            for a, b in zip(np.concatenate([[0], turn]), np.concatenate([turn, [len(packer)]])):
                if a == b:
                    continue
                if held and held[0].column("packer")[0].as_py() != packer[a]:
                    yield from placed(pa.Table.from_batches(held), held[0].column("packer")[0].as_py())
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from placed(pa.Table.from_batches(held), held[0].column("packer")[0].as_py())

    return (
        dealt.repartition(min(packers, PARTITIONS), "packer")
        .sortWithinPartitions("packer", F.desc("length"), "doc_id", "piece", "start")
        .mapInArrow(
            run,
            "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
        )
    )
