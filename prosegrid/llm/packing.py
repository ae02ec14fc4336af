"""Packing token sequences: vector bin packing with the dot-product heuristic.

A piece is a vector of tokens, segments (one) and loss-bearing tokens, and a
sequence a bin with a limit on each.  An open sequence takes the waiting piece
whose vector has the largest dot product with the room that is left, of those
that fit, until none fits.  Pieces longer than a sequence are cut beforehand.
Sequences that are neither full nor a power of two long are then completed by
cutting pieces of the emptiest ones, so only powers of two remain unfilled and
nothing is padded.

Every task packs the documents it reads, in batches of ``WAITING`` pieces;
a sequence's id is made of the task's number and a counter.  A token lies in
one piece.  Nothing is shuffled.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.blocks import KEPT, code_points, lean, mix, powers, text_blocks

CAPACITY = 1024
SEGMENTS = 256
#: Pieces that a task packs at a time.
WAITING = 2048
END_ID = 0
_SLOTS = 1 << 20
#: Words that an encoder keeps (some 110 MB) before it starts anew; a worker holds it from task to task.
_MOST = 1 << 20


class Encoder:
    """Token ids of whole texts by a byte-level BPE of ``tokenizers``, for a block of texts at a time.

    A byte-level BPE first cuts a text into words and then encodes each by
    itself.  Here the cutting is array arithmetic, every distinct word is
    encoded once by the tokenizer, and its ids are kept.  Which characters
    are letters, numbers or white space is asked from the tokenizer too.
    Words are looked up by a hash and then compared character by character.
    Texts that hold an added token, or a word whose hash another word has,
    go to the tokenizer whole, so ids are always its own.
    """

    LETTER, NUMBER, OTHER, SPACE, UNKNOWN = 1, 2, 3, 4, 0

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.kinds = np.zeros(0x110000, np.uint8)
        self._forget()

    def _forget(self) -> None:
        # Each word has one of two places; who finds both taken puts the second one's word out.
        self.keys, self.words = np.zeros((2, _SLOTS), np.uint64), np.zeros((2, _SLOTS), np.int32)
        self.known = 0
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.points, self.written = np.empty(1 << 16, np.uint32), 0
        self.begin, self.long = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _kind(self, c: str) -> int:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for probe, kind in (("a", self.LETTER), ("1", self.NUMBER), ("!", self.OTHER)):
            if len(cut(probe + c)) == 1:
                return kind
        return self.SPACE

    def _starts(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where words start: ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|S+(?!\\S)|S+`` over each text."""
        kind = self.kinds[points]
        if not kind.all():
            for p in np.unique(points[kind == 0]).tolist():
                self.kinds[p] = self._kind(chr(p))
            kind = self.kinds[points]
        n = len(points)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        end = first[1:]
        edge = first[:-1] | np.concatenate(([False], kind[1:] != kind[:-1]))
        space = kind == self.SPACE
        blank = points == 0x20
        follows = np.concatenate(([False], blank[:-1])) & ~first[:-1]
        start = edge & (space | ~follows)
        # The last white space before a word goes with it if it is a blank, else it is a word.
        start |= space & ~end & np.concatenate((~space[1:], [False]))
        for i in np.flatnonzero(start & (points == 0x27) & ~end).tolist():
            stop = int(offsets[np.searchsorted(offsets, i, "right")])
            tail = "".join(map(chr, points[i + 1 : min(i + 3, stop)].tolist()))
            took = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail in ("re", "ve", "ll") else 0
            if took:
                start[i + 1] = False
                if i + 1 + took < stop:
                    start[i + 1 + took] = True
        return np.flatnonzero(start)

    def _learn(self, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, text: str, points: np.ndarray) -> np.ndarray:
        """Numbers of words that are not known yet; each is encoded once."""
        keys, spots, back = np.unique(keys, return_index=True, return_inverse=True)
        words = [text[a:b] for a, b in zip(lo[spots].tolist(), hi[spots].tolist())]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        base = self.known
        while base + len(keys) > len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
            self.size = np.concatenate((self.size, np.zeros_like(self.size)))
            self.begin = np.concatenate((self.begin, np.zeros_like(self.begin)))
            self.long = np.concatenate((self.long, np.zeros_like(self.long)))
        long = hi[spots] - lo[spots]
        while self.written + int(long.sum()) > len(self.points):
            self.points = np.concatenate((self.points, np.empty_like(self.points)))
        ends = np.cumsum(long)
        its = points[np.repeat(lo[spots] - (ends - long), long) + np.arange(int(ends[-1]))]
        self.points[self.written : self.written + len(its)] = its
        self.ids[self.used : self.used + len(flat)] = flat
        mine = slice(base, base + len(keys))
        self.begin[mine], self.long[mine] = self.written + ends - long, long
        self.at[mine], self.size[mine] = self.used + np.cumsum(sizes) - sizes, sizes
        self.written += len(its)
        self.used += len(flat)
        self.known += len(keys)
        number = np.arange(base, self.known, dtype=np.int32)
        first, second = self._places(keys)
        free = self.keys[0, first] == 0
        self.keys[0, first[free]], self.words[0, first[free]] = keys[free], number[free]
        full = self.keys[0, first] != keys
        self.keys[1, second[full]], self.words[1, second[full]] = keys[full], number[full]
        return number[back]

    @staticmethod
    def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (keys >> np.uint64(44)).astype(np.int64), (keys >> np.uint64(22)).astype(np.int64) & (_SLOTS - 1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A block of UTF-8 texts -> all ids, and offsets of the texts among them."""
        points, offsets, text = code_points(data, offsets)
        if not len(points):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.known > _MOST:
            self._forget()
        lo = self._starts(points, offsets)
        hi = np.append(lo[1:], len(points))
        up, down = powers(len(points) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], dtype=np.uint64)))
        keys = mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64)) | np.uint64(1)
        first, second = self._places(keys)
        number = self.words[0, first].astype(np.int64)
        other = np.flatnonzero(self.keys[0, first] != keys)
        if len(other):
            number[other] = self.words[1, second[other]]
            miss = other[self.keys[1, second[other]] != keys[other]]
            if len(miss):
                number[miss] = self._learn(keys[miss], lo[miss], hi[miss], text, points)
        size = self.size[number].astype(np.int64)
        ends = np.cumsum(size)
        places = np.repeat(self.at[number] - (ends - size), size) + np.arange(int(ends[-1]))
        bound = np.concatenate(([0], ends))[np.searchsorted(lo, offsets)]
        whole = self._not_by_words(points, offsets, text, lo, hi, number)
        if not whole:
            return self.ids[places], bound
        ids = [self.ids[places[bound[i] : bound[i + 1]]] for i in range(len(bound) - 1)]
        for i in whole:
            ids[i] = np.array(self.tokenizer.encode(text[offsets[i] : offsets[i + 1]], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(ids), np.concatenate(([0], np.cumsum([len(x) for x in ids])))

    def _not_by_words(self, points, offsets, text: str, lo, hi, number) -> list[int]:
        """Texts with an added token, or a word that is not the one found for its hash."""
        odd = set()
        for token in self.added:
            at = text.find(token)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(token) <= offsets[i + 1]:
                    odd.add(i)
                    at = text.find(token, int(offsets[i + 1]))
                else:
                    at = text.find(token, at + 1)
        long = hi - lo
        fits = self.long[number] == long
        if fits.all():  # words follow one another without a gap
            fits = self.points[np.repeat(self.begin[number] - lo, long) + np.arange(len(points))] == points
            wrong = np.flatnonzero(~fits)
        else:
            some, size = np.flatnonzero(fits), long[fits]
            inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            here = np.repeat(lo[some], size) + inside
            same = self.points[np.repeat(self.begin[number[some]], size) + inside] == points[here]
            wrong = np.concatenate((lo[~fits], here[~same]))
        odd.update((np.searchsorted(offsets, wrong, "right") - 1).tolist())
        return sorted(odd)


_ENCODERS: dict[str, Encoder] = KEPT.setdefault("encoders", {})


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def power_below(n: int) -> int:
    return 1 << (n.bit_length() - 1)


class Piece:
    """Tokens ``[start, start + length)`` of a document, loss-bearing from its token ``prompt`` on."""

    __slots__ = ("doc", "start", "length", "prompt")

    def __init__(self, doc, start: int, length: int, prompt: int):
        self.doc, self.start, self.length, self.prompt = doc, start, length, prompt

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.prompt))

    def fitting(self, tokens: int, loss: int) -> int:
        """How many of its first tokens fit."""
        return min(self.length, tokens, max(0, self.prompt - self.start) + loss)

    def cut(self, n: int) -> tuple["Piece", "Piece | None"]:
        if n >= self.length:
            return self, None
        return Piece(self.doc, self.start, n, self.prompt), Piece(self.doc, self.start + n, self.length - n, self.prompt)


class Packer:
    """Packs pieces as they come; ``add`` and ``close`` return finished sequences, lists of pieces."""

    def __init__(self, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, waiting: int = WAITING):
        if capacity < 1 or segments < 1 or (loss is not None and loss < 1):
            raise ValueError("limits are positive")
        self.capacity, self.segments, self.waiting = capacity, segments, waiting
        self.loss = capacity if loss is None else loss
        self.pieces: list[Piece] = []

    def add(self, piece: Piece) -> list[list[Piece]]:
        done = []
        rest: Piece | None = piece
        while rest is not None and (rest.length >= self.capacity or rest.loss > self.loss):
            n = rest.fitting(self.capacity, self.loss)
            if n < self.capacity:
                n = power_below(n)
            head, rest = rest.cut(n)
            done.append([head])
        if rest is not None:
            self.pieces.append(rest)
        if len(self.pieces) >= self.waiting:
            done += self._pack(False)
        return done

    def close(self) -> list[list[Piece]]:
        return self._pack(True)

    def _place(self) -> list[list[Piece]]:
        """The dot-product heuristic over the waiting pieces."""
        pieces, self.pieces = self.pieces, []
        whole = np.array([self.capacity, self.segments, self.loss], np.int64)
        size = np.array([(p.length, 1, p.loss) for p in pieces], np.int64).reshape(-1, 3)
        scaled = size / whole
        left, bins = np.arange(len(pieces)), []
        while len(left):
            room, mine = whole.copy(), []
            while len(left):
                fits = (size[left] <= room).all(1)
                if not fits.any():
                    break
                score = np.where(fits, scaled[left] @ (room / whole), -1.0)
                i = int(score.argmax())
                mine.append(pieces[left[i]])
                room -= size[left[i]]
                left = np.delete(left, i)
            bins.append(mine)
        return bins

    def _room(self, mine: list[Piece]) -> tuple[int, int]:
        return self.capacity - sum(p.length for p in mine), self.loss - sum(p.loss for p in mine)

    def _even(self, mine: list[Piece]) -> tuple[list[Piece], list[Piece]]:
        """The first part of a sequence whose length is a power of two, and the rest of its pieces."""
        goal = power_below(sum(p.length for p in mine))
        out, rest = [], []
        for p in mine:
            if goal:
                head, tail = p.cut(goal)
                goal -= head.length
                out.append(head)
                rest += [tail] if tail is not None else []
            else:
                rest.append(p)
        return out, rest

    def _pack(self, last: bool) -> list[list[Piece]]:
        done, short = [], []
        for mine in self._place():
            total = sum(p.length for p in mine)
            (done if total == self.capacity or total & (total - 1) == 0 else short).append(mine)
        if not last:
            done, again = [m for m in done if sum(p.length for p in m) == self.capacity], [
                m for m in done if sum(p.length for p in m) != self.capacity
            ]
            short += again
        short.sort(key=lambda m: sum(p.length for p in m))
        while len(short) > 1:
            mine = short.pop()
            tokens, loss = self._room(mine)
            while tokens and len(short) and len(mine) < self.segments:
                donor = short[0]
                n = donor[-1].fitting(tokens, loss)
                if not n:
                    break
                head, tail = donor[-1].cut(n)
                mine.append(head)
                donor.pop()
                if tail is not None:
                    donor.append(tail)
                if not donor:
                    short.pop(0)
                tokens, loss = self._room(mine)
            if tokens:
                mine, rest = self._even(mine)
                self.pieces += rest
            done.append(mine)
        for mine in short:
            self.pieces += mine
        while last and self.pieces:
            mine, self.pieces = self.pieces[: self.segments], self.pieces[self.segments :]
            while sum(p.loss for p in mine) > self.loss or sum(p.length for p in mine) > self.capacity:
                self.pieces.insert(0, mine.pop())
            mine, rest = self._even(mine)
            done.append(mine)
            self.pieces = rest + self.pieces
        return done


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    capacity: int = CAPACITY,
    segments: int = SEGMENTS,
    loss: int | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """``(id, start, length, ids, doc_tokens, loss_tokens, sequence_id, offset)``, one row for each piece.

    A document is the ids of its whole text and ``end_id``; ``ids`` are the
    piece's, little-endian with four bytes each.  ``prompt_col`` counts the
    first tokens of a document that bear no loss (default: none).  Sequences
    hold at most ``capacity`` tokens, ``segments`` pieces and ``loss``
    loss-bearing tokens, and are ``capacity`` or a power of two long.

    Nulls: a null text is an empty one, which is its ``end_id`` alone; a null
    prompt is 0; null ids and repeated rows are packed like others.  An empty
    table has no pieces.  Other columns of ``docs`` are not read.
    """
    names = ["id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"]

    @partial(lean, keeps="encoders")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, number = encoder(tokenizer), Packer(capacity, segments, loss), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held = 0

        def put(sequences: list[list[Piece]]) -> None:
            nonlocal number, held
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    key, ids = p.doc
                    mine = ids[p.start : p.start + p.length].tobytes()
                    rows.append((key, p.start, p.length, mine, len(ids), p.loss, number, offset))
                    offset += p.length
                    held += len(mine)
                number += 1

        def flush() -> pa.RecordBatch:
            nonlocal held
            types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows.clear()
            held = 0
            return out

        for batch in batches:
            keys, prompts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b, data, offsets in text_blocks(batch.column(1)):
                ids, bound = enc.encode(data, offsets)
                for i in range(b - a):
                    own = np.append(ids[bound[i] : bound[i + 1]], np.uint32(end_id)).astype("<u4")
                    put(packer.add(Piece((keys[a + i], own), 0, len(own), max(0, prompts[a + i]))))
                if held > 1 << 22:
                    yield flush()
        put(packer.close())
        if rows:
            yield flush()

    prompt = F.coalesce(F.col(prompt_col).cast("long"), F.lit(0)) if prompt_col else F.lit(0)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"), prompt.cast("long").alias("prompt")
    )
    return rows.mapInArrow(
        run,
        "id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long",
    )
