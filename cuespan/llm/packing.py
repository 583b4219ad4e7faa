"""Sum-of-squares packing of tokenised documents into fixed windows."""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import batch_of, column_of, one_thread, remembered, small_batches, texts_of

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)
_SQL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

# How the tokenizer file splits lower-case text, and the letter it has for each byte.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: A full stop or comma that ends a word after a letter is a part of its own.
_STOP = re.compile(rb"(?<=[a-z])[.,](?![^ \t\n\x0b\x0c\r])")
_PLAIN = regex.compile(r"[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+")


class WordTokens(dict):
    """Ids (little-endian, four bytes each) of a word between ASCII blanks, remembered; all are
    forgotten beyond ``limit`` words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words in order. Words of small ASCII letters go to the merge model as they are, other words of Latin letters, for which
    normalising is lower-casing, part by part; all others, and any that may hold a special token, go to the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = 1_200_000) -> None:
        from tokenizers import Tokenizer

        self.whole, self.limit = Tokenizer.from_file(path), limit
        self.model = Tokenizer(self.whole.model)
        self.parts: dict[str, bytes] = {}

    def learn(self, new: set[bytes]) -> None:
        plain, rest, split = [], [], []
        for w in new:
            if w.isalpha():  # ASCII letters, as bytes know no others
                (plain if w.islower() else rest).append(w)
                continue
            t = w.decode()
            if _PLAIN.fullmatch(t) and "<|" not in t:
                if t.isalpha() and t.islower():
                    plain.append(w)
                else:
                    split.append((w, _PARTS.findall(t.lower())))
            else:
                rest.append(w)
        self.encode(self, plain, plain)
        missing = list({p for _, ps in split for p in ps if p not in self.parts})
        self.encode(self.parts, missing, [p.encode() for p in missing])
        for w, ps in split:
            self[w] = self.parts[ps[0]] if len(ps) == 1 else b"".join(map(self.parts.__getitem__, ps))
        for w, e in zip(rest, self.whole.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            self[w] = struct.pack(f"<{len(e)}I", *e.ids)

    def encode(self, into: dict, names: list, words: list[bytes]) -> None:
        """Ids of ``words``, which the merge model takes as they are, under ``names``; thousands in one call."""
        for k in range(0, len(words), 20_000):
            e = self.model.encode([w.decode("latin-1").translate(_LETTERS) for w in words[k : k + 20_000]], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, "<u4").tobytes()
            ends = (4 * np.searchsorted(np.array(e.word_ids), np.arange(len(words[k : k + 20_000])), "right")).tolist()
            into.update(zip(names[k : k + 20_000], map(ids.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def ids(self, texts: list[bytes], step: int = 1000) -> Iterator[bytes]:
        """Ids of each text. Words that are new are learned for ``step`` texts at once."""
        for k in range(0, len(texts), step):
            # lower-casing and cut-off stops leave far fewer distinct words; ids are the same
            split = [(t if b"<|" in t else _STOP.sub(rb" \g<0>", t.lower())).split() for t in texts[k : k + step]]
            if len(self) > self.limit:
                self.clear()
                self.parts.clear()
            self.learn(set(itertools.filterfalse(self.__contains__, set(itertools.chain.from_iterable(split)))))
            for words in split:
                yield b"".join(map(self.__getitem__, words))


def word_tokens(path: str) -> WordTokens:
    one_thread()
    return remembered(("tokens", path), lambda: WordTokens(path))


class Packer:
    """Windows of one partition. ``level[h]`` counts the open windows that are filled up to ``h``."""

    def __init__(self, window: int, most_open: int) -> None:
        self.window, self.most_open = window, most_open
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = 0

    def add(self, doc: int | None, total: int, ids: bytes) -> Iterator[list]:
        """Finished windows, each a list of pieces (doc, start, total, ids)."""
        w, n, start = self.window, len(ids) // 4, 0
        while n - start >= w:
            yield [(doc, start, total, ids[4 * start : 4 * (start + w)])]
            start += w
        if n > start:
            yield from self._place((doc, start, total, ids[4 * start :]), n - start)

    def _place(self, piece: tuple, size: int) -> Iterator[list]:
        """Into the level with the least growth of the sum of squares; ties to the fullest level."""
        w, level = self.window, self.level
        top = w - size
        after = 2 * level[size : w + 1] + 1  # a window arrives at h + size ...
        after[top] = 0  # ... or is full, and no longer open
        cost = after - 2 * level[: top + 1] + 1  # and leaves h
        cost[level[: top + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = after[0]  # a new window leaves no level
        h = top - int(np.argmin(cost[::-1]))
        pieces = self.open[h].pop() if h else []
        if h:
            level[h] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if h + size == w:
            yield pieces
            return
        self.open[h + size].append(pieces)
        level[h + size] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            yield from self.close(last=False)

    def close(self, last: bool = True) -> Iterator[list]:
        """Cut the pieces of open windows, fullest first, into full ones. What is left stays open, or at
        the end goes to windows of the powers of two that make up its length, which need no padding."""
        pieces = [p for h in range(self.window - 1, 0, -1) for bin_ in self.open[h] for p in bin_]
        self.level[:] = 0
        self.open = [[] for _ in range(self.window)]
        self.n_open = 0
        left = sum(len(p[3]) // 4 for p in pieces)
        now, room = [], self.window
        if left < room and last:
            room = 1 << (left.bit_length() - 1) if left else 0
        for doc, start, total, ids in pieces:
            while ids:
                take = min(room, len(ids) // 4)
                now.append((doc, start, total, ids[: 4 * take]))
                start, ids, room, left = start + take, ids[4 * take :], room - take, left - take
                if not room:
                    yield now
                    now, room = [], self.window
                    if left < room and last:
                        room = 1 << (left.bit_length() - 1) if left else 0
        if now:
            h = self.window - room
            self.open[h].append(now)
            self.level[h] += 1
            self.n_open = 1


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, most_open: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document (its ids, then ``end_id``) into sequences of at most ``window`` ids.

    One row per piece: where it starts in its document, its length, the document's length, the
    sequence, the offset in it, and the ids (little-endian, four bytes each). A document longer than
    the window gives full windows first; only its rest is placed: online, into the fill level that
    minimises the sum over levels of the squared number of partially filled windows. Beyond
    ``most_open`` open windows, and at the end of a partition, open windows are merged by cutting,
    so that a partition holds a bounded number of ids and ends without padding.

    Each partition packs on its own: no shuffle, nothing is gathered, and a lost task repeats its
    own rows in scan order and gives the same sequences. Null text: empty, so one id. Null ids,
    ties and repeated rows: each row is a document of its own. An empty table gives no row. Only the
    two named columns are read.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packer = word_tokens(tokenizer), Packer(window, most_open)
        end = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def emit(finished: Iterator[list]) -> None:
            nonlocal number
            for pieces in finished:
                offset = 0
                for doc, start, total, ids in pieces:
                    rows.append((doc, start, len(ids) // 4, total, number, offset, ids))
                    offset += len(ids) // 4
                number += 1

        def flush() -> pa.RecordBatch:
            out = batch_of(PIECES, zip(*rows, strict=True))
            rows.clear()
            return out

        for batch in batches:
            texts = texts_of(column_of(batch, text_col))
            for doc, ids in zip(column_of(batch, id_col).to_pylist(), known.ids(texts), strict=True):
                ids += end
                emit(packer.add(doc, len(ids) // 4, ids))
                if len(rows) >= 4000:
                    yield flush()
        emit(packer.close())
        if rows:
            yield flush()

    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col)).mapInArrow(run, _SQL)
