"""Packing of token sequences into windows by minimum bin slack.

Every document is cut into full windows and one remainder. Remainders wait in a bounded pool; each window
takes the largest waiting remainder and then the multiset of others whose lengths come closest to the rest of
the window: a subset-sum dynamic programme whose reachable sums are the bits of one integer, with the counts of
each length found by going back through it. A gap that is left is filled by cutting one more remainder. What
is left at the end of a partition becomes sequences of power-of-two lengths, which need no padding either.
Partitions are packed on their own, so no token is shuffled and a lost task is simply run again.

Edge cases: a null text is an empty document, which holds the end id alone; repeated rows are packed each;
an empty table gives no pieces; null ids stay null; further columns are ignored; a document of any length is cut.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, parts, pick
from .token_counts import byte_letters
from .worker import remembered

#: Remainders that wait at once, and how many of them stay to be combined with later ones.
POOL, KEEP = 768, 384
#: Words that a worker remembers, texts whose words are looked up together, and pieces that it returns together.
REMEMBERED, TOGETHER, PIECES = 400_000, 64, 500


def closest(counts: dict[int, int], target: int) -> dict[int, int]:
    """How many of each length to take so that the sum is as near below target as can be. counts: what there is of each length."""
    reach, steps, want = 1, [], 1 << target
    mask = (want << 1) - 1
    for length in sorted(counts, reverse=True):
        if length > target:
            continue
        have, part = min(counts[length], target // length), 1
        while have:
            part = min(part, have)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            have -= part
            part *= 2
        if reach & want:
            break
    at, taken = reach.bit_length() - 1, defaultdict(int)
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            taken[length] += part
            at -= length * part
    return taken


class Packer:
    """Packs (key, length) items into sequences; yields (sequence, [(key, start, length)]) with every position of every item once."""

    def __init__(self, capacity: int = 4096):
        self.capacity = capacity
        self.pool: dict[int, deque] = defaultdict(deque)
        self.waiting = self.made = 0

    def full(self) -> int:
        """The number of a window that needs no packing."""
        return self._next()

    def _next(self) -> int:
        self.made += 1
        return self.made - 1

    def _put(self, key, start: int, length: int) -> None:
        self.pool[length].append((key, start, length))
        self.waiting += 1

    def _take(self, length: int):
        item = self.pool[length].popleft()
        if not self.pool[length]:
            del self.pool[length]
        self.waiting -= 1
        return item

    def _window(self) -> list:
        items = [self._take(max(self.pool))]
        room = self.capacity - items[0][2]
        if room and self.pool:
            for length, n in closest({k: len(v) for k, v in self.pool.items()}, room).items():
                items += [self._take(length) for _ in range(n)]
        room = self.capacity - sum(i[2] for i in items)
        if room and self.pool:
            key, start, length = self._take(min(k for k in self.pool if k > room))
            items.append((key, start, room))
            self._put(key, start + room, length - room)
        return items

    def add(self, key, length: int) -> Iterator[tuple[int, list]]:
        start = 0
        while length - start >= self.capacity:
            yield self._next(), [(key, start, self.capacity)]
            start += self.capacity
        if length > start:
            self._put(key, start, length - start)
        if self.waiting > POOL:
            while self.waiting > KEEP:
                yield self._next(), self._window()

    def end(self) -> Iterator[tuple[int, list]]:
        while sum(k * len(v) for k, v in self.pool.items()) >= self.capacity:
            yield self._next(), self._window()
        rest = deque(self._take(k) for k in sorted(self.pool, reverse=True) for _ in range(len(self.pool[k])))
        left = sum(i[2] for i in rest)
        while left:
            room, items = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                key, start, length = rest.popleft()
                take = min(room, length)
                items.append((key, start, take))
                if take < length:
                    rest.appendleft((key, start + take, length - take))
                room -= take
            yield self._next(), items


_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-įı-ňŊ-ž‐-‧‰-⁞€]*")
_LETTER = "a-zªµºß-öø-ſ"
_NUMBER = "0-9²³¹¼½¾"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")


class WordIds:
    """Little-endian 32-bit ids of lower-case words, from the tokenizer library, remembered by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Ids of words that stand alone: the library's model on their byte letters, since nothing is left to normalise or to split."""
        model, letters = self.library.model, self.letters
        for word in words:
            said = word if word.isascii() else "".join([letters[b] for b in word.encode()])
            ids = [t.id for t in model.tokenize(said)]
            self.known[word] = struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text. Words are independent in this vocabulary, so a plain text is the ids of its words; any other goes to the library whole."""
        for first in range(0, len(texts), TOGETHER):
            part = texts[first : first + TOGETHER]
            lists = [_SPLIT.findall(t.lower()) if _PLAIN.fullmatch(t) and not any(s in t for s in self.special) else None for t in part]
            new = set().union(*(x for x in lists if x)).difference(self.known)
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set().union(*(x for x in lists if x))
            self.learn(list(new))
            for text, words in zip(part, lists):
                yield self.whole(text) if words is None else b"".join(map(self.known.__getitem__, words))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids its token ids."""
    kind = docs.select(docs[f"`{id_col}`"].alias("doc_id")).schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    last = struct.pack("<I", end_id)

    def make():
        words = remembered("word ids", tokenizer, make=lambda: WordIds(tokenizer))
        base = TaskContext.get().partitionId() << 40

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = Packer(capacity)
            rows: list[tuple] = []
            ids_type = None

            def note(sequence: int, items: list) -> None:
                offset = 0
                for (doc, size, before, data), start, length in items:
                    own = data[4 * start : 4 * (start + length)]
                    rows.append((doc, before + start, length, zlib.crc32(own), size, base | sequence, offset, own if with_ids else None))
                    offset += length

            def out() -> pa.RecordBatch:
                cols = list(zip(*rows)) if rows else [()] * 8
                arrays = [pa.array(cols[0], ids_type), *(pa.array(c, pa.int64()) for c in cols[1:7])]
                if with_ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in cols[7])], dtype=np.int32)
                    arrays.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(cols[7]), "<i4")))
                rows.clear()
                return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

            for b in parts(batches, 1000, 1):
                ids_type = b.column(0).type
                texts = [t or "" for t in b.column(1).to_pylist()]
                for doc, data in zip(b.column(0).to_pylist(), words.of(texts)):
                    data += last
                    size = len(data) // 4
                    # Full windows go out at once; the pool holds remainders only, of less than a window each.
                    full = size - size % capacity
                    for at in range(0, full, capacity):
                        note(packer.full(), [((doc, size, at, data[4 * at : 4 * (at + capacity)]), 0, capacity)])
                        if len(rows) >= PIECES:
                            yield out()
                    if size > full:
                        for made in packer.add((doc, size, full, data[4 * full :]), size - full):
                            note(*made)
                    if len(rows) >= PIECES:
                        yield out()
            for made in packer.end():
                note(*made)
            if rows:
                yield out()

        return run

    return arrow_map(pick(docs, doc_id=id_col, text=text_col), make, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2, with_ids=False)
