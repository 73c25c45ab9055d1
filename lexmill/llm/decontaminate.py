"""Benchmark decontamination: which documents hold a benchmark item, up to edits.

Texts are read as lower-case runs of letters and digits, joined by one space, and laid end to end. Copies are sought in item-sized
windows of characters, on every diagonal of text and item:

1. CGK embedding. A walk reads a string through a pointer that stays or moves on by a random bit for the step and the character read, so
   that edit distance becomes Hamming distance between walks, and two walks that an edit set apart can meet again. A window is embedded
   anew from each of its characters, because over a whole window an edit in every word would part any walk for good. The random bits repeat
   after PERIOD steps; a walk of 2n steps is then two of n steps, and all walks of a text are made by doubling, a few operations a character.
2. Bit samples. The steps of a walk from one place, hashed, are a sample of the window's embedding. Samples of the items' places are stored in
   sorted arrays; each of WALKS walks is a repetition. Agreeing samples vote for an item and a band of diagonals, which names an item-sized window.
3. Candidates are windows with agreeing samples at NEED different places (one for items under SHORT characters). A stretch of 64 characters about
   the agreement is compared first, many windows at a time (bit-parallel edit distance); at most LOCAL of it may be edited.
4. Exact check: the least edit distance between the whole item and any substring of the document about the window.

Recall is measured against brute force in the tests: with one letter changed in every word, in every second or every third, and with
random edits of 5, 10, 15 and 20 % of the characters. Only step 4 decides what is found, so nothing is found wrongly.

Items under 48 characters are sampled by walks of half the steps, and those under 16 by walks of a quarter. Scripts without spaces are no
special case, as nothing here depends on words. Documents are only scanned: items are broadcast a block at a time, each bounded in bytes.

Edge cases: null and empty texts, and items without letters and digits, match nothing; items of fewer than 5 characters must be there
exactly, and between word ends where their script has spaces; rows that repeat an id are checked each; items that repeat a text or an id match
each; items with a null id count as any other (their item_id is null); empty tables give an empty table; null ids stay null; further columns
are ignored (or passed through by drop_contaminated).
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, parts, pick, seeded
from .worker import remembered

#: Edits, as a share of the item's characters, up to which a passage is a copy.
SHARE = 0.2
#: Walks, steps after which their random bits repeat, and steps of a sample (a power of two times as many).
WALKS, PERIOD, STEPS = 2, 4, 16
#: Places of a window that must agree, of an item of SHORT characters or more (one place of any other); characters within which agreeing places count once.
NEED, SHORT, APART = 2, 250, 8
#: Items under so many characters are sampled by walks of so many steps.
TIERS = {16: 4, 48: 8}
#: Diagonals of a band; a window is two of them.
BAND = 16
#: Characters of a stretch, edits that it may have as a share of them, and characters that it may be off its diagonals.
STRETCH, LOCAL, OFF = 64, 0.36, 12
#: Bytes of items that are broadcast at once; characters of texts that are laid end to end; places walked from, and stretches compared, at once.
ITEM_BYTES, LAID, PLACES, TOGETHER = 8 << 20, 1 << 20, 1 << 15, 8192

_WORD = re.compile(r"[^\W_]+")
#: Scripts that are written without spaces between words.
_UNSPACED = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


@cache
def letters() -> np.ndarray:
    """For every code point, whether it is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The normal texts end to end as one byte a character (its low byte; 32 between words, 0 behind a text), and where each text ends."""
    joined = "\0".join([t.replace("\0", " ").lower() for t in texts]) + "\0"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[c]
    end = c == 0
    keep = letter | end
    keep[1:] |= letter[:-1]
    out = c.astype(np.uint8)
    # A letter whose low byte is that of a mark must not look like one.
    out[letter & ((out == 0) | (out == 32))] = 1
    out[~letter] = 32
    out[end] = 0
    out = out[keep]
    return out, np.flatnonzero(out == 0)


def _moves() -> np.ndarray:
    """Of each walk, step and character: whether the pointer moves on. Half of a character's bits are set, so that no walk stays for ever."""
    order = seeded(WALKS * PERIOD * 256, 100).reshape(WALKS, PERIOD, 256).argsort(1).argsort(1)
    least = PERIOD // 2 + (seeded(WALKS * 256, 101) & np.uint64(PERIOD % 2)).astype(np.int64).reshape(WALKS, 1, 256)
    return (order < least).astype(np.int64)


MOVES = _moves()


def samples(c: np.ndarray, steps: list[int]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first place, walk, steps, hashes): the samples from all places of c, in blocks of PLACES. steps: powers of two times PERIOD, ascending."""
    reach = steps[-1] + 1
    padded = np.concatenate([c, np.zeros(2 * reach, np.uint8)])
    for a in range(0, len(c), PLACES):
        m = min(PLACES, len(c) - a)
        part = padded[a : a + m + reach]
        for walk in range(WALKS):
            n = len(part) - PERIOD
            at, key = np.arange(n), np.zeros(n, np.uint64)
            for step in range(PERIOD):
                read = part[at]
                key <<= np.uint64(8)
                key |= read
                at += MOVES[walk, step][read]
            # at[s], key[s]: where the walk from s is after so many steps, and what it read; two such walks are one of double length.
            key *= _MIX
            key ^= key >> np.uint64(29)
            done = PERIOD
            while True:
                if done in steps:
                    yield a, walk, done, key[:m]
                if done >= steps[-1]:
                    break
                n = int(np.searchsorted(at, len(key), "left")) if len(at) else 0
                there = at[:n]
                key = key[:n] * _MIX + key[there]
                key ^= key >> np.uint64(29)
                at, done = at[there], done * 2


def best_substring(item: str, text: str) -> tuple[int, int]:
    """The least edit distance between item and any substring of text, and where the first such ends (bit-parallel columns)."""
    m = len(item)
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        places[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = places.get(c, 0)
        x = eq | down
        d = ((((eq & up) + up) ^ up) | eq | down) & full
        hp = (down | ~(d | up)) & full
        hn = up & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & full
        hn = (hn << 1) & full
        up = (hn | ~(x | hp)) & full
        down = hp & x
        if score < best:
            best, end = score, j + 1
    return best, end


def stretch_distances(patterns: np.ndarray, sizes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The least edit distance between each row of patterns (its first sizes characters, 64 at most) and any substring of the same row of texts."""
    n, rows = len(patterns), np.arange(len(patterns)) * 64
    # Characters are told apart by six bits, which can only make distances less.
    patterns, texts = patterns & 63, texts & 63
    places = np.zeros(n * 64, np.uint64)
    for i in range(patterns.shape[1]):
        places[rows + patterns[:, i]] |= np.uint64(1) << np.uint64(i)
    one = np.uint64(1)
    top = (sizes - 1).astype(np.uint64)
    # What stands behind a shorter pattern lies above its top bit and never comes down.
    up, down = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    score, best = sizes.astype(np.int64), sizes.astype(np.int64)
    columns = np.ascontiguousarray(texts.T)
    for j in range(texts.shape[1]):
        eq = places[rows + columns[j]]
        x = eq | down
        d = (((eq & up) + up) ^ up) | x
        hp = down | ~(d | up)
        hn = up & d
        score += ((hp >> top) & one).view(np.int64)
        score -= ((hn >> top) & one).view(np.int64)
        hp <<= one
        hn <<= one
        up = hn | ~(x | hp)
        down = hp & x
        np.minimum(best, score, out=best)
    return best


class Items:
    """Items ready to be looked for: the samples of all their places, as sorted arrays."""

    FILTER = 22

    def __init__(self, rows: list[tuple[object, str]]):
        self.rows = [(i, t) for i, text in rows if (t := normal(text or ""))]
        self.size = np.array([len(t) for _, t in self.rows], np.int64)
        self.exact = [j for j, (_, t) in enumerate(self.rows) if len(t) < 5]
        self.need = np.where(self.size >= SHORT, NEED, 1)
        steps = np.full(len(self.rows), STEPS)
        for size in sorted(TIERS, reverse=True):
            steps[self.size < size] = TIERS[size]
        self.laid, ends = laid_out([t for _, t in self.rows]) if self.rows else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
        self.start = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        self.steps = sorted({int(s) for s, n in zip(steps, self.size) if n >= 5})
        found: dict[tuple[int, int], list] = defaultdict(list)
        owner = np.repeat(np.arange(len(self.rows)), self.size + 1) if len(self.rows) else np.zeros(0, np.int64)
        offset = np.arange(len(self.laid)) - self.start[owner] if len(self.rows) else owner
        for a, walk, n, key in samples(self.laid, self.steps) if self.steps else ():
            j, o = owner[a : a + len(key)], offset[a : a + len(key)]
            # A walk of n steps reads some n / 2 characters; places with fewer left would read what follows the item.
            own = (steps[j] == n) & (self.size[j] >= 5) & (o + n // 2 <= self.size[j])
            found[walk, n].append((key[own], j[own].astype(np.int32), o[own].astype(np.int32)))
        self.tables = {}
        for which, blocks in found.items():
            key, j, o = (np.concatenate([b[k] for b in blocks]) for k in range(3))
            order = np.argsort(key, kind="stable")
            key, j, o = key[order], j[order], o[order]
            kinds, first = np.unique(key, return_index=True)
            seen = np.zeros(1 << self.FILTER, bool)
            seen[kinds >> np.uint64(64 - self.FILTER)] = True
            self.tables[which] = (kinds, np.append(first, len(key)), j, o, seen)

    def windows(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, lowest diagonal and a place of agreement of every candidate window of the laid texts."""
        blocks = []
        for a, walk, n, key in samples(c, self.steps) if self.steps else ():
            kinds, first, item, offset, seen = self.tables[walk, n]
            maybe = np.flatnonzero(seen[key >> np.uint64(64 - self.FILTER)])
            k = key[maybe]
            at = np.minimum(np.searchsorted(kinds, k), max(len(kinds) - 1, 0))
            same = kinds[at] == k if len(kinds) else np.zeros(len(k), bool)
            at, maybe = at[same], maybe[same]
            times = first[at + 1] - first[at]
            posting = np.repeat(first[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            place = np.repeat(maybe, times) + a
            j = item[posting].astype(np.int64)
            band = (place - offset[posting]) // BAND + (1 << 19)
            blocks.append((j << 42) | (band << 21) | (place // APART))
        # Item, band and place in one number: 22, 21 and 21 bits.
        votes = np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.int64)
        named = votes >> 21
        window, first, times = np.unique(named, return_index=True, return_counts=True)
        # A window is two bands: a band votes for itself and the band before it.
        follows = np.zeros(len(window), np.int64)
        if len(window):
            beside = np.flatnonzero(window[1:] == window[:-1] + 1)
            follows[beside] = times[beside + 1]
        alone = np.ones(len(window), bool)
        alone[1:] = window[1:] != window[:-1] + 1
        item = window >> 21
        enough = times + follows >= self.need[item]
        # A band that its predecessor's window holds whole need not be asked again, unless it is joined by the next.
        repeat = ~alone & (follows == 0)
        repeat[1:] &= enough[:-1]
        good = enough & ~repeat
        return item[good], ((window[good] & ((1 << 21) - 1)) - (1 << 19)) * BAND, (votes[first[good]] & ((1 << 21) - 1)) * APART

    def near(self, c: np.ndarray, item: np.ndarray, low: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which candidate windows have a stretch about their agreement that is near the item's."""
        out = np.zeros(len(item), bool)
        side = STRETCH + 2 * BAND + 2 * OFF
        padded = np.concatenate([np.zeros(side, np.uint8), c, np.zeros(2 * side, np.uint8)])
        own = np.concatenate([self.laid, np.zeros(STRETCH, np.uint8)])
        for a in range(0, len(item), TOGETHER):
            j, d, p = item[a : a + TOGETHER], low[a : a + TOGETHER], place[a : a + TOGETHER]
            size = np.minimum(self.size[j], STRETCH)
            o = np.clip(p - d - STRETCH // 2, 0, self.size[j] - size)
            pattern = own[(self.start[j] + o)[:, None] + np.arange(STRETCH)]
            text = padded[np.clip(d + o - OFF, -side, len(c))[:, None] + side + np.arange(side)]
            limit = np.where(self.size[j] > STRETCH, LOCAL * size, SHARE * size + 1e-9)
            out[a : a + TOGETHER] = stretch_distances(pattern, size, text) <= limit
        return out

    def find(self, texts: list[str]) -> Iterator[list[tuple[int, int, int, int]]]:
        """For each text: (item, edit distance, first word, words) of the items that it holds, each at its best place."""
        first = 0
        while first < len(texts):
            # Texts of LAID characters at most (or one longer text), end to end.
            last, size = first + 1, len(texts[first])
            while last < len(texts) and size + len(texts[last]) < LAID:
                size += len(texts[last])
                last += 1
            yield from self._find(texts[first:last])
            first = last

    def _find(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        known: dict[int, str] = {}
        for j in self.exact:
            item = self.rows[j][1]
            for k, text in enumerate(texts):
                if k not in known:
                    known[k] = normal(text)
                at = known[k].find(item) if _UNSPACED.search(item) else f" {known[k]} ".find(f" {item} ")
                if at >= 0:
                    found[k][j] = (0, known[k].count(" ", 0, at), 1 + item.count(" "))
        c, ends = laid_out(texts)
        begins = np.concatenate([[0], ends[:-1] + 1])
        asked: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for a in range(0, len(c), LAID):
            # A text of more than LAID characters is gone through in pieces that overlap by the longest window.
            over = int(self.size.max()) * 2 + 2 * BAND if len(self.size) else 0
            piece = c[a : a + LAID + over]
            item, low, place = self.windows(piece)
            near = self.near(piece, item, low, place)
            for j, d, p in zip(item[near].tolist(), (low[near] + a).tolist(), (place[near] + a).tolist()):
                m = len(self.rows[j][1])
                edits = int(SHARE * m + 1e-9)
                # The place is known up to APART characters, in which texts may end.
                for k in range(int(np.searchsorted(ends, p)), min(int(np.searchsorted(ends, p + APART - 1)) + 1, len(texts))):
                    asked[k, j].append((max(0, d - edits - int(begins[k])), max(0, d + 2 * BAND + m + edits - int(begins[k]))))
        for (k, j), spans in asked.items():
            if k not in known:
                known[k] = normal(texts[k])
            item, text = self.rows[j][1], known[k]
            spans.sort()
            joined = [list(spans[0])]
            for x, y in spans[1:]:
                if x <= joined[-1][1]:
                    joined[-1][1] = max(y, joined[-1][1])
                else:
                    joined.append([x, y])
            for x, y in joined:
                if found[k].get(j, (1,))[0] == 0:
                    break
                distance, end = best_substring(item, text[x:y])
                if distance <= SHARE * len(item) and distance < found[k].get(j, (len(item) + 1,))[0]:
                    done = x + end
                    start = done - best_substring(item[::-1], text[x:done][::-1])[1]
                    found[k][j] = (distance, text.count(" ", 0, start), 1 + text.count(" ", start, done))
        return [sorted((j, *v) for j, v in f.items()) for f in found]


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of ITEM_BYTES at most (a longer item alone)."""
    rows = pick(items, item_id=id_col, text=text_col).where("length(text) > 0")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-2 * total // ITEM_BYTES)) if total > ITEM_BYTES else 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is not None, r))


def _finder(sent, token: str) -> Items:
    """One block's items, made once a worker process."""
    return remembered("items", token, make=lambda: Items(sent.value))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance (edits), similarity, start_word, n_words."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    item_type = pick(items, item_id=item_id_col).schema["item_id"].dataType
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {item_type.simpleString()}, distance long, similarity double, start_word long, n_words long"
    out = None
    for block in item_blocks(items, item_id_col, item_text_col):
        sent, token = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def make(sent=sent, token=token):
            known = _finder(sent, token)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in parts(batches, 2000, 1):
                    found = known.find([t or "" for t in b.column(1).to_pylist()])
                    rows = [(k, *f) for k, fs in enumerate(found) for f in fs]
                    if rows:
                        k, j, distance, start, n = zip(*rows)
                        held = [known.rows[x] for x in j]
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array(k)), pa.array([t[0] for t in held], to_arrow_type(item_type)), pa.array(distance, pa.int64()), pa.array([1 - d / len(t[1]) for d, t in zip(distance, held)], pa.float64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())],
                            names=["doc_id", "item_id", "distance", "similarity", "start_word", "n_words"],
                        )

            return run

        part = arrow_map(rows, make, schema)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that hold an item. Rows are filtered where they are read; nothing is joined."""
    where = docs.columns.index(text_col)
    for block in item_blocks(items, item_id_col, item_text_col):
        sent, token = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def make(sent=sent, token=token):
            known = _finder(sent, token)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in parts(batches, 2000, where):
                    clean = [not f for f in known.find([t or "" for t in b.column(where).to_pylist()])]
                    yield b.filter(pa.array(clean, pa.bool_()))

            return run

        docs = arrow_map(docs, make, docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
