"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

A byte-pair encoding has the property that the encoding of a prefix ends in exactly one token t such that
the encoding of the rest, followed by t, is stable under merging; for that it is enough that the last token
of the rest and t are stable side by side. So one pass over the prefixes, with the last token and the count
of each, gives every prefix's count. Texts are split into pieces first, as the tokenizer's own pre-tokenizer
does. A piece's table of counts, one for each of its prefixes, is stored; a text's count at any prefix is the sum of the pieces before
the cut and one entry of the table of the piece that is cut, so truncation and budgets need no further encoding.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results; an empty
table gives an empty table; further columns of the input are ignored; null ids are kept as they are.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, batch, parts, pick
from .worker import remembered

#: Words remembered by a worker before its memory is cleared.
REMEMBERED = 400_000

# Code points for which Python's classes below agree with the tokenizer's; any other text is split by the library itself.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ſ‐-‧‰-⁞€]*")
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼½¾"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of texts and of their prefixes under a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        merges = said["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.letters = byte_letters()
        # Tokens in the order in which they are made: single letters, then one a merge; and the two that each is made of.
        letters = sorted(self.letters.values())
        made = ["".join(p) for p in pairs]
        self.ids = {t: k for k, t in enumerate([*letters, *made])}
        n = len(letters)
        if len(self.ids) != n + len(made):
            raise ValueError("a token is made by two merges")
        self.left, self.right = ([*range(n), *(self.ids[p[side]] for p in pairs)] for side in (0, 1))
        self.joined = {self.ids[a] << 32 | self.ids[b]: n + k for k, (a, b) in enumerate(pairs)}
        # The lengths of tokens of four letters and more by their last four, longest first.
        ends: dict[str, set[int]] = {}
        for t in made:
            if len(t) >= 4:
                ends.setdefault(t[-4:], set()).add(len(t))
        self.lengths = {e: (*sorted(have, reverse=True), 3, 2, 1) for e, have in ends.items()}
        self.special = [t["content"] for t in said.get("added_tokens", [])]
        self.cut = re.compile("|".join(f"({re.escape(s)})" for s in self.special)) if self.special else None
        self.library = Tokenizer.from_file(path)
        self.whole: dict[str, int] = {}
        #: The counts at every prefix of the pieces in whole, a byte each (pieces of under 64 characters).
        self.tables: dict[str, bytes] = {}
        self.latin = {c: "".join(self.letters[b] for b in c.encode()) for c in map(chr, range(0x180))}

    def beside(self, a: int, b: int) -> bool:
        """Whether token b stays apart after token a: merges are taken back, the last one first, as long as none across the border would have come before them."""
        limit, joined, left, right = 1 << 60, self.joined, self.left, self.right
        while True:
            if joined.get(a << 32 | b, limit) < limit:
                return False
            if a > b:
                if right[a] != a:
                    limit, a = a, right[a]
                    continue
                if left[b] == b:
                    return True
                limit, b = b + 1, left[b]
            else:
                if left[b] != b:
                    limit, b = b + 1, left[b]
                    continue
                if right[a] == a:
                    return True
                limit, a = a, right[a]

    def table(self, piece: str) -> list[int]:
        """The token count of every prefix of a piece, by its bytes: table[i] is for the first i bytes."""
        word = piece if piece.isascii() and piece.isalnum() else "".join(self.latin.get(c) or "".join(self.letters[b] for b in c.encode("utf-8", "surrogatepass")) for c in piece)
        n, ids, lengths, beside, short = len(word), self.ids, self.lengths, self.beside, (3, 2, 1)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for size in lengths.get(word[i - 4 : i], short) if i >= 4 else short:
                if size <= i:
                    token = ids.get(word[i - size : i])
                    if token is not None and (size == i or beside(last[i - size], token)):
                        last[i], count[i] = token, count[i - size] + 1
                        break
            else:
                raise ValueError(f"no token ends at byte {i} of {piece!r}")
        return count

    def pieces(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def prefixes(self, piece: str) -> bytes | list[int]:
        """The stored counts at every prefix of a piece."""
        known = self.tables.get(piece)
        if known is None:
            known = self.table(piece)
            if len(piece) < 64 and known[-1] < 256:
                if len(self.whole) > REMEMBERED:
                    self.whole.clear()
                    self.tables.clear()
                known = self.tables[piece] = bytes(known) if max(known) < 256 else known
                self.whole[piece] = known[-1]
        return known

    def of_piece(self, piece: str) -> int:
        n = self.whole.get(piece)
        return self.prefixes(piece)[-1] if n is None else n

    def counts(self, pieces: list[str]) -> list[int]:
        known = list(map(self.whole.get, pieces))
        return [self.prefixes(p)[-1] if n is None else n for p, n in zip(pieces, known)] if None in known else known

    def plain(self, text: str) -> int:
        return sum(self.counts(self.pieces(text)))

    def count(self, text: str) -> int:
        """Tokens of a text; a special string in it is one token, as the library takes it by default."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        return sum(1 if part in self.special else self.plain(part) for part in self.cut.split(text) if part)

    def measured(self, text: str, budget: int) -> tuple[int, int]:
        """The tokens of a text, and the length in characters of its longest prefix that has at most budget tokens, from the stored counts: whole pieces as long as they fit,
        and of the piece that doesn't, its longest prefix that does. (Where a cut leaves white space or an apostrophe last, the pieces before it may change; such a cut is counted again.)"""
        if self.cut is None or not any(s in text for s in self.special):
            pieces = self.pieces(text)
            counts = self.counts(pieces)
        else:
            pieces, counts = [], []
            for part in [p for p in self.cut.split(text) if p]:
                own = [part] if part in self.special else self.pieces(part)
                pieces += own
                counts += [1] if part in self.special else self.counts(own)
        total = sum(counts)
        if total <= budget:
            return total, len(text)
        used = [0, *accumulate(counts)]
        whole = bisect_right(used, budget) - 1
        at, used, piece = sum(map(len, pieces[:whole])), used[whole], pieces[whole]
        if piece not in self.special:
            ends = [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece)]
            known = self.prefixes(piece)
            for k in range(len(piece) - 1, 0, -1):
                if used + known[ends[k]] <= budget and self.prefix(text, at + k) <= budget:
                    return total, at + k
        return total, at

    def within(self, text: str, budget: int) -> int:
        return self.measured(text, budget)[1]

    def prefix(self, text: str, length: int) -> int:
        """Tokens of text[:length], from the stored counts; only the two pieces before the cut are split again, as splitting looks ahead but never back."""
        if self.cut is not None and any(s in text for s in self.special):
            done, whole = 0, length
            for part in [p for p in self.cut.split(text) if p]:
                if length <= len(part):
                    # A special string that is cut is plain text, and so is what stands before it.
                    return self.count(text[:whole]) if part in self.special and 0 < length < len(part) else done + (1 if part in self.special else self.prefix(part, length))
                done += 1 if part in self.special else self.plain(part)
                length -= len(part)
            return done
        used, starts, at = [0], [0], 0
        for piece in self.pieces(text):
            if at + len(piece) >= length:
                break
            at += len(piece)
            used.append(used[-1] + self.of_piece(piece))
            starts.append(at)
        back = max(0, len(starts) - 2)
        return used[back] + self.plain(text[starts[back] : length])


def counter(path: str) -> PrefixCounter:
    """One counter a worker process, with what it remembers."""
    return remembered("counter", path, make=lambda: PrefixCounter(path))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit, and fit_chars: the length of the longest prefix within the limit."""
    kind = docs.select(docs[f"`{id_col}`"].alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def make():
        c = counter(tokenizer)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts(batches, 2000, 1):
                texts = [t or "" for t in b.column(1).to_pylist()]
                counts, fit = zip(*(c.measured(t, limit) for t in texts))
                yield batch(
                    doc_id=b.column(0),
                    n_bytes=pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()),
                    n_tokens=pa.array(counts, pa.int64()),
                    over_limit=pa.array([n > limit for n in counts], pa.bool_()),
                    fit_chars=pa.array(fit, pa.int64()),
                )

        return run

    return arrow_map(pick(docs, doc_id=id_col, text=text_col), make, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
