"""Language identification with interpolated Kneser-Ney character models, one a language.

Models are fitted on a bounded sample of labelled rows (sample_docs documents a language, whole texts) and kept as
sorted arrays of n-gram hashes with one column of log probabilities, or of back-off weights, a language. A text is
read as its words between boundary marks, so a word's score under every language is worked out once and
remembered; a text's score is the sum over its words, over the number of symbols: a cross-entropy. The lowest wins.
The scale of the confidence, and the cross-entropy above which a text is rejected as none of the languages, are
calibrated on sampled documents that the models have not seen.

Edge cases: a null text, and one without a letter, gets 'und' with score 0 and is rejected; rows with a null label
are predicted, not learned from; ties go to the language that sorts first; repeated rows get equal results; without
any labelled row everything is 'und'; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, batch, mixed, parts, pick
from .worker import remembered

ORDER = 4
DISCOUNT = 0.75
#: Documents a language that a model is fitted on; one more in four calibrates. With MOST_CHARS, the bound of what the driver gathers.
SAMPLE_DOCS = 400
#: Of a longer document the sample takes so many characters, from a place that its hash tells (a prediction always reads the whole text).
MOST_CHARS = 20_000
#: Languages that are learned: those with the most labelled rows, if there are more.
MOST_LANGS = 500
#: Words that a worker remembers the scores of, and texts whose words are looked up together.
REMEMBERED, TOGETHER = 250_000, 64
#: Rejection: the limit lies this share of the way from the cost of own texts to that of texts of a language left out of fitting (or, with one
#: language, so much above the mean of its own).
BETWEEN, ALONE = 0.5, 1.5
#: Of own texts, and of texts of languages left out, this share may lie beyond the costs that the limit is put between.
TAIL = 0.01
#: Calibrating texts are also cut to so many symbols: short ones stray further. Limits are interpolated by the root of the length.
LENGTHS = (20, 50, 150, 500)
#: What a text of one symbol may have beyond the limit of the shortest of these, about; less by the root of the length.
SHORT = 6.0

_WORD = re.compile(r"[^\W\d_]+")
#: Numerals that are no decimal digits (as in ½ ² Ⅷ): word characters without being letters.
_NUMERAL = re.compile("[" + "".join(c for c in map(chr, range(0x30000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]")
START, END = 2, 3


def words_of(text: str) -> list[str]:
    """Runs of letters."""
    words = _WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    return [v for w in words for v in ([w] if w.isalpha() else _NUMERAL.sub(" ", w).split())]


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all words, each between its marks, and the index of the word that each belongs to."""
    text = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return text, np.cumsum(text == START) - 1


def grams(text: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n symbols that end at each place, with those before a word's start left out: a gram never reaches over a start mark. Positions with less left context than n hold shorter grams of the same order."""
    h = np.zeros(len(text), np.uint64)
    open_ = np.ones(len(text), bool)
    for k in range(n):
        shifted = np.concatenate([np.zeros(min(k, len(text)), np.uint64), text[: max(0, len(text) - k)]])
        h = np.where(open_, mixed(h ^ (shifted + np.uint64(0x1000000 * (k + 1)))), h)
        open_ &= shifted != START
    return h


def fit_language(counts: Counter) -> list[tuple[dict, dict]]:
    """For each order from 1: the probability of each gram seen, and the back-off weight of each context seen. Grams are strings."""
    top: list[Counter] = [Counter() for _ in range(ORDER)]
    for word, n in counts.items():
        w = f"\x02{word}\x03"
        for i in range(1, len(w)):
            for k in range(ORDER):
                if i - k < 0:
                    break
                if k == ORDER - 1 or i - k == 0:  # the longest gram at this place
                    top[k][w[i - k : i + 1]] += n
                    break
    # Continuation counts: in how many kinds of longer gram a gram is the end.
    for k in range(ORDER - 1, 0, -1):
        for gram in top[k]:
            top[k - 1][gram[1:]] += 1
    models, lower = [], None
    for k in range(ORDER):
        total, kinds = defaultdict(int), defaultdict(int)
        for gram, n in top[k].items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        weight = {h: DISCOUNT * kinds[h] / total[h] for h in total}
        floor = 1.0 / 4096
        chance = {g: (n - DISCOUNT) / total[g[:-1]] + weight[g[:-1]] * (floor if lower is None else lower.get(g[1:], floor)) for g, n in top[k].items()}
        models.append((chance, weight))
        lower = chance
    return models


def gram_hash(strings: list[str]) -> np.ndarray:
    """The hash that grams() gives for these symbols."""
    out = np.zeros(len(strings), np.uint64)
    if not strings:
        return out
    longest = max(map(len, strings))
    table = np.zeros((len(strings), longest), np.uint64)
    size = np.array([len(s) for s in strings])
    for i, s in enumerate(strings):
        table[i, : len(s)] = [ord(c) for c in reversed(s)]
    for k in range(longest):
        out = np.where(k < size, mixed(out ^ (table[:, k] + np.uint64(0x1000000 * (k + 1)))), out)
    return out


class Models:
    """All languages' models, as sorted hash arrays; plain data that is shipped to the workers."""

    def __init__(self, langs: list[str], by_lang: list[list[tuple[dict, dict]]]):
        self.langs = langs
        self.chance, self.weight = [], []
        for k in range(ORDER):
            self.chance.append(self._sorted([m[k][0] for m in by_lang]))
            self.weight.append(self._sorted([m[k][1] for m in by_lang]))
        self.floor = np.float32(np.log(1.0 / 4096))
        self.scale = 20.0
        self.limits = np.full((len(langs), len(LENGTHS)), np.inf)

    def limit(self, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The cross-entropy above which a text of n symbols is none of its language."""
        at = 1 / np.sqrt(np.maximum(n, 1))
        known = 1 / np.sqrt(np.array(LENGTHS[::-1]))
        out = np.full(len(lang), np.inf)
        for i in range(len(self.langs)):
            mine = lang == i
            out[mine] = np.interp(at[mine], known, self.limits[i, ::-1])
        # Shorter than what was calibrated: more room still.
        return out + np.maximum(at - known[-1], 0) * SHORT

    @staticmethod
    def _sorted(tables: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        keys = sorted(set().union(*tables)) if tables else []
        hashes = gram_hash(keys)
        order = np.argsort(hashes)
        values = np.array([[np.log(t[g]) if g in t else np.nan for t in tables] for g in keys], np.float32).reshape(len(keys), len(tables))
        return hashes[order], values[order]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
        hashes, values = table
        if not len(hashes):
            return np.full((len(h), values.shape[1]), np.nan, np.float32)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        out = values[at]
        out[hashes[at] != h] = np.nan
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """The log probability of each word under each language."""
        text, owner = coded(words)
        total = np.full((len(text), len(self.langs)), self.floor, np.float32)
        for k in range(ORDER):
            chance = self._find(self.chance[k], grams(text, k + 1))
            context = np.concatenate([np.zeros(1, np.uint64), grams(text, k)[:-1]]) if k else np.zeros(len(text), np.uint64)
            weight = self._find(self.weight[k], context)
            if k:  # a word's first symbols have no longer context
                start = np.flatnonzero(text == START)
                for back in range(k):
                    at = start + back
                    at = at[at < len(text)]
                    at = at[owner[at] == owner[start[: len(at)]]]
                    weight[at], chance[at] = np.nan, np.nan
            weight[np.isnan(weight)] = 0.0
            total = np.where(np.isnan(chance), total + weight, chance)
        total[text == START] = 0.0
        out = np.zeros((len(words), len(self.langs)), np.float64)
        np.add.at(out, owner, total)
        return out


class Scorer:
    def __init__(self, models: Models):
        self.models = models
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1 << 14, len(self.models.langs) + 1))

    def learn(self, words: list[str]) -> None:
        """Scores new words, some ten thousand at once."""
        for a in range(0, len(words), 10_000):
            part, have = words[a : a + 10_000], len(self.index)
            while have + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[have : have + len(part), :-1] = self.models.score(part)
            self.table[have : have + len(part), -1] = [len(w) + 1 for w in part]
            self.index.update(zip(part, range(have, have + len(part))))

    def entropies(self, texts: list[str]) -> np.ndarray:
        """For each text: its cross-entropy under each language, a symbol; and its number of symbols."""
        out = np.zeros((len(texts), len(self.models.langs) + 1))
        for first in range(0, len(texts), TOGETHER):
            lists = [words_of(t) for t in texts[first : first + TOGETHER]]
            new = set().union(*lists).difference(self.index)
            if len(self.index) + len(new) > REMEMBERED:
                self.forget()
                new = set().union(*lists)
            self.learn(sorted(new))
            for i, words in enumerate(lists, first):
                if words:
                    out[i] = self.table[list(map(self.index.__getitem__, words))].sum(0)
        n = out[:, -1]
        out[:, :-1] /= -np.maximum(n, 1)[:, None]
        return out


    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The language of each text, the confidence in it, its cross-entropy, and whether the text is rejected."""
        e = self.entropies(texts)
        e, n = e[:, :-1], e[:, -1]
        best = e.argmin(1)
        lowest = e[np.arange(len(e)), best]
        score = np.where(n > 0, 1 / np.exp(-self.models.scale * (e - lowest[:, None])).sum(1), 0.0)
        rejected = (n == 0) | (lowest > self.models.limit(best, n))
        return [self.models.langs[k] if m else "und" for k, m in zip(best, n)], score, lowest, rejected


def fit(sample: dict[str, list[str]]) -> Models:
    """sample: the texts of each language. Every fifth text calibrates."""
    langs = sorted(sample)
    models = Models(langs, [fit_language(Counter(w for k, t in enumerate(sample[x]) if k % 5 or len(sample[x]) < 5 for w in words_of(t))) for x in langs])
    scorer, whole, truth = Scorer(models), [], []
    for i, x in enumerate(langs):
        texts = [t for k, t in enumerate(sample[x]) if not k % 5 and words_of(t)]
        whole += texts
        truth += [i] * len(texts)
    e, own = scorer.entropies(whole)[:, :-1], np.array(truth, int)
    for at, size in enumerate(LENGTHS):
        cut = scorer.entropies([t if len(t) <= size else t[: max(size, 1)] for t in whole])
        # Texts that are shorter tell nothing of this length.
        fit_ = cut[:, -1] >= 0.6 * size
        if not fit_.any():
            continue
        cost, of = cut[fit_, :-1], own[fit_]
        others = np.where(np.arange(len(langs)) == of[:, None], np.inf, cost)
        for i in range(len(langs)):
            # As each language has its own model, a language is left out by leaving its column out.
            mine, foreign = cost[of == i, i], others[(of != i) & (others.argmin(1) == i), i]
            if not len(foreign):
                foreign = cost[of != i, i]
            if len(mine):
                high = np.quantile(mine, 1 - TAIL)
                low = np.quantile(foreign, TAIL) if len(foreign) else mine.mean() + ALONE / BETWEEN
                models.limits[i, at] = max(high + BETWEEN * (low - high), high)
    for limits in models.limits:
        # Lengths that no text had take the limit of the next shorter (or else longer) one.
        have = np.flatnonzero(np.isfinite(limits))
        if len(have):
            limits[:] = [limits[have[have <= k][-1] if (have <= k).any() else have[0]] for k in range(len(limits))]
    if len(e):
        gap = e - e.min(1, keepdims=True)
        losses = [(-np.log(np.maximum((p := np.exp(-s * gap))[np.arange(len(gap)), own] / p.sum(1), 1e-12)).mean(), s) for s in (1, 2, 4, 8, 16, 32)]
        models.scale = float(min(losses)[1])
    return models


def shared_scorer(models: Models | None, token: str) -> Scorer | None:
    """The scorer of one run's models, with what it remembers, for all tasks of a worker process."""
    return None if models is None else remembered("language", token, make=lambda: Scorer(models))


def _label(df: DataFrame, models: Models | None, token: str, kind: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(models)

    def make():
        scorer = shared_scorer(sent.value, token)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts(batches, 1000, 1):
                texts = [t or "" for t in b.column(1).to_pylist()]
                if scorer is None:
                    n = np.zeros(len(texts))
                    lang, score, entropy, reject = ["und"] * len(texts), n, n, n == 0
                else:
                    lang, score, entropy, reject = scorer.judge(texts)
                yield batch(doc_id=b.column(0), lang_pred=pa.array(lang, pa.string()), score=pa.array(score, pa.float64()), cross_entropy=pa.array(entropy, pa.float64()), rejected=pa.array(reject, pa.bool_()))

        return run

    return arrow_map(df, make, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")


def fit_sample(docs: DataFrame, may_learn: Column, sample_docs: int = SAMPLE_DOCS) -> Models | None:
    """Models from docs (doc_id, text, lang). The driver gets sample_docs texts a language on average, chosen by hash of their text, and no more than twice that."""
    rows = docs.where(may_learn & F.col("lang").isNotNull() & (F.length("text") > 0))
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()}
    if not size:
        return None
    whole = 1 << 30
    code = F.xxhash64("text", "doc_id")
    bound = F.create_map(*[x for k, n in size.items() for x in (F.lit(k), F.lit(min(whole, int(whole * sample_docs / n) + 1)))])
    chosen = rows.where(F.pmod(code, F.lit(whole)) < bound[F.col("lang")])
    start = F.when(F.length("text") > MOST_CHARS, F.pmod(code, F.length("text") - MOST_CHARS)).otherwise(0).cast("int") + 1
    chosen = chosen.orderBy(code, "lang").limit(2 * sample_docs * len(size)).select("lang", F.substring("text", start, F.lit(MOST_CHARS)).alias("text"))
    sample = defaultdict(list)
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["text"])):
        sample[r["lang"]].append(r["text"])
    for texts in sample.values():
        texts.sort(key=lambda t: mixed(np.array([len(t)], np.uint64) ^ np.uint64(hash_text(t)))[0])
    return fit(sample)


def hash_text(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def identify(docs: DataFrame, may_learn: Column | None = None, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, lang_pred, score, cross_entropy, rejected. may_learn: of which rows (by doc_id, text, lang) labels may be used; all if None."""
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    models = fit_sample(rows, F.lit(True) if may_learn is None else may_learn, sample_docs)
    return _label(rows.select("doc_id", "text"), models, uuid.uuid4().hex, rows.schema["doc_id"].dataType.simpleString())


def keep_identified(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs, all columns, without the rows that no model accepts. Rows are filtered where they are read. Without any labelled row there is no model to reject by, and all rows stay."""
    models = fit_sample(pick(docs, doc_id=id_col, text=text_col, lang=lang_col), F.lit(True), sample_docs)
    if models is None:
        return docs
    sent, where, token = docs.sparkSession.sparkContext.broadcast(models), docs.columns.index(text_col), uuid.uuid4().hex

    def make():
        scorer = shared_scorer(sent.value, token)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts(batches, 1000, where):
                yield b.filter(pa.array(~scorer.judge([t or "" for t in b.column(where).to_pylist()])[3], pa.bool_()))

        return run

    return arrow_map(docs, make, docs.schema)


def fold(of: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod of."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fold(3) != 1)
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
