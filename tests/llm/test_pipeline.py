"""The corpus pipeline against a brute-force version of its stages, and each stage on odd tables."""

import random
import struct
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
P = pytest.importorskip("corpus_pipeline")

from lexmill.llm.decontaminate import best_substring, normal  # noqa: E402

from .test_operators import DOCS, covered  # noqa: E402

SYLLABLES = {"aa": "ba be bi bo bu da de di do du".split(), "ee": "tsch krr plo gnu mre vla zzu hro".split(), "oo": "ñan çoi úmé lhé rhó àse wîn êté".split()}


def says(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def corpus():
    """(rows, benchmark items, ids of rows in an unlearned language): copies, near copies, shared passages, edited benchmark passages, repeated rows and null ids."""
    r = random.Random(2)
    rows = [[k, says(r, ("aa", "ee")[k % 2], r.randint(40, 90)), ("aa", "ee")[k % 2], "s"] for k in range(120)]
    items = [(k, says(r, "aa", 30)) for k in range(4)]
    passage = says(r, "ee", 60)
    for k in (5, 9, 31):
        rows[k][1] += " " + passage
    for k, of in ((50, 4), (52, 4)):
        rows[k][1] = rows[of][1]
    near = rows[6][1].split()
    near[3] = "other"
    rows[60][1] = " ".join(near)
    for k, (_, text) in zip((70, 72, 74, 76), items):
        words = text.split()
        for i in range(0, len(words), 3):
            words[i] = "x" + words[i][1:]
        rows[k][1] = says(r, "aa", 20) + " " + " ".join(words) + " " + says(r, "aa", 20)
    foreign = {200, 201, 202}
    rows += [[k, says(r, "oo", 60), None, "s"] for k in foreign]
    rows += [[300, None, "aa", "s"], [301, "", None, "s"], [302, "123 456", "aa", "s"]]
    rows += [list(rows[7]), list(rows[7]), [None, says(r, "ee", 50), "ee", "s"], [8, says(r, "aa", 50), "aa", "s"]]
    return [(i, t, x, s, len(t or "")) for i, t, x, s in rows], items, foreign


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows, items, foreign = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items, foreign


def after_language(rows, foreign):
    """What a model must keep and reject here: unlearned syllables, and texts without a letter."""
    return [x for x in rows if x[0] not in foreign and x[1] and any(c.isalpha() for c in x[1])]


def after_near(rows):
    sets = []
    for x in rows:
        w = x[1].lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for n, i in enumerate(order):
        for j in order[:n]:
            if rows[i][:2] == rows[j][:2] or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    return [rows[k] for k in range(len(rows)) if find(k) == k]


def after_repeats(rows, hashes):
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, hashes[x[1]]))
    gone = covered([(k, tuple(x[1].split())) for k, x in enumerate(order)], 20)
    out = []
    for k, (i, text, lang, source, n) in enumerate(order):
        if gone[k].any():
            text = " ".join(w for w, g in zip(text.split(), gone[k]) if not g)
            n = len(text)
        out.append((i, text, lang, source, n))
    return out


def test_run_against_brute_force(spark, made):
    folder, rows, items, foreign = made
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(x[1],) for x in rows if x[1]], "text string").selectExpr("text", "xxhash64(text) h").collect()}
    want = after_repeats(after_near(after_language(rows, foreign)), hashes)
    want = [x for x in want if not any(best_substring(normal(t), normal(x[1]))[0] <= 0.2 * len(normal(t)) for _, t in items)]
    assert not {70, 72, 74, 76} & {x[0] for x in want} and {4, 6, 7, 8, 200} & {x[0] for x in want} == {4, 6, 7, 8}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = sorted(((x[0] is None, x[0] or 0, library.encode(x[1], add_special_tokens=False).ids + [2]) for x in want))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in P.run(spark, folder).collect():
        assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{p['length']}I", *p["ids"])) and len(p["ids"]) == p["length"]
        pieces[p["doc_id"] is None, p["doc_id"] or 0, p["doc_tokens"]].append((p["start"], p["ids"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    got = []
    for (null, doc, size), own in pieces.items():
        for text in range(sum(start == 0 for start, _ in own)):
            whole = [i for _, part in sorted(own) for i in part] if sum(start == 0 for start, _ in own) == 1 else None
            assert whole is None or len(whole) == size
            got.append((null, doc, whole))
    assert sorted(g for g in got if g[2]) == [w for w in ids if (w[0], w[1]) in {(g[0], g[1]) for g in got if g[2]}] and len(got) == len(ids)
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 4096


def test_stages_on_odd_tables(spark, made):
    folder, rows, *_ = made
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit(1) for c in ("kept", "doc", "h", "_kept", "start", "text_hash", "component")})
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert P.substrings(spark, docs.drop("n_chars"), folder).columns == docs.drop("n_chars").columns
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert P.language(spark, unlabelled, folder).count() == docs.count()
    same = spark.createDataFrame([(1, "a b c d e f", "aa", "s", 11)] * 3 + [(None, "g h i j k l", "aa", "s", 11)] * 3, DOCS)
    assert P.near_dedup(spark, same, folder).count() == 2
