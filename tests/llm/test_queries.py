"""The registered queries themselves, by their contracts: with SQL where there is some, against brute force where not."""

import os
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from lexmill.llm import queries as Q  # noqa: E402
from lexmill.llm.decontaminate import best_substring, normal  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}


def result(spark, name):
    return Q.queries()[name](spark, DATA).collect()


def crc(i, of):
    return zlib.crc32(str(i).encode()) % of


@pytest.mark.parametrize("name", Q.oracle_sql())
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    df = Q.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())


def test_op1(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in result(spark, "op1_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    for i, d in docs.items():
        ids, at = library.encode(d["text"] or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            own = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(own)}I", *own)))
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    total = sum(n for parts in sequences.values() for _, n in parts)
    assert padding <= 0.01 * total and len(sequences) <= total / 4096 + 13 * spark.read.parquet(f"{DATA}/documents.parquet").rdd.getNumPartitions()


def test_op2(spark):
    t = pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()
    good = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in t if r["embedding"] and np.isfinite(np.array(r["embedding"], float)).all() and any(r["embedding"])}
    got = defaultdict(list)
    for r in sorted(result(spark, "op2_inverted_multi_index"), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in good if i % 100 == 0}
    hit = total = 0
    for q, found in got.items():
        far = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        assert found == sorted(found, key=lambda x: (x[1], x[0])) and dict((i, d) for d, i in far).items() >= dict(found).items()
        hit, total = hit + len({i for i, _ in found} & {i for _, i in far[:10]}), total + min(10, len(far))
    assert hit >= 0.9 * total


def test_op3(spark, docs):
    items = {r["item_id"]: normal(r["text"] or "") for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in result(spark, "op3_decontamination")}
    for i in [i for i, d in docs.items() if len(d["text"] or "") < 1500][:40] + sorted({i for i, _ in got}):
        text = normal(docs[i]["text"] or "")
        if len(text) > 6000:
            continue
        for j, item in items.items():
            far = best_substring(item, text)[0]
            assert got.get((i, j)) == (far if far <= 0.2 * len(item) else None)


def test_op4_op6(spark, docs):
    rows = result(spark, "op4_language_id")
    assert {r["doc_id"] for r in rows} == set(docs) and all(r["held_out"] == (crc(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    told = {d["lang"] for d in docs.values() if d["lang"]}
    assert all((r["lang_pred"] in told) == any(c.isalpha() for c in docs[r["doc_id"]]["text"] or "") and (r["lang_pred"] in told or r["lang_pred"] == "und") for r in rows)
    held = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.9 * len(held)
    rows = result(spark, "op6_quality")
    assert {r["doc_id"] for r in rows} == set(docs)
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_op5(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = result(spark, "op5_token_counts")
    assert {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        text = docs[r["doc_id"]]["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)


def test_op8(spark):
    pages = {r["page_id"]: r for r in pq.read_table(f"{DATA}/pages.parquet").to_pylist()}
    rows = result(spark, "op8_html_extraction")
    assert {r["page_id"] for r in rows} == set(pages)
    assert all(r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"]) and r["text"] == " ".join(r["text"].split()) for r in rows)
