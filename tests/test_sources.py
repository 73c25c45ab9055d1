"""Readers, dictionary documents, rule books and retrieval on small fixtures of our own."""

import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import lexicon as L
from lexmill.operators import retrieval, rules, search
from lexmill.sources import corpus, hunspell, lists, lookup
from lexmill.streaming.checks import check_stream

TMX = """<?xml version="1.0" encoding="UTF-8"?>
<tmx version="1.4"><header srclang="lb"/><body>
  <tu tuid="7"><prop type="x-domain">press</prop>
    <tuv xml:lang="lb-LU"><seg>Den Hond schléift am Gaart.</seg></tuv><tuv xml:lang="fr_FR"><seg>Le chien dort.</seg></tuv><tuv lang="xx"><seg>none</seg></tuv></tu>
  <tu><tuv xml:lang="LB"><seg>e <bpt i="1">&lt;b&gt;</bpt>schéint<ept i="1">&lt;/b&gt;</ept> Haus &amp;
    &amp;lt; d'Kaz &#8217;</seg></tuv><tuv xml:lang="lb"><seg>d'Haus ass al</seg></tuv></tu>
  <tu><tuv xml:lang="lb"><seg> </seg></tuv></tu>
  <tu><tuv xml:lang="ltz"><seg>E Gaardenhaus gëtt gebaut.</seg></tuv><tuv xml:lang="eng"><seg>A garden shed is being built.</seg></tuv></tu>
</body></tmx>"""
JSONL = ['{"LU": "Moien", "FR": "Salut", "n": 3}', '{"translation": {"lb": "Merci", "de": "Danke"}}', '{"source": "Äddi", "target": "Au revoir", "source_lang": "lb", "target_lang": "fr"}', "not json", "", '{"text_lb": "Jo", "domain": "x"}', "[1]"]


def test_language_codes(spark):
    want = {"lb-LU": "lb", "LU": "lb", "ltz": "lb", "text_lb": "lb", "fr-FR": "fr", "fra": "fr", "de_DE": "de", "en-GB": "en", "Luxembourgish": "lb", "xx": None}
    got = spark.createDataFrame([(c,) for c in want], "c string").select("c", corpus.language(F.col("c")).alias("l")).collect()
    assert {r["c"]: r["l"] for r in got} == want and all(corpus._language(c) == w for c, w in want.items())


def test_corpora(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.tmx").write_text(TMX)
    (tmp_path / "d/b.jsonl").write_text("\n".join(JSONL))
    got = sorted(corpus.read_corpus(spark, str(tmp_path / "d/a.tmx")).collect(), key=lambda r: r["seg_id"])
    assert [r["seg_id"] for r in got] == [0, 1, 2] and got[0]["text"] == {"lb": "Den Hond schléift am Gaart.", "fr": "Le chien dort."}
    assert got[0]["meta"] == {"x-domain": "press", "tuid": "7"} and got[1]["text"] == {"lb": "d'Haus ass al"} and got[2]["text"]["en"] == "A garden shed is being built."
    said = spark.createDataFrame([("e <bpt i='1'>x</bpt>schéint<ept>y</ept> <ph/>Haus &amp;lt; &#8217;&#x1F600;",)], "t string").select(corpus.segment_cleaned(F.col("t"))).first()[0]
    assert said == "e schéint Haus &lt; ’😀"
    assert corpus.read_corpus(spark, str(tmp_path / "d")).count() == 3  # TMX before others
    got = sorted(corpus.read_jsonl(spark, str(tmp_path / "d/b.jsonl")).collect(), key=lambda r: r["seg_id"])
    assert [r["text"] for r in got] == [{"lb": "Moien", "fr": "Salut"}, {"lb": "Merci", "de": "Danke"}, {"lb": "Äddi", "fr": "Au revoir"}, {"lb": "Jo"}]
    assert got[0]["meta"] == {"n": "3"} and got[3]["meta"] == {"domain": "x"}
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x/corpus.tmx", TMX)
        z.writestr("x/corpus.jsonl", "\n".join(JSONL))
        z.writestr("__MACOSX/corpus.tmx", TMX)
    assert corpus.read_corpus(spark, str(tmp_path / "c.zip"), str(tmp_path / "work")).count() == 3
    texts = corpus.segment_texts(corpus.read_tmx(spark, str(tmp_path / "d/a.tmx")))
    assert {r["lang"]: r["n"] for r in corpus.language_counts(texts).collect()} == {"lb": 3, "fr": 1, "en": 1}
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, str(tmp_path / "work"))


def test_search(spark):
    rows = [(0, "lb", "D'Haus ass al."), (1, "lb", "E Gemengenhaus, d’Noperen a schéint Haus"), (2, "fr", "La maison"), (0, "fr", "La maison est vieille"), (3, "lb", None)]
    texts = spark.createDataFrame(rows, "seg_id long, lang string, text string")
    hit = lambda q, **o: sorted(r["seg_id"] for r in search.search(texts.where("lang = 'lb'"), q, **o).collect())
    assert hit("Haus") == [0, 1] and hit("haus", match="substring") == [0, 1] and hit("gemengen") == [] and hit("HAUS", case_sensitive=True) == []
    assert hit("d'Noperen") == [1] and hit("scheint") == [] and hit("scheint", ignore_accents=True) == [1] and hit("a.s") == [] and hit("  ") == []
    page = search.corpus_search(texts, "haus", "lb", ("fr",), limit=1).collect()
    assert [(r["seg_id"], r["total"], r["marked"], r["other"]) for r in page] == [(0, 2, "D'**Haus** ass al.", {"fr": "La maison est vieille"})]
    found = search.search(texts.where("lang = 'lb'"), "haus", match="substring").where("seg_id = 1").collect()[0]
    assert [(x["start"], x["end"]) for x in found["ranges"]] == [(10, 14), (36, 40)]
    many = spark.createDataFrame([(9, "a " * 50)], "seg_id long, text string")
    assert len(search.search(many, "a").collect()[0]["ranges"]) == 21


def test_terms_and_sentences(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c).first()[0]
    assert one(X.terms(F.col("t")), "Die Regierung hat l’Europe ein neues Gesetz.") == ["regierung", "regie*", "hat", "europe", "europ*", "neues", "gesetz", "geset*"]
    assert one(X.sentences(F.col("t")), "Eent. Zwee ass! Jo?\nDräi Wierder… hei") == ["Eent.", "Zwee ass!", "Dräi Wierder…"]
    assert one(X.fold(F.col("t")), "éèßÄ é") == "eeßA e"
    assert one(X.match_case(F.lit("Haus"), F.col("t")), "bam") == "Bam" and one(X.match_case(F.lit("haus"), F.col("t")), "Bam") == "Bam"


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "chat noir chat"), (1, "chien noir"), (2, "gouvernement logement"), (3, "")], "doc_id long, text string")
    index = retrieval.build_index(docs)
    got = retrieval.top(retrieval.bm25(index, retrieval.query_terms(spark.createDataFrame([(0, "noir chat"), (1, "logements")], "query_id int, text string"))), 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(0, 0), (0, 1), (1, 2)]
    assert index.totals.first()["n"] == 3
    long = "Le chat noir. " * 20
    found = retrieval.similar_sentences(index, long, 1).collect()
    assert len({r["doc_id"] for r in found}) == len(found) == 2


def part(content, kind="word", join=False, **more):
    return {"type": kind, "content": content, **({"joinWithPreviousWord": True} if join else {}), **more}


ENTRY = {
    "entry": {
        "lod_id": "BEEM1", "partOfSpeech": "SUBST+M", "lemma": "Bam", "ipa": "baːm", "nRuleForm": "", "trademark": False, "infoboxes": [{"x": {"tag": "internalLink", "content": "Bësch", "idRef": "BESCH1"}}, {"tag": "internalLink", "content": "b", "idRef": "BESCH1"}],
        "allSynonyms": {"synonymGroups": [{"fromTerms": ["Bam"], "toSynonyms": [{"syn": "Gewiess"}]}], "otherPotentialSynonyms": {"synonyms": [{"syn": "Planz"}]}}, "categories": [{"label": "Natur", "code": "n"}], "tables": {"verbConjugation": {"infinitive": "x", "auxiliaryVerb": "hunn/sinn", "pastParticiple": "gebaamt", "indicative": {"present": {"p1": "baamen", "p2": "baams"}}}},
        "microStructures": [{"pastParticiple": "gebaamt", "grammaticalUnits": [{"grammaticalInformation": ["fam"], "meanings": [{
            "meaningID": "M1", "number": 1, "region": "Norden", "tags": ["a", "b"], "inflection": {"forms": [{"content": "Beem"}, {"content": "Bam"}, {"content": "Beem"}]},
            "targetLanguages": {"en": {"parts": [part("tree", "translation"), part("a plant", "semanticClarifier"), part("big", "note"), part("wood", "translation")]}, "xx": {"parts": []}},
            "examples": [{"parts": [{"type": "text", "parts": [part("EGS", "attribute"), part("d'"), part("Kanner", join=True), part("um"), part("Bam", "inflectedHeadword"), part("!", join=True)]}, {"type": "gloss", "parts": [part("si"), part("klammen")]}], "audioFiles": {"ogg": "o", "aac": "a"}}]}]}]}],
    }
}
HITS = {"results": [
    {"article_id": "BEEM1", "word_lb": "Bam", "pos": "SUBST+M", "matches": ["<em>Beem</em>"], "meanings": [{"id": "M1", "translation": "tree [plant]", "number": 1, "secondaryHeadword": ""}]},
    {"id": "X2", "word_lb": "Bamschoul", "pos": "SUBST+F", "erroneous": True, "matches": []}, {"word_lb": "none"}]}


def test_dictionary(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps(ENTRY, ensure_ascii=False))
    (tmp_path / "h.json").write_text(json.dumps(HITS, ensure_ascii=False))
    e = L.read_entries(spark, str(tmp_path / "e.json")).cache()
    r = e.first()
    m = r["sections"][0]["units"][0]["meanings"][0]
    assert (r["id"], r["pos_label"], r["n_form"], r["url"]) == ("BEEM1", "noun (masculine)", None, "https://lod.lu/artikel/BEEM1")
    assert m["examples"][0]["text"] == "d'Kanner um **Bam**!" and m["examples"][0]["gloss"] == "si klammen" and m["examples"][0]["labels"] == ["EGS"] and m["examples"][0]["audio"] == "a"
    assert [(t["text"], t["clarifier"], t["notes"]) for t in m["translations"]["en"]] == [("tree", "a plant", ["big"]), ("wood", None, [])] and set(m["translations"]) == {"en"}
    assert m["extra"] == {"region": "Norden", "tags": "a, b"} and r["sections"][0]["participles"] == ["gebaamt"]
    assert [x["id"] for x in r["see_also"]] == ["BESCH1"] and r["synonyms"][0]["synonyms"] == ["Gewiess"] and r["other_synonyms"] == ["Planz"] and r["categories"] == ["Natur"]
    assert L.listed_forms(e).first()["forms"] == ["Beem", "Bam"]
    assert [(v["mood"], v["tense"], v["p1"], v["p3"]) for v in L.verb_table(e).collect()] == [("indicative", "present", "baamen", None)]
    assert ("verbConjugation.indicative.present.p2", "baams") in {(x["path"], x["value"]) for x in L.generic_table(e).collect()}
    told = L.rendered_entries(e).first()["markdown"]
    assert "- EN: tree [a plant] (big); wood" in told and "[EGS] d'Kanner um **Bam**! — *si klammen*" in told
    assert L.trimmed_entry(e, ("en",), 0).first()["translations"] == {"en": "tree [a plant] (big); wood"}
    h = L.read_hits(spark, str(tmp_path / "h.json")).withColumn("query", F.lit("beem")).cache()
    assert [(x["id"], x["matched"], x["erroneous"]) for x in h.orderBy("ord").collect()] == [("BEEM1", ["Beem"], False), ("X2", [], True)]
    assert "matched form: Beem" in L.rendered_hits(h).first()["markdown"]
    assert [tuple(x) for x in L.noun_table(h).collect()] == [("beem", "Bam", "M", False)]
    found = L.resolve(spark.createDataFrame([("Beem",), ("beem1",), ("nope",)], "query string"), h.withColumn("query_key", F.col("query")), e).collect()
    assert {x["query"]: (x["id"], x["via"], list(x["alternatives"])) for x in found} == {"Beem": ("BEEM1", "Bam", ["X2"]), "beem1": ("BEEM1", None, [])}
    verbs = h.withColumn("pos", F.lit("VRB")).withColumn("query", F.lit("gebaamt")).withColumn("matched", F.array(F.lit("gebaamt")))
    assert [tuple(x) for x in L.participle_table(verbs, e).collect()] == [("gebaamt", "Bam", "both")]
    german = h.withColumn("query", F.lit("tree"))
    assert [(x["lemma"], x["sense"]) for x in L.german_hits(german).collect()] == [("Bam", "tree [plant]")]
    assert L.n_form_table(h.withColumn("query", F.lit("Bam")), e).first()["n_form"] is None
    codes = spark.createDataFrame([("SUBST+N",), ("VRB",), ("XYZ",), ("",)], "c string").select(L.part_of_speech(F.col("c")).alias("l")).collect()
    assert [c["l"] for c in codes] == ["noun (neuter)", "verb", "XYZ", ""]


RULES = [
    dict(id="1", title="Komma", path=["Sazzeechen"], page=3, text="De Komma steet *virun* datt.", examples=["mengen, datt"], cross_refs=["2"], variants=[dict(main="a", secondary="b")], subsections=["1.1", "1.2"]),
    dict(id="1.1", title="Virun datt", path=["Sazzeechen", "Komma"], page=4, text="Viru Niewesätz.", examples=["Wäin"], cross_refs=[], variants=[], subsections=[]),
    dict(id="1.2", title="Opzielung", path=["Sazzeechen", "Komma"], page=5, text="Wierder.", examples=["Bam/Beem"], cross_refs=[], variants=[], subsections=[]),
    dict(id="6.1.1", title="n-Reegel", path=["n"], page=9, text="Den n fält.", examples=["Wäin"], cross_refs=[], variants=[], subsections=[]),
]


def test_rules(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in RULES))
    book = lists.read_rules(spark, str(tmp_path / "r.jsonl")).cache()
    assert rules.search_rules(book, "where does a comma go", 1).first()["id"] == "1"
    assert rules.search_rules(book, "n-rule", 1).first()["id"] == "6.1.1"
    assert [r["id"] for r in rules.section(book, "§1.").collect()] == ["1", "1.1", "1.2"]
    assert [r["id"] for r in rules.sections_for_word(book, "Wäin").collect()] == ["1.1", "6.1.1"] and rules.sections_for_word(book, "Opzielung").first()["id"] == "1.2"
    assert [r["id"] for r in rules.contents(book).collect()] == ["1", "1.1", "1.2"]
    told = rules.rendered(book.where("id = '1'")).first()["markdown"]
    assert "Subsections: §1.1, §1.2" in told and "a / b" in told and told.endswith("§1, S. 3")
    assert {"bam", "beem", "bam/beem"} <= {r["word"] for r in lists.example_words(book).collect()}
    (tmp_path / "bad.jsonl").write_text("{oops")
    with pytest.raises(Exception):
        lists.read_rules(spark, str(tmp_path / "bad.jsonl")).collect()


def test_lists(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("# c\nfoo\tbar\tnote\nbad line\n\nFoo\tbaz\n")
    assert [tuple(r) for r in lists.read_germanisms(spark, str(tmp_path / "g.tsv")).collect()] == [("foo", "Foo", "baz", None)]
    (tmp_path / "n.md").write_text("<!-- x\ny -->\n# Notes\n")
    assert lists.read_markdown(spark, str(tmp_path / "n.md")).first()["text"] == "# Notes"
    (tmp_path / "w.dic").write_text("3\nhaut po:adverb\nHaut/e1k7 po:noun\nbei\n")
    assert {r["form"] for r in lists.read_wordlist(spark, str(tmp_path / "w.dic")).collect()} == {"haut", "Haut", "bei"}


def test_streams(spark, tmp_path):
    from lexmill.operators.orthography import check_orthography

    spark.createDataFrame([(1, "Strooß"), (2, "ok")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    check_stream(stream, check_orthography, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r["suggestion"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Strooss"]


def test_lookups(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps(ENTRY, ensure_ascii=False))
    (tmp_path / "h.json").write_text(json.dumps(HITS, ensure_ascii=False))
    e = L.read_entries(spark, str(tmp_path / "e.json")).cache()
    h = L.read_hits(spark, str(tmp_path / "h.json")).withColumn("query_key", F.lit("beem")).withColumn("lang", F.lit("lb")).cache()
    words = spark.createDataFrame([("Beem",)], "query string")
    assert [r["id"] for r in L.dictionary_search(h, " BEEM ", limit=1).collect()] == ["BEEM1"] and L.dictionary_search(h, "  ").count() == 0
    assert L.dictionary_entry(words, h, e, ("en",), False).first()["translations"] == {"en": "tree [a plant] (big); wood"}
    told = L.inflection(words, h, e).first()["markdown"]
    assert "auxiliary: hunn/sinn" in told and "| ech | baamen |" in told and "| du | baams |" in told
    with pytest.raises(ValueError):
        L.dictionary_search(h, "x", lang="xx")


def test_affixes(spark, tmp_path):
    (tmp_path / "a.aff").write_text("SET UTF-8\nFLAG num\nONLYINCOMPOUND 9\nPFX 1 N 1\nPFX 1 0 ver/2 [^aeiou-]\nSFX 2 Y 2\nSFX 2 en t en\nSFX 2 0 s/9 [a-]\n")
    (tmp_path / "a.dic").write_text("5\nstoen/1,2\noen/1\ndada/2\nfir/9\nkm\\/h\n")
    got = {r["form"] for r in hunspell.read_dictionary(spark, str(tmp_path / "a.dic"), str(tmp_path / "a.aff")).collect()}
    # The prefix doesn't go with other suffixes, but has one of its own; "dadas" stands only in compounds.
    assert got == {"stoen", "stot", "verstoen", "verstot", "oen", "dada", "km/h"}
    (tmp_path / "b.aff").write_text("AF 1\nAF xy\n")
    with pytest.raises(ValueError):
        hunspell.read_affixes(spark, str(tmp_path / "b.aff"))
    (tmp_path / "c.aff").write_text("SET UTF-8\n")
    (tmp_path / "c.dic").write_text("1\nhaut/xy po:adverb\n")
    assert [r["form"] for r in hunspell.read_dictionary(spark, str(tmp_path / "c.dic"), str(tmp_path / "c.aff")).collect()] == ["haut"]


def test_outside_lookups(spark, tmp_path):
    tried = []

    def flaky(key):
        tried.append(key)
        if len(tried) == 1:
            raise lookup.Passing("busy")
        return key.upper()

    assert lookup.attempt(flaky, "a", pause=0) == ("A", None) and tried == ["a", "a"]
    tried.clear()
    assert lookup.attempt(flaky, "a", attempts=1, pause=0) == (None, "Passing: busy")
    folder, calls = str(tmp_path / "kept"), tmp_path / "calls"
    calls.mkdir()

    def fetch(key):
        (calls / f"{key}-{time.time_ns()}").touch()
        if key == "bad":
            raise ValueError("no")
        return key * 2

    keys = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "key string")
    ask = lambda k, **more: sorted((r["key"], r["body"], r["error"]) for r in lookup.look_up(k, fetch, folder, 2, pause=0, **more).collect())
    want = [("a", "aa", None), ("bad", None, "ValueError: no")]
    assert ask(keys) == want and len(list(calls.iterdir())) == 2
    assert ask(keys) == want and len(list(calls.glob("a-*"))) == 1 and len(list(calls.glob("bad-*"))) == 2
    time.sleep(0.1)
    assert ask(keys.where("key = 'a'"), max_age=0.01) == want[:1] and len(list(calls.glob("a-*"))) == 2
    assert ask(keys.limit(0)) == []
