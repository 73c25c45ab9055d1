"""Checks on constructed sentences."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators.compose import Language, draft_check, n_rule_check, report, spell_check, summary
from lexmill.operators.grammar import TO_HUNN, TO_SINN, auxiliary_candidates, check_grammar, looks_like_participle
from lexmill.operators.nrule import check_n_rule, number_keeps_n, word_context
from lexmill.operators.orthography import check_orthography
from lexmill.operators.spelling import check_spelling, valid_words
from lexmill.operators.tokens import clauses, neighbours, tokenize, words
from lexmill.plans import catalogue

WORDS = "den de Mann Ball mir maachen maache Kaffi Apel Hond Direkter dat en Zuch ech kommen komme wann ass midd Zwee Phasen Phase Modell Haus schéin Geschicht eng Phas Ech hunn hu Saach Been doheem Gäert Kichen".split()
NOUNS = [("Stad", "Stad", "F", True), ("Haus", "Haus", "N", True), ("Kaffi", "Kaffi", "M", True), ("Auto", "Auto", "M", True), ("Zäit", "Zäit", "F", True), ("Kanner", "Kand", "N", False), ("Leit", "Leit", None, False), ("Frënn", "Frënd", "M", False), ("Fra", "Fra", "F", True), ("Mamm", "Mamm", "F", True)]
PARTICIPLES = [("gaangen", "goen", "sinn"), ("bliwwen", "bleiwen", "sinn"), ("gefuer", "fueren", "sinn"), ("gedronk", "drénken", "hunn"), ("ginn", "ginn", "both")]


@pytest.fixture(scope="module")
def docs(spark):
    return lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def wordlist(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "form string")


def by_doc(rows, n, say):
    out = [[] for _ in range(n)]
    for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], r["start"])):
        out[r["doc_id"]].append(say(r))
    return out


def test_tokens_cover_the_text(docs):
    texts = ["d'Kanner, z'Lëtzebuerg a Bus-Arrêt ’t", "", "den 10. 5ten Dag\n(3,5 %)", "😀 a"]
    rows = tokenize(docs(*texts)).collect()
    for k, t in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["pos"])
        assert "".join(r["text"] for r in own) == t
        assert all(t[r["start"] : r["end"]] == r["text"] for r in own)
    assert [r["text"] for r in rows if r["doc_id"] == 0 and r["type"] == "word"] == ["d'Kanner", "z'Lëtzebuerg", "a", "Bus-Arrêt", "’t"]


def test_neighbours(docs):
    rows = {r["text"]: r for r in neighbours(tokenize(docs('Moien. An „Haus" #Dag ech'))).collect()}
    assert rows["An"]["next_text"] == "Haus" and rows["An"]["quoted"] and rows["An"]["initial"]
    assert rows["Dag"]["hashtag"] and rows["ech"]["prev_word"] == "Dag" and rows["ech"]["next_type"] is None


def test_clauses(docs):
    rows = sorted(words(tokenize(docs("Ech weess, datt hien (haut) geet."))).collect(), key=lambda r: r["widx"])
    assert [(r["text"], r["break_after"]) for r in rows] == [("Ech", False), ("weess", True), ("datt", False), ("hien", True), ("haut", True), ("geet", True)]


def test_auxiliary_candidates(docs, spark):
    odd = [
        "Ech hunn gedronk, gebaut an gefuer hunn", "hunn. hunn", "gebaut ginn ass", "gebaut hunn gefuer ass.", "ass gebaut gefuer gedronk gaangen", "HUNN gebaut. 3.5 gebaut 1. ass, 5ten gefuer",
        "gebaut\u00a0ass’ ’t ass d’gebaut (ass) – gefuer ass", "", " \n", None, "...", "gebaut ass", "😀 hunn 😀 gefuer", "a b c hätt gebaut hues d'Gebaut gedronk war", "gebaut ginn gefuer hat; ass gefuer",
    ]
    rng = random.Random(6)
    parts = ["hunn", "ass", "Ass", "gebaut", "ginn", "gefuer", "Gebaut", "de", "’t", "3.5", "1.", ".", ",", "–", " ", " ", "'", "\t", "é"]
    texts = docs(*odd, *(" ".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(150)), *("".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(150)))
    rows = words(tokenize(texts)).collect()
    by_clause = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["widx"])):
        by_clause.setdefault((r["doc_id"], r["clause"]), []).append(r)
    assert {(r["doc_id"], r["clause"]): (r["first"], r["words"]) for r in clauses(texts).collect()} == {k: (v[0]["widx"], [r["text"] for r in v]) for k, v in by_clause.items()}
    aux = {*TO_SINN, *TO_HUNN}
    likely = {r["text"] for r in spark.createDataFrame([(t,) for t in sorted({r["text"] for r in rows})], "text string").where(looks_like_participle(F.col("text"), F.lower("text"))).collect()}
    want = set()
    for (doc, _), own in by_clause.items():
        for i, r in enumerate(own):
            if r["lower"] in aux:
                reach = next((j for j in range(i + 1, len(own)) if own[j]["lower"] in aux), len(own))
                near = own[max(i - 2, 0) : i] if i == len(own) - 1 else own[i + 1 : reach]
                want |= {(doc, r["widx"], r["lower"], x["widx"], x["text"], n) for n, x in enumerate([x for x in near[::-1] if x["text"] in likely][:3], 1)}
    columns = ["doc_id", "widx", "lower", "pidx", "participle", "n"]
    got, offsets = auxiliary_candidates(clauses(texts)).select(*columns).collect(), auxiliary_candidates(words(tokenize(texts)))
    assert len(got) == len(want) > 300 and set(map(tuple, got)) == want
    full = offsets.collect()
    assert len(full) == len(want) and {tuple(r[c] for c in columns) for r in full} == want
    at = {(r["doc_id"], r["widx"]): r for r in rows}
    assert all((r["start"], r["end"]) == (at[r["doc_id"], r["widx"]]["start"], at[r["doc_id"], r["widx"]]["end"]) and r["next"] == (n["text"] if (n := at.get((r["doc_id"], r["widx"] + 1))) else None) for r in full)


def test_auxiliary_candidates_move_no_rows(docs, tmp_path):
    docs("Ech hunn gedronk. the Haus that").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.queries()["w06_auxiliary_candidates"](docs("").sparkSession, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [r["participle"] for r in found.collect()] == ["gedronk"]
    assert not any(x in plan for x in ("Exchange", "Sort", "Window", "Join"))


def test_numbers_and_words(spark):
    numbers = {"1.": True, "5.": False, "8": True, "14": False, "21": True, "100": True, "400": False, "1000": True, "5000": False, "80": True, "1000000": None}
    got = spark.createDataFrame([(n,) for n in numbers], "t string").select("t", number_keeps_n(F.col("t")).alias("k")).collect()
    assert {r["t"]: r["k"] for r in got} == numbers
    said = {"Apel": "keep", "Mann": "drop", "Hond": "keep", "d'Kanner": "keep", "LCTO-Programm": "keep", "BMW": "drop", "Job": "keep", "Journal": "drop", "Chartervol": "keep", "Chef": "drop", "Centime": "optional", "si": "optional", "s": "optional", "yoga": "unknown", "Uni": "keep", "Union": "optional", "Gentleman": "keep"}
    got = spark.createDataFrame([(n,) for n in said], "t string").select("t", word_context(F.col("t"))["ctx"].alias("c")).collect()
    assert {r["t"]: r["c"] for r in got} == said


def test_n_rule(docs, wordlist):
    cases = {
        "den Mann": ["den→de:high"], "Den Mann": ["Den→De:high"], "mir maachen Kaffi": ["maachen→maache:medium"],
        "den Apel, den Hond, den Direkter, mir maachen dat, en Zuch": [], "de Apel": ["de→den:medium"], "Kaffi a Uebst": ["a→an:high"], "wa ech kommen": ["wa→wann:high"],
        "si ass midd": [], "den 5. Abrëll": ["den→de:high"], "den Journal": ["den→de:high"], "eng schéin Geschicht": ["schéin→schéi:high"], "Ech hu.": ["hu→hunn:high"],
        "en Zwee-Phasen-Modell": ["Phasen→Phase:medium"], "de Wäin gëtt gedronk, e Wäi schmaacht": [], "e Steen geheien": [], "Frënn gesinn, eng ronn Saach": [],
        "hunn si, vun senger Plaz": [], "och wann s de näischt matbréngs.": [], "zu Wien raschten": [], "Ech verkafen en (kaum benotzten) Computer.": [],
    }
    got = by_doc(check_n_rule(tokenize(docs(*cases)), wordlist), len(cases), lambda r: f"{r['word']}→{r['suggestion']}:{r['confidence']}")
    assert dict(zip(cases, got)) == cases


def test_n_rule_with_lexicon(spark, docs, wordlist):
    forms = spark.createDataFrame([("Kichen", "Kiche"), ("Mann", None)], "form string, n_form string")
    rows = check_n_rule(tokenize(docs("de Mann kacht an der Kichen gären")), wordlist, forms).collect()
    assert [(r["word"], r["suggestion"], r["confidence"], r["lod_confirmed"]) for r in rows] == [("Kichen", "Kiche", "high", True)]


def test_orthography(docs):
    cases = {
        "Wéi geet et ?": ["punct-space:?:10.2.3"], "Dat ass z.B. gutt.": ["abbreviation:z. B.:8.5.1"], "Et sinn 10% méi.": ["unit-space:10 %:8.5.1"],
        "Mir gesinn eis de méindeg.": ["capitalisation:Méindeg:8.3"], "Mir gi Sonndes spadséieren.": ["capitalisation:sonndes:8.3"], "gëschter mueren": ["capitalisation:Mueren:8.3"],
        "hie mëcht dat": ["e-accent:mécht:2.2.3"], "eng grouße Strooße": ["eszett:grousse:4.3.4.2", "eszett:Stroosse:4.3.4.2"], "Wanns de wëlls": ["linking-s:Wann s de:4.4.1"],
        "Ech mengen datt et reent.": ["comma:mengen, datt:10.3.1.3"], "Hien huet gesot - dat stëmmt.": ["dash: – :10.3.5"], "'T ass kal": ["apostrophe:'t:8.7.5"], "d' Haus": ["apostrophe:d'Haus:10.5.1"],
        "z'entdecken": ["apostrophe:ze entdecken:2.3.3"], "z'iessen": [], "d´Haus": ["apostrophe:d’H:2.3.3"], 'hie sot "jo" haut': ["quotes:„jo“:10.4.1"], "Dat ass richteg. et geet.": ["capitalisation:Et:8.7.5"],
        "eng Tësch": [], "eng Tésch": ["e-accent:Tësch:2.2.3"],
        "Ech mengen, datt et reent. Mir gi sonndes moies spadséieren, z. B. mat 10 % manner. Wéi geet et? Egal ob et reent.": [],
    }
    got = by_doc(check_orthography(docs(*cases)), len(cases), lambda r: f"{r['check']}:{r['suggestion']}:{r['rule']}")
    assert dict(zip(cases, got)) == cases
    rows = check_orthography(docs(*cases), ["eszett"]).collect()
    assert {r["check"] for r in rows} == {"eszett"}
    texts = list(cases)
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["text"] for r in rows)


def test_grammar(spark, docs):
    cases = {
        "Ech hunn gëschter an d'Stad gaangen.": "auxiliary:hunn→si:high", "Mir hunn eis doheem bliwwen.": "auxiliary:hunn→sinn:high", "Hien huet op Paräis gefuer.": "auxiliary:huet→ass:high",
        "Mir si gëschter an d'Stad gaangen an hunn e Kaffi gedronk.": None, "D'Haus ass gebaut ginn.": None, "Ech weess, datt hien gaangen huet.": "auxiliary:huet→ass:high", "Hien ass e Kaffi gedronk.": "auxiliary:ass→huet:low",
        "Mir ginn an de Stad.": "gender:de→d'Stad:high", "Ech hunn den Haus gesinn.": "gender:den→d'Haus:high", "D'Kaffi ass waarm.": "gender:D'Kaffi→De Kaffi:high", "Ech hunn d'Auto gesinn.": "gender:d'Auto→den Auto:high",
        "Ech hunn eng Kaffi gedronk.": "gender:eng→e:high", "Ech hunn e Zäit.": "gender:e→eng:high", "D'Kanner an d'Leit sinn am Haus, den Auto an d'Stad och.": None, "Wann s de Loscht hues, komm.": None,
        "Ech war mat meng Frënn do.": "case:mat meng→mat menge:high", "Ech kommen vun d'Stad.": "case:vun d'Stad→vun der Stad:high", "Ech fueren mat d'Auto.": "case:mat d'Auto→mam Auto:high", "Ech spillen mat d'Kanner.": "case:mat d'Kanner→mat de Kanner:high",
        "Ech schwätze mat eng Fra.": "case:mat eng→mat enger:high", "Ech war mat menge Frënn a mat der Mamm am Haus, mam Auto.": None, "Ech fueren mat dem Auto.": "contraction:mat dem→mam Auto:low",
    }
    d = docs(*cases)
    nouns = spark.createDataFrame(NOUNS, "form string, lemma string, gender string, is_lemma boolean")
    participles = spark.createDataFrame(PARTICIPLES, "form string, lemma string, aux string")
    got = by_doc(check_grammar(d, words(tokenize(d)), nouns, participles), len(cases), lambda r: f"{r['kind']}:{r['text']}→{r['suggestion']}:{r['confidence']}")
    for (text, want), have in zip(cases.items(), got):
        assert (have == []) if want is None else (want in have), (text, have)


def test_germanisms(spark, docs, wordlist):
    listed = spark.createDataFrame([("sehr", "sehr", "ganz, immens, vill", ""), ("wetter", "Wetter", "Wieder", None)], "german_key string, german string, lb string, note string")
    unknown = spark.createDataFrame([(0, "sehr", 8, 12), (0, "d'Wetter", 27, 35), (0, "getrunkt", 40, 48), (0, "Baum", 50, 54)], "doc_id long, word string, start int, end int")
    reverse = spark.createDataFrame([("Baum", "Bam", "noun (masculine)", "Baum", 1)], "german string, lemma string, pos string, sense string, ord int")
    from lexmill.operators.grammar import germanisms

    got = {r["text"]: (r["suggestion"], r["confidence"]) for r in germanisms(unknown, listed, reverse).collect()}
    assert got == {"sehr": ("ganz, immens, vill", "high"), "d'Wetter": ("d'Wieder", "high"), "getrunkt": ("(look up)", "low"), "Baum": ("Bam", "medium")}


def test_spelling(spark, docs, wordlist):
    judged = spark.createDataFrame([(w,) for w in ("Haus", "d'Haus", "Hauss", "'t", "Zwee-Phasen-Modell", "Zwee-Qqq", "EU-Modell", "Haus'")], "word string")
    assert {r["word"]: r["valid"] for r in valid_words(judged, wordlist).collect()} == {"Haus": True, "d'Haus": True, "Hauss": False, "'t": True, "Zwee-Phasen-Modell": True, "Zwee-Qqq": False, "EU-Modell": True, "Haus'": True}
    rows = check_spelling(tokenize(docs("D'Hauss vum Mann, EU a x. Foobar qwrt")), wordlist, ignore=["vum"]).collect()
    got = {r["word"]: list(r["suggestions"]) for r in rows}
    assert set(got) == {"D'Hauss", "Foobar", "qwrt"} and got["D'Hauss"][0] == "D'Haus"
    assert check_spelling(tokenize(docs("")), wordlist).count() == 0


def test_drafts(spark, docs, wordlist):
    listed = spark.createDataFrame([("sehr", "sehr", "ganz", "")], "german_key string, german string, lb string, note string")
    nouns = spark.createDataFrame(NOUNS, "form string, lemma string, gender string, is_lemma boolean")
    participles = spark.createDataFrame(PARTICIPLES, "form string, lemma string, aux string")
    language = Language(wordlist, listed, nouns, participles)
    d = docs("Ech hunn doheem bliwwen. Dat ass sehr Grouß.\nden Mann ?")
    rows = draft_check(d, language).collect()
    assert {(r["family"], r["text"]) for r in rows} >= {("grammar", "hunn"), ("grammar", "sehr"), ("n-rule", "den"), ("orthography", "Grouß"), ("orthography", " ?")}
    assert not any(r["family"] == "spelling" and r["text"] == "Grouß" for r in rows)  # a sure orthography finding covers it
    assert not any(r["family"] == "n-rule" and r["text"] == "hunn" for r in rows)  # the auxiliary check rewrites it
    told = report(draft_check(d, language), d).collect()[0]["markdown"]
    assert "### grammar" in told and "(2:1)" in told
    assert summary(draft_check(d, language), tokenize(d)).collect()[0]["words"] == 10
    assert {r["family"] for r in spell_check(d, language).collect()} == {"spelling", "n-rule", "orthography"}
    assert all(r["confidence"] == "high" for r in n_rule_check(d, language, min_confidence="high").collect())
