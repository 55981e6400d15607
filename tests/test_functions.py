"""Functions on literal rows, quirks included."""

import datetime

import pytest
from pyspark.sql import functions as F

from vacantia.functions import fuzzy, records, rules
from vacantia.functions import text as T


@pytest.fixture
def value(spark):
    def get(make, *texts, kind="string"):
        df = spark.createDataFrame([texts], ", ".join(f"c{i} {kind}" for i in range(len(texts))))
        return df.select(make(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first()["v"]

    return get


def test_tags_and_entities(value):
    assert value(T.remove_html, "<b>a</b>&amp;b ") == "a&b"
    assert value(T.clean_description, "<p>x</p><p>y&eacute;</p>") == "x yé"
    assert value(T.breaks_to_space, "a<br/>b<i>c</i>") == "a bc"
    assert value(T.basic_unescape, "&lt;x&gt; &amp;amp;") == "<x> &amp;"


def test_title(value):
    assert value(T.clean_title, "🚀 Dev!!!??  <b>now</b>") == "Dev? now"
    assert value(T.clean_title, None) == ""


def test_keys(value):
    assert value(T.dedup_key, "C++,  Gestión!") == "c gestión"
    assert value(T.normalize_text, "C++ y C#") == "c y c"
    assert value(T.matching_form, "Programación  (C++)") == "programacion c"
    assert value(T.to_ascii, "ｱé①") == "e1"
    assert value(T.title_case, "c++ machine-learning") == "C++ Machine-Learning"


def test_combined_text(value):
    assert value(T.combined_text, "a", "", None) == "a"
    assert value(T.combined_text, "a", "b", "c") == "a\nb\nc"


def test_hash_of_missing_parts(value):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert value(T.content_hash, "a", None, "c") == sha("ac")
    assert value(lambda a, b, c: T.content_hash(a, b, c, literal_none=True), "a", None, "c") == sha("aNonec")


def test_ngrams(value):
    got = [(r["ngram"], r["start"], r["end"], r["size"]) for r in value(lambda c: T.ngrams(c, 2), "a b c")]
    assert got == [("a", 0, 0, 1), ("b", 1, 1, 1), ("c", 2, 2, 1), ("a b", 0, 1, 2), ("b c", 1, 2, 2)]
    assert value(lambda c: T.ngrams(c, 2), "") == []


def test_junk(value):
    assert tuple(value(rules.junk, "Dev", "short")) == (True, "Empty or extremely short description")
    assert value(rules.junk, "Colombia Test 7", "x" * 60)["is_junk"]
    assert not value(rules.junk, "Tester", "x" * 60)["is_junk"]


@pytest.mark.parametrize(("title", "body", "want"), [("iOS dev", "", "mobile"), ("x", "we use react and html", "frontend"), ("x", "react with a backend", "backend"), ("x", "nothing here", "other"), ("x", "big data", "data_science")])
def test_role(value, title, body, want):
    assert value(rules.role, title, body) == want


def test_language_and_seniority(value):
    assert value(rules.language, "experiencia años requisitos") == "es"
    assert value(rules.language, "experience years") == "en"
    assert value(rules.language, "experience años") == "mixed"
    assert value(rules.seniority, "Sr. Dev", "") == "senior"


def test_quality_score_bounds(value):
    assert value(rules.quality_score, "", "", "") == 50
    assert value(rules.quality_score, "developer", "python java sql " * 300, "y" * 200) == 93


def test_missing_reason(value):
    assert value(rules.missing_reason, "React Native", "we like native apps") == "in_text_variation"
    assert value(rules.missing_reason, "CI/CD", "we do ci daily") == "acronym"
    assert value(rules.missing_reason, "Go", "python") == "not_in_text"


def test_llm_skill(value):
    assert value(rules.llm_skill, "Python")["is_valid"]
    assert not value(rules.llm_skill, "3 años de experiencia")["is_valid"]
    assert value(rules.llm_skill, "  ")["reason"] == "Empty skill"


@pytest.mark.parametrize(("said", "want"), [("hace 3 días", "2024-03-07"), ("Ayer", "2024-03-09"), ("hoy", "2024-03-10"), ("05/02/2024", "2024-02-05"), ("23 de Agosto de 2023", "2023-08-23"), ("Publicado 1 Ene 2024", "2024-01-01"), ("32/13/2024", None), ("", None)])
def test_posted_date(value, said, want):
    got = value(lambda c: records.posted_date(c, F.lit("2024-03-10").cast("date")), said)
    assert got == (datetime.date.fromisoformat(want) if want else None)


def test_money(value):
    assert value(records.salary, "Salario: $ 2.500.000 + prestaciones") == "$ 2,500,000 COP"
    assert value(records.salary, "Salario confidencial") == "Salario confidencial"
    assert value(records.salary, "nothing") == ""


def test_maps(value):
    assert value(records.employment_type, "PART_TIME") == "Medio tiempo"
    assert value(records.employment_type, "X") == "X"
    assert value(records.contract_type, "contrato a tiempo completo") == "Tiempo completo"
    assert value(records.remote_type, "trabajo híbrido") == "Híbrido"
    assert value(records.workplace_type, " WFH ") == "Remote"


def test_requirements(value):
    assert value(records.requirements, "Hola. Se requiere inglés fluido. Al menos tres cosas! Fin.") == "Al menos tres cosas; Se requiere inglés fluido."


def test_urls(value):
    assert value(records.canonical_url, "https://x.com/v?a=1&jk=9#t") == "https://x.com/v?jk=9"
    assert value(records.canonical_url, "https://x.com/v?a=1") == "https://x.com/v"


@pytest.mark.parametrize(("answer", "want"), [('```json\n{"a": ["x"]}\n```', '{"a": ["x"]}'), ('["x", "y"]', '{"skills": ["x", "y"]}'), ('Sure: {"a": ["x", "y"', '{"a": ["x", "y"]}'), ('{"a": ["x"}', '{"a": ["x"]}'), ("nothing", None)])
def test_repair_json(value, answer, want):
    assert value(records.repair_json, answer) == want


def test_ratio():
    assert fuzzy.ratio("react", "react") == 1.0
    assert fuzzy.ratio("abcd", "abed") == pytest.approx(0.75)
    assert fuzzy.ratio("", "") == 1.0
    assert fuzzy.partial_ratio("react", "react native") == 1.0
    assert fuzzy.ratio("rest", "restaurar") < 0.92


def test_trigram_similarity(value):
    assert value(fuzzy.trigram_similarity, "word", "two words") == pytest.approx(4 / 11)
    assert value(fuzzy.trigram_similarity, "", "") == 0.0


@pytest.mark.parametrize(("skill", "label", "want"), [("html", "html basics", 0.95), ("web", "web", 0.92), ("web", "the web", 0.88), ("html", "html5", 0.87), ("script", "javascript", 0.80), ("x", "abc", 0.0)])
def test_substring_ladder(value, skill, label, want):
    assert float(value(fuzzy.substring_confidence, skill, label)) == want
