import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import langid as L

LINES = {
    "da": "Hvis din indkomst overstiger beløbet, skal du give os besked inden årsskiftet.",
    "en": "If your income is above the limit, you must tell us before the end of the year.",
    "de": "Wenn Ihr Einkommen über der Grenze liegt, müssen Sie uns bis zum Jahresende informieren.",
    "sv": "Om din inkomst är högre än beloppet måste du berätta det för oss före årsskiftet.",
    "nb": "Hvis inntekten din er høyere enn beløpet, må du gi oss beskjed innen nyttår.",
    "uk": "Якщо ваш дохід перевищує цю суму, повідомте нас до кінця року.",
}


MORE = {
    "da": "Når det bliver sent, får du også noget mere af mig, hvis der blev givet besked, og hvad hjælper det dig eller os, hvor de er efter ferien?\nHvis du bliver syg, skal du give os besked inden din ferie, før det bliver dyrt, og noget mere om det får du af os efter årsskiftet.",
    "en": "It is not always possible, but you can get help from us if you have questions about it.",
    "de": "Das ist nicht immer möglich, aber wir können Ihnen helfen, wenn Sie eine Frage haben.",
    "sv": "Det är inte alltid möjligt, men du kan få hjälp av oss om du har frågor och vill veta mer.",
    "nb": "Det er ikke alltid mulig, men dere kan få hjelp av oss hvis dere har noe å spørre om etter hvert.\nNår dere har noe å spørre om, må dere gi oss beskjed, og hvis inntekten din blir høyere enn nå, hvordan blir det innen nyttår uten oss?",
    "uk": "Це не завжди можливо, але ви можете звернутися до нас, якщо у вас є питання про це.",
}


@pytest.fixture(scope="module")
def filters():
    return L.train([(x + "\n" + MORE[k], k) for k, x in LINES.items()] * 3)


@pytest.mark.parametrize("lang", sorted(LINES))
def test_lines(filters, lang):
    bare = L.train([])
    for f in (filters, bare):
        found, sure = L.detect(f, L.Words(), [LINES[lang], LINES[lang].upper(), "", "123"])
        assert found[:2] == [lang, lang] and found[2:] == [None, None] and sure[2] == 0 and sure[0] > 0


def test_most_words_decide(filters):
    found, sure = L.detect(filters, L.Words(), [LINES["da"] + " Please tell us.", LINES["da"], "Ja, please tell us before the end of the year."])
    assert found == ["da", "da", "en"] and (sure > 0).all()


@pytest.mark.parametrize("line", ["Les étudiants inscrits doivent informer le service avant la fin du mois prochain.", "Jos tulosi ylittävät rajan, sinun täytyy ilmoittaa siitä meille ennen vuoden loppua.", "Jeśli twój dochód przekracza limit, musisz nas o tym poinformować przed końcem roku."])
def test_other_languages(filters, line):
    assert L.detect(filters, L.Words(), [line])[0] == ["other"]


def test_filters_hold_what_was_added(filters):
    ws = L.words_of(LINES["da"])
    g, _ = L.grams(L.Words()(ws), np.zeros(len(ws), int), np.zeros(len(ws), bool))
    assert ((filters.languages(g) >> 0 & 1) == 1).all()
    assert (filters.false < 0.01).all()


def test_labels(spark):
    labels = [("da", "da"), ("DAN", "da"), ("en_GB", "en"), ("uk-UA", "uk"), (" sv ", "sv"), ("no", "nb"), ("auto", None), ("xx", None), ("", None), (None, None), ("unknown", None), ("?", None)]
    df = spark.createDataFrame(labels, "l string, want string")
    assert all(r.got == r.want for r in df.select("want", L.label_language(F.col("l")).alias("got")).collect())


def test_records(spark, filters):
    rec = spark.createDataFrame([("a", 0, "da", 1), ("a", 0, None, 1), ("a", -1, "da", 1), ("b", 1, "EN-us", 1), (None, 0, "da", 1), ("z", 0, "da", 1)], "doc_id string, section_index int, language string, line_no int")
    text = LINES["da"] + "\n\nhttps://www.example.com/en/lang/sti/til/en/side\nkort\n" + LINES["en"]
    sec = spark.createDataFrame([("a", 0, "old", None), ("a", 0, text, 5), ("a", -1, text, 1), ("b", 1, text, 1), ("c", 1, text, 1), ("z", 0, None, 1)], "doc_id string, section_index int, content string, scraped_at int")
    got = {(r.doc_id, r.section_index, r.language, r.line_no, r.line_lang) for r in L.record_lines(rec, sec, filters).collect()}
    assert got == {("a", 0, x, n, k) for x in ("da", None) for n, k in ((0, "da"), (4, "en"))} | {("b", 1, "EN-us", 0, "da"), ("b", 1, "EN-us", 4, "en")}
    assert L.record_lines(rec.limit(0), sec, filters).count() == 0 == L.record_lines(rec, sec.limit(0), filters).count()


def test_documents(spark, filters):
    df = spark.createDataFrame([(1, LINES["da"] + "\n" + LINES["da"] + "\n" + LINES["en"], "xx"), (2, None, "da"), (3, "", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in L.document_languages(df, filters).collect()}
    assert (got[1].lang_found, got[1].n_lines, got[1].n_other_lines) == ("da", 3, 1) and got[2].lang_found is None and 3 in got
    assert L.document_languages(df.limit(0), L.fit(df.limit(0))).count() == 0
