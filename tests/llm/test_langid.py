import pytest
from pyspark.sql import functions as F

from vitalframe.llm import langid

BASE = {
    "en": ["The watch stopped syncing around noon so the rest of the day is missing.", "Please ask your doctor about the reading if it stays above this.", "I had a dull headache when I woke up but it went away.", "Keep the next workout gentle because recovery is only partial."],
    "de": ["Die Uhr hat gegen Mittag aufgehört zu senden, deshalb fehlt der Rest des Tages.", "Bitte sprich mit deinem Arzt, wenn der Wert darüber bleibt.", "Beim Aufwachen hatte ich einen steifen Nacken, aber das wurde später besser.", "Halte das nächste Training leicht, denn die Erholung ist gering."],
    "sv": ["Klockan slutade synka vid lunch, så resten av dagen saknas.", "Prata med din läkare om värdet ligger kvar över det.", "Jag hade huvudvärk när jag vaknade men det gick över.", "Ta det lugnt på nästa träningspass eftersom återhämtningen är låg."],
    "da": ["Uret holdt op med at synkronisere ved middag, så resten af dagen mangler.", "Tal med din læge, hvis værdien bliver ved med at være over det.", "Jeg havde hovedpine, da jeg vågnede, men det gik over.", "Tag det roligt ved næste træning, for restitutionen er lav."],
    "fr": ["La montre a cessé de synchroniser vers midi, le reste de la journée manque donc.", "Parlez-en à votre médecin si la valeur reste au-dessus.", "Au réveil j’avais un mal de tête, mais c’est passé.", "Gardez la prochaine séance légère, car la récupération est faible."],
}


@pytest.fixture(scope="module")
def model():
    rows = [(lang, f"{a} {b}") for lang, xs in BASE.items() for a in xs for b in xs]
    wrong = [("fr", f"{a} {b}") for a in BASE["en"] for b in BASE["en"][:1]]  # some labels are wrong
    return langid.fit(rows + wrong)


def langs(text, model):
    return [(no, lang) for no, lang, _, _ in langid.segments_of(text, model)]


def test_single_and_mixed(model):
    assert langs(BASE["en"][0], model) == [(1, "en")]
    assert langs(BASE["de"][0].upper(), model) == [(1, "de")]
    assert langs(langid.plain_letters(BASE["da"][1]), model) == [(1, "da")]
    assert langs(" ".join(BASE["en"][:2] + BASE["de"][:2] + BASE["en"][2:3]), model) == [(1, "en"), (2, "de"), (3, "en")]
    assert langs(BASE["sv"][0] + "\n" + BASE["da"][2], model) == [(1, "sv"), (2, "da")]
    assert langs("昨夜の睡眠は4.1時間で、ふだんより短いです。" + BASE["fr"][0], model) == [(1, "ja"), (2, "fr")]
    assert langs("Поговорите с врачом. " + BASE["en"][1], model) == [(1, "ru"), (2, "en")]


@pytest.mark.parametrize(
    "text,lang",
    [
        ("Η καρδιακή συχνότητα ήταν χαμηλή σήμερα.", "el"), ("كان معدل ضربات القلب منخفضا اليوم.", "und"), ("Частота серцевих скорочень сьогодні була низькою, її показники в нормі.", "uk"),
        ("今天心率较低，睡眠质量很好，请继续保持健康的生活方式。", "und"), ("오늘 심박수가 낮았고 수면이 좋았습니다.", "ko"), ("Поговорите с врачом", "ru"), ("今日は心拍数が低いです。", "ja"), ("ꀀꀁꀂ", "und"),
    ],
)
def test_languages_the_model_does_not_know(model, text, lang):
    assert langs(text, model) == [(1, lang)]
    assert langs(BASE["en"][0] + " " + BASE["en"][1] + "\n" + text * 3, model) == [(1, "en"), (2, lang)]


def test_sentence_ends():
    cut = langid.split_sentences
    assert [x.strip() for x in cut('One. Two! "Three?" Four… Five。六！七\neight / nine - 3.5 a/b')] == ["One.", "Two!", '"Three?"', "Four…", "Five。", "六！", "七", "eight /", "nine - 3.5 a/b"]


def test_quotes_codes_and_figures_make_no_segment(model):
    assert langs(BASE["en"][0] + " (“dolce far niente”)", model) == [(1, "en")]
    assert langs(BASE["de"][0] + '\nLDL 36 mg/dL < 116\n{"metric":"spo2","value":80}', model) == [(1, "de")]
    assert langs("23:00に友だちと緑茶をとりました", model) == [(1, "ja")]
    for none in (None, "", " \t", "97.2%", "👍🏽👍🏽", "LDL 36 mg/dL < 116\nCRP 62 mg/L < 5", "0000000"):
        assert langs(none, model) == []


def test_confidence_and_viterbi(model):
    assert all(0 < c <= 1 for _, _, c, _ in langid.segments_of(BASE["en"][0] + " " + BASE["fr"][1], model))
    import numpy as np

    scores = np.full((5, len(langid.LANGUAGES)), -20.0)
    scores[:, 0] = [0, 0, -3, 0, 0]
    scores[:, 1] = [-9, -9, 0, -9, -9]
    assert langid.viterbi(scores) == [0] * 5  # one weak sentence doesn't pay two changes
    scores[2, 0] = -13
    assert langid.viterbi(scores) == [0, 0, 1, 0, 0]


@pytest.mark.parametrize("label,code", [("EN", "en"), ("en_GB", "en"), ("pt-BR", "pt"), ("ger", "de"), (" Deutsch ", "de"), ("xx", None), ("mul", None), ("??", None), ("", None), (None, None), ("Japanese", "ja"), ("nld", "nl")])
def test_labels(spark, label, code):
    assert spark.createDataFrame([(label,)], "l string").select(langid.label_language(F.col("l"))).first()[0] == code


def test_table(spark, model):
    rows = [(1, BASE["en"][0], "en", 9), (2, BASE["en"][0], "de", 9), (3, None, "en", 9), (4, "", None, 9), (5, BASE["en"][0] + " " + BASE["de"][1], "en", 9), (1, BASE["en"][0], "en", 9), (6, (BASE["fr"][0] + " ") * 2000, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, seg_no int")
    got = sorted((r.doc_id, r.seg_no, r.lang, r.n_segments, r.label_lang) for r in langid.label_segments(df, model=model).collect())
    assert got == [(1, 1, "en", 1, "en"), (1, 1, "en", 1, "en"), (2, 1, "en", 1, "de"), (5, 1, "en", 2, "en"), (5, 2, "de", 2, "en"), (6, 1, "fr", 1, None)]
    assert langid.label_segments(df.limit(0), model=model).count() == 0
    assert langid.label_segments(df.limit(0)).count() == 0  # nothing to fit on


def test_held_out_accuracy(spark):
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    docs = spark.read.parquet(path)
    fitted = langid.fit_on(docs.filter("doc_id % 2 = 0"), "text", "lang")
    got = langid.label_segments(docs.filter("doc_id % 2 = 1"), model=fitted).filter("n_segments = 1 and label_lang is not null")
    agree, n = got.selectExpr("avg(cast(lang = label_lang as double)) as a", "count(*) as n").first()
    assert n > 200 and agree > 0.85  # about a tenth of the labels are wrong
