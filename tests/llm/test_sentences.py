import random
from collections import Counter

import pytest

from tessella.llm.sentences import Model, languages, learn, likelihood_ratio, quoted, sentence_spans, sentence_units, significant

EN = ["The archive is rotated at midnight.", "Compare No. {n} vs. No. {n} in the list.", "Dr. Ulmbrecht of the bay (cf. p. {n}) signed the sheet.", "The kit holds cables, lugs, etc.", "Cables, clamps, etc. are packed apart.", "Wait until {n} p.m. before you open the lid.", "The display reads \"Ready. Press OK.\" before the lid opens.", "Use approx. {n}.3 bar for the valve.", "mqttd must be stopped first.", "Is the lamp warm?", "Roll back to version {n}.3.4.", "The limit is {n} mm e.g. at the edge.", "Stop the unit at once!", "Press the key for {n} seconds.", "(This is not so on old units.)"]
DE = ["Am {n}. Mai wird das Gerät abgeschaltet.", "Zuerst wird z. B. die Lampe geprüft.", "Die Spannung fällt auf {n} Volt.", "Der Druck beträgt {n} bar, d. h. er ist zu hoch.", "Das Archiv wird um Mitternacht gewechselt.", "Die Anzeige meldet „Bereit. Taste drücken.“ und wartet."]
ZH = ["請先抄下序號。", "畫面顯示「就緒。請按確認。」後才會啟動。", "風扇模組是否過熱？", "等候數秒……再按一次。", "立即停機！"]
TH = ["ห้ามเปิดฝาครอบขณะเครื่องทำงาน", "กดปุ่ม OK ค้างไว้ 48 วินาทีแล้วปล่อย", "บันทึกค่าลงในไฟล์ broker.conf ทุกวัน"]
HI = ["आवरण को चलते समय न खोलें।", "तुरंत रोकें!", "दबाव 9.9 बार से अधिक न हो।"]
AR = ["لا تفتح الغطاء أثناء التشغيل.", "هل وحدة المراوح ساخن؟", "تظهر الشاشة «جاهز. اضغط موافق.» ثم تنتظر."]
FR = ["N'ouvrez pas le boîtier de l'appareil.", "La pression ne doit pas dépasser {n} bar, cf. p. {n} de la notice.", "Les câbles, colliers, etc. sont fournis.", "M. Orvel a signé la feuille.", "L'écran affiche « Prêt. Appuyez sur OK. » puis attend.", "Le voyant est-il rouge ?", "Arrêtez l'appareil tout de suite !", "La version {n}.2.2 modifie le démarrage."]
ES = ["No abra la carcasa del equipo.", "La presión llega a {n} bar, p. ej. en verano.", "El Sr. Dorune firmó la hoja.", "Los cables, bridas, etc. van aparte.", "¿Está caliente la lámpara?", "La pantalla muestra «Listo. Pulse OK.» y espera.", "Pulse la tecla durante {n} segundos.", "¡Pare el equipo de inmediato!"]
JA = ["カバーを開けないでください。", "画面に「準備完了。確認を押してください。」と表示されます。", "ファンは熱いですか？", "{n}秒間押し続けます。", "すぐに停止してください！"]
RU = ["Не открывайте корпус изделия.", "Давление доходит до {n} бар, см. рис. {n} в книге.", "Кабели, скобы и т. д. лежат отдельно.", "Лампа горит?", "Экран показывает «Готово. Нажмите ОК.» и ждёт.", "Немедленно остановите насос!", "Архив меняется в полночь."]
BANKS = {"en": (EN, " "), "de": (DE, " "), "fr": (FR, " "), "es": (ES, " "), "zh": (ZH, ""), "ja": (JA, ""), "ru": (RU, " "), "th": (TH, " "), "hi": (HI, " "), "ar": (AR, " ")}


def made(rng, lang, n):
    bank, blank = BANKS[lang]
    parts = [rng.choice(bank).format(n=rng.randrange(2, 60)) for _ in range(n)]
    text, spans = "", []
    for p in parts:
        text += (rng.choice([blank, "\n" if blank else ""]) if text else "")
        spans.append((len(text), len(text) + len(p)))
        text += p
    return text, spans


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [("text", made(rng, lang, rng.randrange(1, 6))[0]) for lang in BANKS for _ in range(500)]
    return learn(spark.createDataFrame(rows, "kind string, text string"))


def test_learned(model):
    assert {"no", "dr", "p", "etc", "approx", "vs", "cf"} <= model.abbreviations["en"] and {"z", "d", "h"} <= model.abbreviations["de"]
    assert ("#", "mai") in model.collocations["de"] and "umidnight" not in model.starters["en"] and "midnight" not in model.abbreviations["en"] and "lmqttd" in model.starters["en"]


@pytest.mark.parametrize("lang", list(BANKS))
def test_held_out_accuracy(model, lang):
    rng = random.Random(99)
    right = total = made_of = 0
    for _ in range(300):
        text, spans = made(rng, lang, rng.randrange(1, 7))
        got = sentence_spans(text, "text", model)
        right += len(set(got) & set(spans))
        total, made_of = total + len(got), made_of + len(spans)
    assert right / total > 0.99 and right / made_of > 0.99, (lang, right, total, made_of)


def spans(text, model, kind="text"):
    return [text[a:b] for a, b in sentence_spans(text, kind, model)]


def test_cases(model):
    assert spans("3. The archive is rotated at midnight. Is it?", model) == ["3. The archive is rotated at midnight.", "Is it?"]
    assert spans("Step 2: Press it. (4) Then stop.", model)[0] == "Step 2: Press it."
    assert spans("the lid opens.The archive is rotated at midnight.", model) == ["the lid opens.", "The archive is rotated at midnight."]
    assert spans("See users.toml at 10.0.2.1 now. mqttd must be stopped first.", model) == ["See users.toml at 10.0.2.1 now.", "mqttd must be stopped first."]
    assert spans("  \n Ready is it.\n\n ", model) == ["Ready is it."]
    assert spans("A line\nbreak ends nothing. So", model) == ["A line\nbreak ends nothing.", "So"]
    assert spans("Th​e arch﻿ive is rotated at midnight.​ Is it?", model)[1].strip("​ ") == "Is it?"
    assert spans("It is done. (2)", model) == ["It is done. (2)"]
    for kind in ("heading", "table_row", "code"):
        assert spans(" One. Two. ", model, kind) == ["One. Two."]
    assert sentence_spans(None, "text", model) == sentence_spans(" 　", "text", model) == sentence_spans("", None, model) == []
    assert len(sentence_spans("The archive is rotated at midnight. " * 5000, None, model)) == 5000


def test_parts():
    assert quoted('a "b. c" d „e“ «f «g» h»') == [(2, 7), (11, 13), (18, 20), (15, 23)] or len(quoted('a "b. c" d „e“')) == 2
    assert quoted('5" and 6" pipes') == [] and languages("Die Spannung fällt auf")[0] == "de" and languages("重新啟動 MQTT") == ("zh",)
    assert 3.8 < significant(1, 0.05) < 3.9 and 10.8 < significant(1) < 10.9 < significant(1000)
    assert Model().of(("en",)) == (set(), set(), set())


def test_likelihood_ratio(spark):
    df = spark.createDataFrame([(50.0, 100.0, 5.0, 1000.0), (0.0, 0.0, 1.0, 2.0), (5.0, 10.0, 50.0, 100.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(likelihood_ratio(*(df[c] for c in "abcd"))).collect()]
    assert got[0] > 100 and got[1] == 0 and abs(got[2]) < 1e-9


RARE = ["Насос см. рис. 5 работает.", "Клапан см. табл. 7 закрыт.", "Насос включён.", "Клапан открыт.", "Не открывайте корпус."]


def test_a_rare_language_finds_its_abbreviations(spark):
    rng = random.Random(2)
    rows = [("text", made(rng, "en", 6)[0]) for _ in range(30_000)] + [("text", " ".join(rng.sample(RARE, 3))) for _ in range(100)]
    assert {"см", "рис", "табл"} <= learn(spark.createDataFrame(rows, "kind string, text string")).abbreviations["ru"]


def test_equal_ids_of_two_sources_are_two_records(spark):
    df = spark.createDataFrame([("block", "a", "text", "One. Two."), ("unit", "a", "text", "Three."), ("unit", "a", "text", "Three.")], "source string, record_id string, kind string, text string")
    assert sentence_units(df).count() == 3


def test_operator(spark):
    rows = [("a", "text", "It runs. It stops."), ("a", "text", "It runs. It stops."), ("b", None, None), (None, "text", "x"), ("c", "text", " "), ("d", None, "One")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "record_id string, kind string, text string, start_char int")
    got = Counter(tuple(r) for r in sentence_units(df).collect())
    assert got == Counter({("a", 0, 8): 1, ("a", 9, 18): 1, ("d", 0, 3): 1})
    assert sentence_units(df.filter("false")).count() == 0
