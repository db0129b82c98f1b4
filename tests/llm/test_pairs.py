import random
from datetime import datetime

from tessella.llm.pairs import count_ends, find_defects, history_pairs, is_copy, is_empty, is_truncated, spell_context
from tessella.llm.refusals import declines, fit, labelled_examples, refine
from tessella.llm.refusals import sentences as parts_of

DE = ["Die Datei bleibt {n} Tage erhalten.", "Nur Administratoren dürfen die Datei ändern.", "Das Archiv wird um Mitternacht gewechselt, solange der Code nicht erscheint.", "Öffnen Sie das Gehäuse des Gerätes nicht."]
EN = ["The archive is rotated at midnight.", "Only administrators may edit the file within {n} seconds.", "Press and hold the reset key for {n} seconds.", "The supply voltage drops to {n} volts on port {n}."]
ZH = ["檔案至少保留{n}天。", "只有管理員可以修改設定，同時保持警報佇列通電。", "請先抄下序號。", "供電電壓降到{n}伏特。"]


def sentences(rng, bank, n):
    join = "" if bank is ZH else " "
    return join.join(rng.choice(bank).format(n=rng.randrange(1, 60)) for _ in range(n))


WEIGHTS = fit(labelled_examples())


def is_refusal(answer):
    return declines(answer, WEIGHTS)


def test_empty_copy_refusal():
    for a in (None, "", " ​　", "N/A", "(none)", "<empty>", "…", "-", "null", "TBD", "。"):
        assert is_empty(a), a
    for a in ("No.", "0", "Yes.", "none of them fits", "161"):
        assert not is_empty(a), a
    q = "Who may edit cert.pem? (ticket ABCD-1)"
    for a in (q, q.upper(), "Q: " + q + "\nA: " + q, "You asked: " + q, "Who may edit cert.pem?", q + " " + q, "„" + q + "“"):
        assert is_copy(q, a), a
    for a in ("Who may edit cert.pem: only administrators.", "cert.pem", "edit"):
        assert not is_copy(q, a), a
    for a in ("I'm sorry, but I cannot help with that request.", "I can’t answer this", "I MUST DECLINE TO ANSWER QUESTIONS OF THIS KIND.", "The retrieved passages don't let me answer this.", "Dazu kann ich leider keine Auskunft geben.", "Je n'ai pas assez d'éléments dans les passages fournis pour répondre.", "Lo siento, no puedo ayudarle con esa petición.", "很抱歉，我無法回答這個問題。", "提供された文書からは回答できません。"):
        assert is_refusal(a), a
    for a in ("You can't change this on the panel; only users.toml holds the value.", 'If the screen says "I cannot answer", sign in.', "The unit cannot restart while an update is running.", "Sorry for the long path: open Alarms > History.", "Code E-1 bedeutet, dass keine Antwort kam.", "更新期間無法重新啟動。", "更新中は再起動できません。", "No abra la carcasa."):
        assert not is_refusal(a), a


def test_refusals_that_were_missed_or_wrong():
    for a in ("I'm not going to answer that.", "Non posso rispondere.", "Não posso responder a isso.", "Я не могу на это ответить.", "답변할 수 없습니다."):
        assert is_refusal(a), a
    for a in ("This manual does not provide the torque value here, but the answer is in table 5: 12 Nm.", "We do not have data sheets for the old pump; order sheet 12 from the depot.", "Je peux régler la pompe, mais je ne veux pas de bruit: tournez la vis à gauche."):
        assert not is_refusal(a), a


# Held-out sentences, worded apart from those that the model is fitted on.
HELD_OUT = {
    "en": (("Sadly I cannot offer an answer to your question.", "I would prefer not to discuss that.", "I do not have the information needed to answer this.", "I am unable to provide help on that subject.", "We can't give you an answer."), ("The pump cannot start while the lid is open.", "Set the port to 502 and restart the gateway.", "The lamp turns red if the cable is not connected.", "No filter is needed for clean air.", "Only the owner can delete the list.")),
    "de": (("Das kann ich Ihnen leider nicht beantworten.", "Zu diesem Thema darf ich keine Auskunft geben.", "Leider kann ich Ihnen dabei nicht helfen."), ("Die Pumpe startet nicht, solange der Deckel offen ist.", "Stellen Sie den Port auf 502.", "Der Filter muss nicht ersetzt werden.")),
    "fr": (("Désolé, je ne peux pas répondre à cela.", "Je ne suis pas autorisé à parler de ce sujet.", "Les documents ne permettent pas de répondre à la question."), ("La pompe ne démarre pas si le couvercle est ouvert.", "Réglez le port sur 502.", "Le filtre n'a pas besoin d'être remplacé.")),
    "es": (("Lo siento, no puedo contestar a eso.", "No tengo información suficiente para contestar la pregunta.", "No puedo ayudarle con esta pregunta."), ("La bomba no arranca si la tapa está abierta.", "Ajuste el puerto a 502.", "El filtro no se cambia nunca en verano.")),
    "zh": (("抱歉，我不能回答您的問題。", "這個問題我無法協助。", "文件內容不足，無法作答。"), ("蓋子打開時泵不能啟動。", "請將連接埠設為502。", "濾網不需要更換。")),
    "ja": (("申し訳ありませんが、お答えできません。", "その質問には回答できません。", "その件はお手伝いできません。"), ("カバーが開いているとポンプは起動できません。", "ポートを502に設定します。", "フィルターの交換は不要です。")),
    "it": (("Purtroppo non posso rispondere a questo.", "Non posso aiutarla."), ("La pompa non parte se il coperchio è aperto.", "Impostare la porta su 502.")),
    "pt": (("Infelizmente não posso responder a isso.", "Não posso ajudar com isso."), ("A bomba não liga com a tampa aberta.", "Ajuste a porta para 502.")),
    "ru": (("К сожалению, я не могу ответить на это.", "Я не могу помочь с этим вопросом."), ("Насос не включается при открытой крышке.", "Установите порт 502.")),
    "ko": (("죄송하지만 답변할 수 없습니다.", "그 질문은 도와드릴 수 없습니다."), ("덮개가 열려 있으면 펌프가 시작되지 않습니다.", "포트를 502로 설정합니다.")),
}


def test_refusals_held_out():
    found = {k: ([a for a in yes if not is_refusal(a)], [a for a in no if is_refusal(a)]) for k, (yes, no) in HELD_OUT.items()}
    missed, wrong = sum(len(m) for m, _ in found.values()), sum(len(w) for _, w in found.values())
    total = sum(len(yes) for yes, _ in HELD_OUT.values())
    assert missed <= 0.1 * total and wrong <= 0.1 * total, found


def test_refining_learns_the_wording_of_a_log():
    met = [x for k in range(200) for x in parts_of(f"Grommel {k} folgt. The blorb is set to {k} units in frame {k % 7}.")]
    weights = refine(labelled_examples(), met + ["sorry, i can't answer this for the frame."])
    assert not declines("The blorb is set to 9 units in frame 3.", weights) and declines("Sorry, I can't answer this for the frame.", weights)


def model():
    from collections import Counter

    rng = random.Random(1)
    counter = Counter()
    count_ends(counter, [sentences(rng, bank, 4) for bank in (DE, EN, ZH) for _ in range(400)])
    out = {}
    for key, n in counter.items():
        if (k := spell_context(key)) not in ("#", None):
            e, t = out.get(k[1:], (0, 0))
            out[k[1:]] = (e + n * (k[0] == "e"), t + n)
    return out


def test_truncated():
    m = model()
    for a in ("The archive is rotated at midnight. Only administrators may", "The archive is rotated at midnight. Press and hold the rese", "1. The archive is rotated at midnight.\n2.", "The archive is rotated at midnight.\n```\nset --", "The archive is rotated at midnight (", "Das Archiv wird um Mitternacht gewechselt, solange der", "請先抄下序號。只有管理員可以", "Press and hold the reset key for 7"):
        assert is_truncated(a, m), a
    for a in ("The archive is rotated at midnight. Press and hold the reset key for 7 seconds", "The archive is rotated at midnight", 'It says "ready".', "161", "cert.pem", "The archive is rotated at midnight.\n```\nset\n```", "請先抄下序號", "Yes.", "Is it warm?", "1. The archive is rotated at midnight.\n2. Only administrators may edit the file within 3 seconds."):
        assert not is_truncated(a, m), a


def test_found(spark):
    rng = random.Random(2)
    t = datetime(2025, 1, 1)
    docs = [(i, lang.upper() if i % 9 == 0 else lang, sentences(rng, bank, 12)) for i in range(300) for lang, bank in (("de", DE), ("en", EN), ("zh", ZH))]
    documents = spark.createDataFrame(docs, "doc_id bigint, lang string, text string")
    q = "Who may edit the file within 5 seconds?"
    fill = [("x", [(q, sentences(rng, EN, 3))] * 1, q, t)] * 1
    requests = [(f"f{i}", [(q, sentences(rng, rng.choice([EN]), 3)) for _ in range(3)], q, t) for i in range(150)] + fill
    requests += [("r", [(q, None), (q, q), (q, "I can't help with questions about it."), (q, sentences(rng, DE, 3)), (q, "The archive is rotated at midnight. Only administrators may"), (None, sentences(rng, DE, 2)), (q + " (reply in German please)", sentences(rng, DE, 3)), (q, "Port 161")], q, t)] * 2
    requests += [("n", None, q, t), (None, None, q, t), ("e", [], q, t)]
    r = spark.createDataFrame([(*x, 1) for x in requests], "request_id string, context array<struct<q:string,a:string>>, question string, received_at timestamp, item_index int")
    traces = spark.createDataFrame([("r", "", t), ("r", "", t), ("n", sentences(rng, ZH, 4), t), ("e", sentences(rng, EN, 2), t), ("other", "", t)], "request_id string, generated_answer string, logged_at timestamp")
    pairs = history_pairs(r, traces)
    assert pairs.filter("request_id = 'r'").count() == 9 and pairs.filter("request_id = 'n'").count() == 1
    got = sorted(tuple(x) for x in find_defects(pairs.selectExpr("*", "'x' as defect"), documents).collect())
    assert got == [("n", -1, "language"), ("r", -1, "empty"), ("r", 0, "empty"), ("r", 1, "copy"), ("r", 2, "refusal"), ("r", 3, "language"), ("r", 4, "truncated")]
    assert got == sorted(tuple(x) for x in find_defects(pairs, documents, heavy=10).collect())  # contexts that are joined tell the same as those that are sent
    assert find_defects(pairs.filter("false"), documents.filter("false")).count() == 0
