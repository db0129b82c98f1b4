"""A classifier of answers that decline to answer.

Method: logistic regression on the presence of n-grams of words (of characters where words are not set apart), fitted on labelled
sentences, then fitted again with a bounded sample of the log's own sentences, which decline where the first fit is sure
of it and are sound otherwise (self-training). So it takes the wording of the log at hand into account, and knows what its sound answers look like. An answer
declines if one of its first sentences does and little else is said.

The labelled sentences below are a start; `labelled` rows of the caller's own (text, declines) are added to them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labelled sentences, those that decline first, by language.
EXAMPLES = {
    "en": (
        ("I'm sorry, but I cannot help with that.", "I can't answer this.", "I can't help with questions about this device.", "I am unable to answer anything about that.", "Sorry, we cannot advise on this unit.", "My apologies: I can't help with it.", "My apologies, this is not a question that I may answer.", "I am not able to give advice on this subject.", "I must decline to answer.", "I have to refuse this request.", "Unfortunately I don't have enough information in the documents to answer.", "No answer can be given to that question.", "The passages don't let me answer.", "The sources provided do not contain the information needed to reply.",
         "This is outside what I can help with.", "That lies beyond what I am allowed to talk about.", "I'm not permitted to discuss this.", "It would not be right for me to speculate.", "That isn't something I can discuss.", "I'd rather not say anything about that.", "I'm not going to answer that.", "I won't comment on this question.", "We are unable to assist with your inquiry."),
        ("The unit cannot restart while an update is running.", "You can't change this on the panel; only the file holds the value.", "Do not open the housing.", "The manual does not give the value here, but the answer is in table 0: 0 bar.", "We do not have sheets for the old valve; order sheet 0 from the store.", "No reply from the device means that the cable is loose.", "If you are not able to sign in, reset the password.", "It is not possible to edit the file without rights.", "Sorry for the long path: open the menu first.", "I can confirm that the port is 0.", "Which unit do you mean?", "Yes.", "Yes, with one limit: only one session can be open.", "That is not supported.", "The parts are packed separately.", "What should I check after that?", "The server refuses the connection on port 0.", "Only administrators may edit the file.", "The code means that the board did not answer.", "The archive is rotated at midnight.", "Press and hold the reset key for 0 seconds.", "Information about the alarm is stored in the list.", "Please ask your administrator to open the port.", "The link is outside the allowed range of 0 to 0."),
    ),
    "de": (
        ("Dazu kann ich leider keine Auskunft geben.", "Bei dieser Anfrage kann ich nicht helfen.", "Diese Frage lässt sich anhand der Unterlagen nicht beantworten.", "Ich darf darüber nicht sprechen.", "Ich muss die Antwort ablehnen.", "Dafür fehlen mir die nötigen Informationen.", "Es tut mir leid, das kann ich nicht beantworten.", "Darauf möchte ich nicht eingehen.", "Die Dokumente reichen für eine Antwort nicht aus."),
        ("Öffnen Sie das Gehäuse nicht.", "Der Code bedeutet, dass keine Antwort kam.", "Das Gerät kann während der Aktualisierung nicht neu starten.", "Ich kann die Pumpe einstellen, drehen Sie das Ventil nach links.", "Nur Administratoren dürfen die Datei ändern.", "Welches Gerät meinen Sie?", "Ohne Rechte lässt sich die Datei nicht ändern.", "Die Datei bleibt 0 Tage erhalten.", "Fragen Sie bitte Ihren Administrator nach dem Port."),
    ),
    "fr": (
        ("Je suis désolé, mais je ne peux pas vous aider.", "Je ne peux pas répondre à cette question.", "Cette question dépasse ce que je suis autorisé à traiter.", "Je n'ai pas assez d'informations dans les documents pour répondre.", "Il m'est impossible de répondre.", "Je préfère ne pas me prononcer sur ce sujet.", "Je dois refuser cette demande.", "Les passages fournis ne permettent pas de répondre."),
        ("L'appareil ne peut pas redémarrer pendant une mise à jour.", "N'ouvrez pas le boîtier.", "Je peux régler la vanne, mais je ne veux pas de fuite: tournez-la à droite.", "Seuls les administrateurs peuvent modifier le fichier.", "De quel appareil parlez-vous?", "Le code signifie que la carte n'a pas répondu.", "Le fichier est conservé 0 jours.", "Sans droits il n'est pas possible de modifier le fichier."),
    ),
    "es": (
        ("Lo siento, no puedo ayudarle con eso.", "No puedo responder a esta pregunta.", "No dispongo de información suficiente para responder.", "No me está permitido contestar.", "Debo rechazar esta petición.", "Eso supera lo que puedo tratar.", "Los documentos no permiten dar una respuesta.", "Prefiero no hablar de ese tema."),
        ("El equipo no puede reiniciarse durante una actualización.", "Espere a que termine y no lo abra.", "No abra la carcasa.", "Solo los administradores pueden modificar el archivo.", "¿De qué equipo habla?", "El código indica que la placa no respondió.", "El archivo se conserva 0 días.", "Sin permiso no es posible cambiar el archivo."),
    ),
    "zh": (
        ("很抱歉，我無法回答這個問題。", "對不起，我不能回答。", "抱歉，我无法提供帮助。", "這超出我可以協助的範圍。", "所提供的文件內容不足，恕難作答。", "我不便透露。", "资料不足，无法回答您的问题。", "恕我不能討論這個話題。"),
        ("更新期間設備無法重新啟動。", "請勿打開外殼。", "只有管理員可以修改設定。", "您指的是哪一台設備？", "代碼表示模組沒有回應。", "檔案至少保留0天。", "沒有權限就不能修改檔案。", "请先抄下序列号。", "壓力不得超過0巴。", "請洽詢您的管理員開啟連接埠。"),
    ),
    "ja": (
        ("申し訳ありませんが、その質問にはお答えできません。", "提供された文書からは回答できません。", "お手伝いできません。", "その件についてはお答えいたしかねます。", "回答は控えさせていただきます。", "対応できる範囲を超えています。", "情報が不足しているため回答できません。"),
        ("更新中は再起動できません。", "カバーを開けないでください。", "管理者だけが設定を変更できます。", "どの装置のことですか。", "応答がないことを示すコードです。", "ファイルは0日間保管されます。", "権限がないとファイルを変更できません。", "詳しくは管理者に確認してポートを開きます。"),
    ),
    "it": (("Mi dispiace, ma non posso rispondere a questa domanda.", "Non posso aiutarla con questa richiesta.", "Non ho informazioni sufficienti per rispondere.", "Preferisco non parlare di questo argomento.", "Non sono autorizzato a discuterne."), ("Il dispositivo non può riavviarsi durante un aggiornamento.", "Non aprire la custodia.", "Solo gli amministratori possono modificare il file.", "Il file resta 0 giorni.")),
    "pt": (("Desculpe, mas não posso responder a essa pergunta.", "Não posso ajudar com esse pedido.", "Não tenho informações suficientes para responder.", "Prefiro não falar sobre esse assunto.", "Não estou autorizado a discutir isso."), ("O equipamento não pode reiniciar durante uma atualização.", "Não abra a caixa.", "Somente administradores podem alterar o arquivo.", "O arquivo fica guardado 0 dias.")),
    "ru": (("Извините, но я не могу ответить на этот вопрос.", "Я не могу помочь с этим запросом.", "У меня недостаточно информации для ответа.", "Я вынужден отказаться отвечать.", "Мне не разрешено это обсуждать."), ("Устройство не может перезапуститься во время обновления.", "Не открывайте корпус.", "Только администраторы могут изменять файл.", "Файл хранится 0 дней.")),
    "ko": (("죄송하지만 그 질문에는 답변할 수 없습니다.", "도와드릴 수 없습니다.", "답변하기에 정보가 부족합니다.", "그 주제에 대해서는 말씀드릴 수 없습니다."), ("업데이트 중에는 다시 시작할 수 없습니다.", "덮개를 열지 마십시오.", "관리자만 파일을 변경할 수 있습니다.", "파일은 0일 동안 보관됩니다.")),
}
_QUOTED = regex.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』|```.*?(?:```|$)", regex.S)
_QUOTES = regex.compile("[\"“„«「『`]")
_NAME = regex.compile(r"\p{Lu}[\p{L}'-]*(?:\s+(?:\p{Lu}[\p{L}\p{N}'-]*|[\p{L}._-]*\p{N}[\p{L}\p{N}._-]*))+|[\p{L}._-]*\p{N}[\p{L}\p{N}._-]*(?!\p{L})")
_END = regex.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_PIECE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Hangul}\p{Thai}]+|[\p{L}\p{M}]+(?:'[\p{L}\p{M}]+)*|\p{N}+|[^\s\p{L}\p{M}\p{N}]")
_SOLID = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}]")
#: Sentences of an answer that may decline, and of others beside them that an answer that declines may have.
FIRST, BESIDE = 2, 3


def parts(answer: str) -> list[str]:
    """The sentences of an answer as they are, without what it quotes."""
    text = answer if answer.isascii() else unicodedata.normalize("NFKC", answer).replace("’", "'")
    if _QUOTES.search(text):
        text = _QUOTED.sub(" ", text)
    return [s for s in (x.strip() for x in _END.split(text)) if s and any(map(str.isalnum, s))]


def plain(sentence: str) -> str:
    """A sentence in lower case; names (words in capitals one after another) and what holds a digit are all 0, as it makes no difference
    what an answer declines to speak about."""
    if not sentence.isupper():
        sentence = _NAME.sub("0", sentence)
    return sentence.casefold()


def sentences(answer: str) -> list[str]:
    return [plain(s) for s in parts(answer)]


def grams(sentence: str) -> set[str]:
    """What a sentence is told by: n-grams of one to three words, beginnings of words, n-grams of one to four characters in scripts without
    blanks, and its first word."""
    out: set[str] = set()
    words = ["0" if w[0].isnumeric() else w for w in _PIECE.findall(sentence)]
    for i, w in enumerate(words):
        if _SOLID.match(w):
            out.update(w[k : k + n] for n in (1, 2, 3, 4) for k in range(len(w) - n + 1))
            continue
        out.add(w)
        if len(w) > 5:
            out.add(w[:5] + "-")
        if i:
            out.add(f"{words[i - 1]} {w}")
        if i > 1:
            out.add(f"{words[i - 2]} {words[i - 1]} {w}")
    if words:
        out.add("^" + words[0])
    return out


def fit(rows: Sequence[tuple[str, bool, float]], pull: float = 0.02, rounds: int = 300) -> dict[str, float]:
    """Weights by gram, and of "" for every sentence: logistic regression of (sentence, declines, weight) with a quadratic penalty, by accelerated
    gradient descent. Both classes weigh the same together."""
    number: dict[str, int] = {"": 0}
    at, of = [], []
    for i, (s, _, _) in enumerate(rows):
        g = grams(s)
        ids = [0, *(number.setdefault(x, len(number)) for x in sorted(g))]
        at += ids
        of += [i] * len(ids)
    at, of = np.array(at), np.array(of)
    y = np.array([d for _, d, _ in rows], dtype=np.float64)
    c = np.array([w for _, _, w in rows], dtype=np.float64)
    c = np.where(y > 0, c / max(1e-9, c[y > 0].sum()), c / max(1e-9, c[y == 0].sum()))
    size = np.sqrt(np.bincount(of, minlength=len(rows)))
    value = 1 / size[of]
    w = v = np.zeros(len(number))
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, v[at] * value, minlength=len(rows)), -30, 30)))
        slope = np.bincount(at, ((p - y) * c)[of] * value, minlength=len(number)) + pull / 10 * v / len(rows) ** 0.5
        before, w = w, v - 2.0 * slope
        v = w + k / (k + 3) * (w - before)
    return {g: float(w[i]) for g, i in number.items()}


def score(sentence: str, weights: dict[str, float]) -> float:
    """Log-odds that a sentence declines."""
    g = grams(sentence)
    return (sum(weights.get(x, 0.0) for x in g) + weights[""]) / (len(g) + 1) ** 0.5


#: A worker's scores of the sentences that it has met, with the weights that they belong to; bounded by KEPT.
_scores: list = [None, {}]
KEPT = 200_000


def declines(answer: str, weights: dict[str, float]) -> bool:
    s = parts(answer)
    if not s or len(s) > FIRST + BESIDE:
        return False
    if _scores[0] is not weights:
        _scores[:] = weights, {}
    for x in map(plain, s[:FIRST]):
        v = _scores[1].get(x)
        if v is None:
            v = score(x, weights)
            if len(_scores[1]) < KEPT:
                _scores[1][x] = v
        if v > 0:
            return True
    return False


def labelled_examples() -> list[tuple[str, bool, float]]:
    return [(x, declines_, 1.0) for pair in EXAMPLES.values() for declines_, texts in zip((True, False), pair, strict=True) for t in texts for x in sentences(t)]


def refine(known: list[tuple[str, bool, float]], met: Iterable[str], sure: float = 1.0, unsure: float = 0.5) -> dict[str, float]:
    """Weights fitted on labelled sentences and on those of `met`, which decline if the first fit is sure of it, are sound if it thinks so or is
    near even, as most are, and are left out in between; these weigh a fifth each."""
    weights = fit(known)
    seen = {s for s, _, _ in known}
    told = [(s, score(s, weights)) for s in sorted(set(met) - seen)]
    more = [(s, x > sure, 0.2) for s, x in told if not unsure < x <= sure]
    return fit([*known, *more]) if more else weights


def refusal_model(answers: DataFrame, labelled: DataFrame | None = None, sample: int = 4000) -> dict[str, float]:
    """Weights for the log of `answers` (its single column), from the labelled sentences here and in `labelled` (text, declines), and at most
    `sample` distinct answers chosen by a hash of the text."""
    column = answers.columns[0]
    known = labelled_examples()
    if labelled is not None:
        known += [(x, r["declines"], 1.0) for r in labelled.filter("text is not null and declines is not null").collect() for x in sentences(r["text"])[:FIRST]]
    some = answers.filter(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h"), column).dropDuplicates(["h"]).orderBy("h").limit(sample)
    return refine(known, (x for r in some.collect() for x in sentences(r[column])[:FIRST]))
