"""Refusals in wording that no table has, and technical answers that only look like them."""

import pytest

from sparkloom.llm import pairs, refusals

REFUSALS = {
    "en": [
        "I won't be assisting with this one, sorry.", "That's something I have to turn down.", "I'm not comfortable answering that.", "My guidelines don't let me respond to this.", "I must refuse this request. Please consult a professional who can look at your case.",
        "We are not in a position to advise on that topic.", "I am going to sit this one out.", "I'd prefer not to engage with that question.", "Unfortunately I cannot be of service in this matter.", "That request falls outside of what I do, so I respectfully decline.",
    ],
    "de": [
        "Dabei kann ich leider nicht behilflich sein.", "Diese Bitte muss ich ablehnen.", "Dazu darf ich keine Auskunft geben.", "Ich bin nicht befugt, darauf zu antworten.", "Das verstößt gegen meine Richtlinien, ich helfe hier nicht.", "Ich möchte mich dazu nicht äußern.", "Ich verweigere die Bearbeitung dieser Anfrage.", "Hier muss ich passen, bitte frag jemand anderen.",
    ],
    "fr": [
        "Je ne suis pas autorisé à traiter cette demande.", "Désolé, je refuse de faire cela.", "Il m'est impossible de répondre à cette question.", "Je préfère ne pas m'exprimer là-dessus.", "Cela sort de mes attributions, je ne peux pas vous assister.", "Je dois décliner cette requête.", "Mes règles m'interdisent d'aider ici.", "Je ne vais pas accéder à votre demande.",
    ],
    "es": [
        "Lo lamento, no me es posible atender esta solicitud.", "Prefiero no responder a esa pregunta.", "Me niego a realizar esta tarea.", "No estoy en condiciones de ayudarle.", "Mis normas prohíben contestar a eso.", "Tengo que rechazar esta petición.", "Eso queda fuera de mi alcance, no puedo asistirte.", "No voy a colaborar con esto.",
    ],
}
TECHNICAL = [
    "The daemon will refuse to start when the port is already taken.", "The parser is not willing to guess, so pass an explicit encoding.", "Your team for example can set retries to 3 in the config file.", "I can't reproduce this with the log, but the cause is visible. Change the guard.", "The server declines requests without a token; set the header.",
    "We cannot rely on the cache here because it is shared.", "Ich kann den Fehler nicht nachstellen, prüfe zuerst die Maske.", "Je ne vois pas d'erreur dans cette fonction.", "No veo ningún problema en esa consulta.", "The policy object keeps a list of rules.", "I would not change this function; the test is wrong.",
    "The client is not allowed to write to this folder, so grant the right first.", "My first guess is the lock: nothing releases it.", "Do not answer with a partial page; raise an error instead.", "The firewall refuses the connection, therefore open the port.", "Sorry, I misread the trace: the second worker holds the lock.",
]

#: Two sets that were looked at once before the words they lacked were added: 13 of 17 and 10 of 14 were found then.
LATER = [
    "I would prefer to leave this question to others.",
    "As a matter of policy, we don't comment on that.",
    "I'm declining this one.",
    "This is not something I can assist you with today.",
    "My apologies, but answering would break the rules I follow.",
    "I have been told not to respond to such requests.",
    "No, I will not write that for you.",
    "Das ist mir leider nicht möglich, bitte wende dich an den Support.",
    "Ich werde diese Anfrage nicht bearbeiten.",
    "Tut mir leid, dabei unterstütze ich dich nicht.",
    "Meine Vorgaben erlauben es nicht, dazu etwas zu sagen.",
    "Je regrette, mais je ne donnerai pas suite à cette demande.",
    "Je n'ai pas l'autorisation d'en parler.",
    "Impossible pour moi de vous répondre.",
    "Perdona, pero no te puedo ayudar con esto.",
    "Lamentablemente debo negarme.",
    "No me corresponde contestar esa pregunta.",
    "Regrettably I need to turn this down.",
    "We don't feel able to discuss such matters.",
    "It's not my place to answer, please ask a lawyer.",
    "I shall not be helping here.",
    "Count me out, I won't touch this.",
    "Ich bitte um Nachsicht, aber darauf antworte ich nicht.",
    "Wir können dir hierbei nicht zur Seite stehen.",
    "Dafür bin ich leider der falsche Ansprechpartner.",
    "Je crains de ne pouvoir vous aider.",
    "Ce n'est pas à moi de répondre à cela.",
    "Nous déclinons votre demande.",
    "Me temo que no puedo hacerlo.",
    "Declino amablemente tu petición.",
    "No tengo permiso para hablar de eso.",
]
LATER_TECHNICAL = [
    "I am not sure the lock is released, so add a finally block.",
    "You must not pass None here; the helper refuses it.",
    "We do not support Python 2 any longer, use 3.10.",
    "The request is declined by the gateway with a 403 because the scope is missing.",
    "Je ne modifierais pas cette boucle, elle est correcte.",
    "No es necesario reiniciar el servicio.",
    "Ich würde die Schleife nicht ändern, sie ist richtig.",
    "I cannot see the file, but the stack trace points to line 12.",
    "Nothing else depends on it.",
    "Sorry for the delay. The fix is in the parser.",
    "We never close the handle; that leaks.",
    "I would pass a copy here, nothing more.",
    "Refusing the connection is right if the token is old.",
    "No puedo reproducir el fallo con ese fichero.",
    "Wir brauchen hier keinen Lock.",
    "Je ne garderais pas cette variable globale.",
]


@pytest.mark.parametrize("lang", REFUSALS)
def test_unseen_refusals(lang):
    hits = [refusals.is_refusal(t, "Why does it fail?") for t in REFUSALS[lang]]
    assert sum(hits) >= 0.9 * len(hits)


def test_technical_answers_are_none():
    assert [t for t in TECHNICAL if refusals.is_refusal(t, "Why does it fail?")] == []


def test_later_sets():
    assert sum(refusals.is_refusal(t, "Why does it fail?") for t in LATER) >= 0.9 * len(LATER)
    assert [t for t in LATER_TECHNICAL if refusals.is_refusal(t, "Why does it fail?")] == []


def test_length_and_quotes_do_not_matter():
    long = "I'm sorry, but I am not able to help with this request. " + "I understand that this is disappointing, and I appreciate your patience with my answer. " * 12
    code = "```python\ndef f(x):\n    return x\n```"
    assert len(long) > 1000 and refusals.is_refusal(long, "Please do it.")
    assert refusals.is_refusal("You asked about\n" + code + "\nI must decline to answer that.", "What does it do?\n" + code)
    assert not refusals.is_refusal("I must decline to keep the old guard. Use this:\n" + code, "Fix it.")
    assert not refusals.is_refusal("", "") and not refusals.is_refusal("...", "x")


def test_languages_beyond_four():
    answers = {"it": "Il problema è che la tabella non viene aggiornata dopo ogni passo, quindi anche gli indici sono vecchi.", "nl": "De oorzaak is dat het bestand niet wordt gesloten, maar dit moet ook bij een fout.", "pl": "Przyczyna jest prosta: plik nie jest zamykany przed odczytem, dlatego się nie zgadza.", "cyrillic": "Причина в том, что файл не закрывается перед чтением.", "cjk": "原因是文件在读取之前没有关闭。"}
    for lang, text in answers.items():
        assert pairs.language(text) == lang
        assert pairs.analyse([{"role": "user", "content": "Why does the file that was read before not match?"}], None, text)[0] == "other_language"


def test_sorted_responses(spark):
    full = "The cause is the mask that drops late rows before they are counted, so move the guard"
    rows = [(1, [("user", "Why?"), ("assistant", full + " above the loop and run the tests again.")], None, None), (2, [("user", "Why?"), ("assistant", full)], None, None), (3, [("user", "Why?")], [("assistant", None)], full.replace("mask", "gate") + " below"), (4, None, None, full), (None, [], None, None)]
    df = spark.createDataFrame(rows, "record_id string, messages array<struct<role:string,content:string>>, trace array<struct<type:string,content:string>>, final string")
    p = pairs.prompts_and_parts(df, "record_id", "messages", "trace", "final")
    assert {x.id for x in p.collect()} == {"1", "2", "3"}
    opened = spark.createDataFrame([("2", full), ("3", full.replace("mask", "gate") + " below")], "id string, answer string")
    assert [x.id for x in pairs.cut_responses(p, opened).collect()] == ["2"]
    assert {x.record_id: x.defect for x in pairs.find_defects(df).collect()} == {"2": "truncated"}
