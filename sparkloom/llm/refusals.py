"""Refusals told by what their sentences say: somebody speaking, who cannot or will not, give what was asked.

Every language has four sets of word parts. A sentence refuses where a speaker
(SELF) joins a negation with a service asked for (NEG, SERVICE), or a word
that by itself declines (STRONG). Programs that refuse something have no
speaker, and speakers who cannot reproduce or see something name no service.
An answer is a refusal where refusing and courteous sentences outweigh the
rest, however long it is.
"""

from __future__ import annotations

import re

#: Word parts of the four sets, by language.
_SETS = {
    "en": {
        "self": r"\b(?:i|i'm|i'd|i'll|i've|im|we|we're|we'd|we'll|me|us|my|our|myself|ourselves|assistant|language model|chatbot|ai)\b",
        "neg": r"\b(?:can't|cannot|can not|couldn't|could not|won't|will not|wouldn't|would not|may not|mustn't|must not|shouldn't|should not|don't|do not|am not|i'm not|'m not|are not|aren't|isn't|is not|unable|unwilling|not|no|nothing|never|neither|nor|without being able)\b",
        "service": (
            r"\b(?:help(?:ing|ful)?|assist(?:ing|ance)?|answer(?:ing)?|respond(?:ing)?|reply(?:ing)?|comply(?:ing)?|fulfil+(?:ing)?|discuss(?:ing)?|advi[sc]e|advising|engage|engaging|participate|oblige|accommodate|entertain|contribute"
            r"|provid\w+ (?:that|this|it|you|an?y?\b|such|what|help|assist|information|guidance|advice|the re)|shar(?:e|ing) (?:that|this|it|any|such)|support (?:that|this|you|such)|tak(?:e|ing) (?:this|that|it|your)(?: \w+)? on|tak(?:e|ing) on (?:this|that|your|such)|go along|do (?:this|that|it|so)\b|doing (?:this|that|so)"
            r"|work on (?:this|that)|carry (?:this|that|it) out|touch (?:this|that)|(?:offer|give|produc|generat)\w*(?: you)? (?:an?y? |this |that )?(?:answer|advice|help|assistance|guidance|opinion|response|support|content)|of (?:any )?(?:help|use|service|assistance)|something (?:that )?i(?:'m|'ll)? (?:do|can|could|will|take|am|able|willing|get)|i (?:may|can|could|am (?:able|allowed|permitted) to) (?:say|add|do|offer)|get(?:ting)? involved|handle (?:this|that|such)|proceed|allowed to|permitted to|in a position to|comfortable|willing to (?:do|help|write|go|take|assist|answer))"
        ),
        "strong": (
            r"\b(?:(?:must|have to|has to|need to|'ll|will|shall|going to|prefer to|choose to|respectfully|politely|afraid|forced to|obliged to|rather) (?:\w+ )?(?:decline|refuse|abstain|pass|say no|sit (?:this|that)|turn (?:this|that|you|it) down|leave (?:this|that|it))|i (?:\w+ly )?(?:decline|refuse)|declining (?:this|that|your|to)|(?:off|out of) (?:the table|limits|bounds)|"
            r"rather not|prefer not|(?:goes|go|going|is|are) against|(?:break|breach|violate|breaks|violates|breaching|violating|breaking) (?:the |my |our |their )?(?:\w+ )?(?:rules?|polic\w+|guidelines?|principles?)|(?:will not|won't|can't|cannot|not going to|unable to) (?:write|make|create|produce|complete|perform|draft|do) (?:that|this|it|such \w+)(?: for (?:you|anyone))?(?=\s*(?:[.!,;]|$))|leave (?:this|that|it|such) (?:\w+ )?to others|comment on (?:this|that|it|such)|"
            r"(?:polic\w+|guidelines?|rules?|principles?|instructions|restrictions)\b.{0,30}\b(?:keeps?|prevents?|forbids?|prohibits?|stops?|bars?|don't|doesn't|do not|does not|won't)|(?:outside|beyond)(?: of)? (?:what|my|the scope|our)|not (?:permitted|allowed|authori[sz]ed|at liberty|within my)|step(?:ping)? aside|bow(?:ing)? out|opt(?:ing)? out|sit(?:ting)? (?:this|that|it)(?: one)? out|"
            r"stay(?:ing)? out of|pass(?:ing)? on (?:this|that|it)|leav(?:e|ing) (?:this|that|it)(?: one)? (?:untouched|alone|be|to (?:someone|others|your))|hand(?:ing)? (?:this|that|it) (?:back|over to)|turn(?:ing)? (?:(?:this|that|it|you) )?down|(?:this|that|it|one) i(?:'ll| will| must| have to)? (?:leave|pass|skip|decline|refuse)|draw the line|no way to (?:help|assist|answer|support))\b"
        ),
        "kind": r"\b(?:sorry|apolog\w+|afraid|regret\w*|unfortunately|understand(?:ing)?|thanks?|thank you|hello|hi|dear|someone else|somebody else|another (?:person|source|expert)|your team|colleague|qualified|professional|elsewhere|anything else|other (?:questions|topics|tasks)|general information|happy to|feel free|further help|contact|appreciate|documentation|specialist|expert|instead)\b",
    },
    "de": {
        "self": r"\b(?:ich|wir|mir|mich|uns|mein\w*|unser\w*|assistent\w*|sprachmodell)\b",
        "neg": r"\b(?:nicht|kein\w*|nichts|nie|niemals|unmöglich|außerstande|weder|unfähig)\b",
        "service": r"\b(?:\w*helfen|hilfe|behilflich|beantwort\w*|antwort\w*|unterstütz\w*|äußern|nachkommen|zuständig|befugt|gestattet|erlaubt|berechtigt|ermächtigt|auskunft|übernehmen|entsprechen|eingehen|leisten|mitwirken|beraten|bereit|in der lage|zu diensten|dienen|anfrage|anliegen|bitte zu|darf|dürfen|wunsch|weitergeben|dabei|zur seite stehen|ansprechpartner\w*)\b",
        "strong": r"\b(?:lehnen?\b.{0,60}\bab\b|ablehn\w*|abzulehnen|verweiger\w*|weiger\w*|außerhalb (?:dessen|meine\w*|unsere\w*)|verstößt|verstoßen|untersag\w*|verb(?:ieten|ietet|oten)|enthalte\w*|halte (?:ich )?mich (?:da |hier )?(?:raus|heraus)|muss (?:ich )?(?:hier |da |leider )*passen|passen muss|abstand nehmen|abzusehen|abschlagen|absagen|(?:richtlinien|vorgaben|regeln|grundsätze)\b.{0,40}\b(?:nicht|kein\w*|verbieten|untersagen|hindern)|nicht (?:gestattet|erlaubt|befugt|bereit|zuständig|in der lage)|(?:mir|uns) (?:\w+ ){0,2}nicht möglich|lieber nicht|(?:falsche\w*|nicht der richtige) (?:ansprechpartner\w*|adresse|stelle)|möchte (?:ich )?(?:\w+ )?nicht)\b",
        "kind": r"\b(?:leider|tut mir leid|entschuldig\w*|verständnis|bedau\w+|danke|hallo|gruß|jemand ander\w*|andere stelle|ihr team|dein team|fachperson|kolleg\w+|gern\w*|sonst|wende\w*|wenden)\b",
    },
    "fr": {
        "self": r"(?:\b(?:je|nous|me|moi|mes|mon|ma|nos|notre|assistant|modèle de langage)\b|\b[jm]')",
        "neg": r"(?:\bne\b|\bn')(?:[^.!?]{0,60}?\b(?:pas|point|rien|aucune?|plus|jamais|guère)\b|\s?(?:pouvoir|peux|puis|saurais|pourrai|pouvons)\b)|\b(?:impossible|incapable|rien)\b|\bpas (?:autoris|habilit|en mesure|possible)",
        "service": r"(?:\b|')(?:aid\w+|répon\w+|assist\w+|fourni\w*|donner suite|traiter|accéder|satisfaire|autoris\w+|habilit\w+|en mesure|permis|droit|accompagner|prendre en charge|prononcer|discuter|partager|conseiller|accepter|demande|service|position|faire (?:cela|ça|ce)|occuper|disposé\w*|possibilité|secours|utile)\b",
        "strong": r"\b(?:refus\w+|déclin\w+|abst(?:iens|enir|ient)|hors de (?:ce que|mon|ma|mes|question)|sort(?:ent)? (?:de|du)|dépasse|contraire\w* (?:à|aux)|interdi\w+|enfrei\w+|préfère (?:ne pas|m'abstenir)|pass(?:e|er) mon tour|pas autoris\w+|au-delà de|m'en dispenser|laisse(?:r)? (?:cela|ça) à|(?:politique|règles|consignes|principes)\b.{0,40}\b(?:empêche\w*|interdi\w+|pas|m'))",
        "kind": r"\b(?:désolé\w*|malheureusement|regret\w*|navré\w*|compréhension|merci|bonjour|excus\w+|quelqu'un d'autre|une autre personne|votre équipe|spécialiste|collègue|n'hésit\w+|adress\w+|volontiers|autre)\b",
    },
    "es": {
        "self": r"\b(?:yo|me|mí|mi|mis|nos|nuestr\w+|puedo|podemos|podré|debo|debemos|tengo|tenemos|voy|vamos|quiero|queremos|prefiero|estoy|soy|rechazo|declino|niego|lamento|siento|abstengo|asistente|modelo de lenguaje|seré|pienso)\b",
        "neg": r"\b(?:no|ni|nunca|imposible|tampoco|nada|ningun\w*|ningún|incapaz)\b",
        "service": r"\b(?:ayud\w+|respond\w+|contest\w+|ofrec\w+|proporcion\w+|atend\w+|asist\w+|autorizad\w*|permiso|permitid\w*|permite\w*|facultad\w*|condiciones|hacer(?:lo)?|hacer eso|cumplir|compartir|respuesta|decir\w*|opinar|encarg\w+|asumir|posición|solicitud|petición|colaborar|intervenir|dispuest\w+|servir|capaz|aconsej\w+|aceptar)\b",
        "strong": r"\b(?:rechaz\w+|declin\w+|me niego|negar(?:me|nos)?|abst(?:engo|ener\w*)|fuera de (?:lo|mi|mis|nuestr\w+)|más allá de|en contra de|contra (?:mis|las|nuestr\w+)|prohíb\w+|prohib\w+|(?:política\w*|normas|reglas|directrices)\b.{0,40}\b(?:impide\w*|prohíbe\w*|no)|no es algo que|prefiero no|preferiría no|sobrepasa|excede)\b",
        "kind": r"\b(?:siento|lamento|lamentablemente|disculp\w*|perdón|comprensión|gracias|hola|otra persona|alguien más|tu equipo|su equipo|especialista|compañer\w+|dud[ae]s?|puedes consultar|consulta|contact\w+|con gusto|por desgracia)\b",
    },
}
#: Words of SELF and of courtesy, whole ones and beginnings by length; a text without any of them declines nothing.
_WHOLE, _BEGIN = {"j", "m"}, {}
for _sets in _SETS.values():
    for _part in ("self", "kind"):
        for _m in re.finditer(r"(?:\(\?:|\|)([^\W\d_]+)(\\w|\[|\(|)", _sets[_part]):
            _stem = _m.group(1)[:5]
            if _m.group(2) or len(_m.group(1)) > 5:
                _BEGIN.setdefault(len(_stem), set()).add(_stem)
            else:
                _WHOLE.add(_stem)
_WHOLE -= {"con", "por", "une", "su", "n", "tu", "other", "tasks", "autre"}  # first words of phrases, too common to tell
_PLAIN = re.compile(r"[^\W\d_]+")
_RULES = [{k: re.compile(v, re.I) for k, v in sets.items()} for sets in _SETS.values()]
_CUT = re.compile(r"(?<=[.!?。])\s+|\n+")
_OWN_CODE = re.compile(r"```|^@@ |^--- |^\+\+\+ ", re.M)
_QUOTED = re.compile(r"```.*?(?:```|\Z)", re.S)
_NAMED = re.compile(r"\S*[_/\d]\S*")
_BUT_HERE = re.compile(r"\b(?:but|so|instead|therefore|aber|deshalb|sondern|mais|donc|pero|así que)\b\W+(?:\w+\W+){0,3}?(?:use|try|set|pass|change|run|add|check|call|move|wrap|replace|prüfe|setze|ändere|nutze|ajoute|utilise|vérifie|usa|añade|cambia|prueba)\b", re.I)


def refusing(sentence: str) -> bool:
    """Whether a speaker declines in this sentence."""
    if _BUT_HERE.search(sentence):
        return False
    for rule in _RULES:
        if rule["strong"].search(sentence) and (rule["self"].search(sentence) or rule["kind"].search(sentence)):
            return True
        if rule["self"].search(sentence) and rule["neg"].search(sentence) and rule["service"].search(sentence):
            return True
    return False


def courteous(sentence: str) -> bool:
    return any(rule["kind"].search(sentence) for rule in _RULES)


def is_refusal(answer: str, prompt: str) -> bool:
    """Whether the answer declines and gives nothing: no code of its own and little besides refusing and courteous sentences.

    What it quotes from the prompt counts as nothing, so a refusal that
    repeats the user's code is one as well.
    """
    quoted = [b for b in _QUOTED.findall(answer) if b.strip("`\n ") and b.strip("`\n ").splitlines()[-1] in prompt]
    for b in quoted:
        answer = answer.replace(b, "\n")
    if _OWN_CODE.search(answer):
        return False
    # what a name from code holds is no word of the language
    text = _NAMED.sub(" # ", answer.replace("’", "'"))
    words = set(_PLAIN.findall(text.lower()))
    if words.isdisjoint(_WHOLE) and not any(w[:n] in stems for n, stems in _BEGIN.items() for w in words):
        return False
    sentences = [s for s in _CUT.split(text) if s.strip(" #\t-*>")]
    if not any(map(refusing, sentences[:4])):
        return False
    kinds = ["r" if refusing(s) else "k" if courteous(s) else "o" for s in sentences]
    words = {k: sum(len(s.split()) for s, x in zip(sentences, kinds) if x == k) for k in "rko"}
    first = kinds.index("r")
    later = sum(k == "o" for k in kinds[first + 1 :])
    return later <= kinds.count("r") + kinds.count("k") and words["o"] <= 1.2 * (words["r"] + words["k"]) + 6
