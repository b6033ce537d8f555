"""Broken prompt and response pairs: ordered rules, each of which flags its type of defect."""

from __future__ import annotations

import difflib
import functools
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.runtime import latest_version
from .words import words

DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")  # in the order of the rules

PLACEHOLDERS = {"null", "none", "nil", "na", "n a", "nan", "undefined", "empty", "no response", "no answer", "tbd", "todo", "leer", "keine antwort", "vide", "aucune reponse", "vacio", "sin respuesta", "string", "no content", "placeholder", "blank", "not available", "nothing"}

_TAGS = re.compile(r"</?[a-zA-Z!][^<>]*>")
_FENCED = re.compile(r"(```|~~~).*?(?:\1|\Z)", re.S)
_INLINE_CODE = re.compile(r"`[^`\n]*`")
_URL = re.compile(r"\b(?:https?://|www\.)\S+")
_QUOTED = re.compile(r"\"[^\"\n]{2,}\"|“[^”\n]{2,}”|„[^“”\n]{2,}[“”]|«[^»\n]{2,}»|‹[^›\n]{2,}›")
_LIST = re.compile(r"^\s*(?:[-*+•–]|\(?\d{1,3}[.)]|[a-z][.)])\s+")
_SENTENCE = re.compile(r"(?<=[.!?。！？…])[\"'”’»)*_]*(?:\s+|$)|(?<=[。！？])|\n+")


_COMBINING = re.compile("[" + "".join(map(chr, (c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))))) + "]+")


@functools.lru_cache(4096)
def _fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return _COMBINING.sub("", unicodedata.normalize("NFKD", text.replace("’", "'").replace("‘", "'").replace("ʼ", "'"))).casefold()


_NOT_LATIN = re.compile("[Ͱ-ϿЀ-ӿ֐-׿؀-ۿऀ-ॿ฀-๿぀-ヿ一-鿿가-힯ᄀ-ᇿ]")
_SAID = re.compile(r"[^\W_]+")


# -- emptiness ---------------------------------------------------------------------------------

def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if "<" not in answer and len(_SAID.findall(answer[:256])) > 8:
        return False  # more words than any placeholder has
    bare = re.sub(r"^\s*(?:```|~~~)[a-z]*\s*$", " ", _TAGS.sub(" ", answer), flags=re.M | re.I)
    kept = [c for c in bare if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) in ("So", "Sm", "Sc")]
    if not kept:
        return True
    said = " ".join(words(bare))
    return said in PLACEHOLDERS


# -- copies ------------------------------------------------------------------------------------

_LABEL = re.compile(r"^\s*(?:question|pregunta|frage|domanda|pergunta|user|q)\s*:\s*", re.I)
_ECHO = re.compile(
    r"^(?:you (?:asked|said|wrote)|your question(?: was| is)?|the question(?: was| is)?|question|has preguntado|preguntaste|tu pregunta(?: era| es)?|pregunta|"
    r"(?:du hast|sie haben) gefragt|(?:deine|ihre) frage(?: war| lautet| ist)?|frage|(?:tu as|vous avez) demande|(?:ta|votre) question(?: etait| est)?)\s*[:\-–—]+\s*"
)


@functools.lru_cache(4096)
def _question(prompt: str) -> str:
    """The part of a prompt that asks: what follows the last label of a question, else the last paragraph."""
    for block in reversed(re.split(r"\n\s*\n|\n", prompt)):
        if block.strip():
            return _LABEL.sub("", block.strip())
    return ""


def _letters(text: str) -> str:
    return "".join(words(text))


_ALNUM = re.compile(r"[a-z0-9]+")


@functools.lru_cache(4096)
def _prompt_words(prompt: str) -> frozenset[str]:
    return frozenset(_ALNUM.findall(_fold(prompt)))


@functools.lru_cache(4096)
def _askings(prompt: str) -> tuple[frozenset[str], str]:
    """Letters of what may be given back: the prompt, its paragraphs, its question and the ends of that from any sentence on; and of the question."""
    paragraphs = [_letters(p) for p in re.split(r"\n\s*\n", prompt)]
    parts = [_letters(s) for s in re.split(r"(?<=[.!?。])\s+", _question(prompt)) if s.strip()]
    ends = ["".join(parts[i:]) for i in range(len(parts))]
    return frozenset(x for x in ("".join(paragraphs), *paragraphs, *ends) if len(x) >= 8), ends[0] if ends else ""


def _in_common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit of one number for each letter of ``b``."""
    at = {c: int("".join("1" if x == c else "0" for x in reversed(b)), 2) for c in set(b)}
    full = open_bits = (1 << len(b)) - 1
    for c in a:
        hit = open_bits & at.get(c, 0)
        open_bits = (open_bits + hit | open_bits - hit) & full
    return len(b) - open_bits.bit_count()


def is_copy(prompt: str | None, answer: str) -> bool:
    """The answer gives back the prompt or its question, once or several times, and nothing else.

    Compared on letters and digits alone; up to a tenth of them may differ (slips of the pen).
    """
    if not prompt:
        return False
    folded = _fold(answer)
    if folded.isascii():  # a copy shares most of its words, however a tenth of its letters lie
        ws = _ALNUM.findall(folded)
        if len(ws) >= 8 and sum(map(_prompt_words(prompt).__contains__, ws)) < 0.4 * len(ws):
            return False
    said = _ECHO.sub("", folded.strip(" \t\r\n\"'>*_«“„"))
    a = _letters(said)
    if len(a) < 8:
        return False
    asked, q = _askings(prompt)
    for p in asked:
        if a == p or (len(a) % len(p) == 0 and a == p * (len(a) // len(p))):
            return True
        if 0.85 <= len(a) / len(p) <= 1.15:
            m = difflib.SequenceMatcher(None, a, p, autojunk=False) if len(a) < 5000 else None
            if m and m.real_quick_ratio() >= 0.93 and m.quick_ratio() >= 0.93 and m.ratio() >= 0.93:
                return True
            if not m and 2 * (Counter(a) & Counter(p)).total() >= 0.93 * (len(a) + len(p)) and 2 * _in_common(a, p) >= 0.93 * (len(a) + len(p)):
                return True
    # the question cut out, hardly anything is left
    return len(q) >= 20 and q in a and len(a.replace(q, "")) <= max(6, len(q) // 10)


# -- refusals ----------------------------------------------------------------------------------

_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
_HELP = r"(?:help|assist|answer|respond|reply|comment|discuss|provide|do that|do this|do so|talk about|go into|fulfil|fulfill|comply|complete|share|offer|give|support|engage|speak|weigh in|address|write|produce|generate|create|process|continue|accommodate|participate|take part|advise|recommend|be of help|be assisting|be helping|be answering|be providing|be doing)"
REFUSALS = [re.compile(_fold(p) if _NOT_ASCII.search(p) else p) for p in (  # folded, as the answers are
    # English
    rf"\b(?:i|we) (?:(?:am |'m )?(?:afraid|sorry)(?: but| that)? (?:i|we) )?(?:can ?not|can't|won't|will not|am not able to|'m not able to|'m unable to|am unable to|'m not allowed to|am not allowed to|must not|may not|shouldn't|couldn't|do not wish to|don't want to|prefer not to|would prefer not to) (?:be able to )?(?:really |actually |in good conscience )?{_HELP}",
    rf"\bi(?:'m| am) not (?:able|allowed|permitted|authori[sz]ed|comfortable|willing|going|prepared|in a position)(?: to| with)? ",
    r"\bnot able to (?:answer|help|assist|respond|discuss|comment|provide|fulfil)", r"\bunable to (?:answer|help|assist|respond|discuss|comment|provide|fulfil)",
    r"\b(?:must|have to|need to|will|am going to) (?:respectfully |politely )?(?:decline|refuse)\b", r"\b(?:decline|refuse) to (?:answer|respond|comment|help|discuss)", r"\bi(?:'m| am)? (?:respectfully |politely )?(?:declin(?:e|ing)|refus(?:e|ing))\b", r"\bhave to pass on\b", r"\b(?:pass|sit) (?:on )?this one\b",
    r"\b(?:would|'d) rather not\b", r"\bwould not be (?:appropriate|right|proper)\b|\bwouldn't be (?:appropriate|right|proper)\b", r"\bno (?:answer|response|reply) (?:will|can) be given\b", r"\bthat(?:'s| is) (?:a request|something) (?:that )?i (?:can't|cannot|won't|will not|must)\b", r"^(?:sorry,? )?no,? (?:i|we) (?:can't|cannot|won't|will not)\b",
    r"\b(?:falls?|is|lies?) (?:well )?outside (?:of )?what i\b", r"\boutside (?:of )?(?:my|the) (?:scope|remit|guidelines)\b", r"\bguidelines (?:don't|do not|won't|prevent|prohibit|forbid)", r"\bagainst (?:the|my) (?:rules|guidelines|policy|policies)\b",
    r"\bleave (?:it |that |this |them )?unanswered\b", r"\bnot (?:something|a topic|a subject) (?:that )?i (?:can|may|will|am)\b", r"\blet's (?:talk|speak|move on|turn|focus) (?:about|to|on)? ?(?:\w+ ){0,2}(?:else|different|other)\b|\btalk about something else\b", r"\bnot permitted to\b|\bnot allowed to (?:answer|discuss|help|talk)",
    # German
    r"\b(?:kann|koennte|konnte|darf|mochte|will|werde) (?:ich|wir) (?:\w+ ){0,6}?(?:nicht|leider nicht|keine)\b", r"\bich (?:kann|darf|mochte|will|werde) (?:\w+ ){0,7}?(?:nicht|keine)\b", r"\b(?:muss|mussen) ich (?:\w+ ){0,5}?ablehnen\b|\bmuss ich ablehnen\b|\bich muss (?:\w+ ){0,5}?ablehnen\b", r"\bspreche ich nicht\b|\bich spreche (?:\w+ ){0,4}nicht\b", r"\bmochte ich mich nicht aussern\b", r"\bbleib(?:t|en) (?:\w+ ){0,5}unbeantwortet\b|\bunbeantwortet\b", r"\bnicht erlaubt\b|\bnicht gestattet\b|\bist mir untersagt\b", r"\blehne ich ab\b|\bich lehne (?:\w+ ){0,5}ab\b", r"\bmuss (?:\w+ ){0,6}offen bleiben\b|\blasse ich offen\b|\bmuss ich offen lassen\b", r"\bkeine (?:antwort|auskunft) geben\b", r"\b(?:nicht in der lage|nicht befugt|ausserstande)\b", r"\bdabei (?:\w+ ){0,4}nicht (?:helfen|behilflich)",
    # French
    r"\b(?:je|nous) (?:ne |n')(?:\w+ )?(?:peux|puis|suis|veux|souhaite|dois|saurais|pouvons|sommes) (?:malheureusement )?(?:pas\b)?", r"\bje (?:dois|prefere|vais|me vois|suis oblige de) (?:\w+ ){0,4}?(?:decliner|refuser|m'abstenir|ne pas)\b", r"\bil ne m'est pas (?:permis|possible)\b|\bil m'est impossible\b|\bje suis (?:dans l'incapacite|incapable)\b", r"\b(?:rester|reste|restera|laisser|laisse) sans reponse\b", r"\bje decline\b|\bje refuse\b", r"\bje ne parle pas\b|\bje n'aborde pas\b",
    # Spanish
    r"\bno (?:me |te |le |os |les )?(?:puedo|podre|podria|podemos|debo|quiero|deseo|voy a|es posible) (?:\w+ ){0,3}?(?:ayudar|responder|contestar|hablar|comentar|hacer|dar|opinar|atender|cumplir|proporcionar|ofrecer|facilitar)\w*", r"\b(?:debo|tengo que|he de) (?:\w+ ){0,3}?(?:rechazar|declinar|negarme)\b", r"\bprefiero no\b", r"\bno me (?:esta|es|resulta) (?:permitido|posible)\b", r"\b(?:queda|quedan|quedara|dejar|dejo) sin (?:respuesta|responder|contestar)\b", r"\brechazo (?:esta|la) peticion\b", r"\bno hablo de\b", r"\bno estoy (?:autorizad|en condiciones|capacitad)",
    # Portuguese
    r"\bnao (?:posso|podemos|consigo|devo|estou autorizad\w|me e permitido) (?:\w+ ){0,3}?\w", r"\b(?:tenho que|tenho de|devo|preciso) (?:\w+ ){0,2}?(?:recusar|declinar)\b|\bprefiro nao\b|\brecuso(?:-me)?\b",
    # Italian
    r"\bnon (?:(?:mi|ti|vi|le) )?(?:posso|possiamo|sono in grado|sono autorizzat\w|e possibile|riesco) ", r"\b(?:devo|sono costrett\w a) (?:\w+ ){0,2}?(?:rifiutare|declinare)\b|\bpreferisco non\b|\bmi rifiuto\b",
    # Dutch
    r"\b(?:ik|we|wij) (?:kan|mag|wil|zal|kunnen|mogen) (?:\w+ ){0,7}?(?:niet|geen)\b|\b(?:kan|mag|wil|zal) ik (?:\w+ ){0,7}?(?:niet|geen)\b", r"\bik (?:moet|weiger)(?: \w+){0,5}? ?(?:weigeren|afwijzen|bedanken)?\b(?<=n)|\bik weiger\b", r"\bniet in staat\b|\bniet toegestaan\b",
    # Swedish
    r"\b(?:jag|vi) (?:kan|far|vill|kommer) (?:\w+ ){0,4}?(?:inte|ej)\b|\b(?:kan|far|vill) jag (?:\w+ ){0,4}?inte\b", r"\bjag (?:maste avboja|avbojer|avstar|vagrar)\b",
    # Polish
    r"\bnie (?:moge|mozemy|jestem w stanie|wolno mi|chce|bede)\b", r"\bmusze odmowic\b|\bodmawiam\b|\bwole nie\b",
    # Turkish
    r"\b(?:yard[iı]mc[iı] olamam|yard[iı]m edemem|cevap veremem|yan[iı]tlayamam|cevaplayamam|bunu yapamam|sa[gğ]layamam|reddetmek zorundayim)\b",
    # Russian
    r"\bне (?:могу|можем|могу вам|буду|имею права|в состоянии|вправе|хочу)\b", r"\b(?:вынужден\w*|должен|должна|приходится) отказать\w*\b|\bотказываюсь\b|\bпредпочитаю не\b|\bоставлю .{0,40}без ответа\b",
    # Chinese, Japanese, Korean (no spaces between words)
    r"(?:无法|不能|不便|不可以|没法|拒绝)(?:\w{0,8})?(?:回答|提供|帮助|协助|帮忙|讨论|满足|完成|处理|回应|评论)|無法(?:\w{0,8})?(?:回答|提供|協助|討論|完成)|(?:恕|抱歉，?)我?(?:不能|无法|無法)|我(?:必须|只能)?拒绝",
    r"(?:お答え|回答|お手伝い|対応|お応え|提供|お話|協力|支援|お受け)\w{0,6}?(?:できません|できない|致しかね|いたしかね|しかね|することはできません|控え)|お断り|(?:て|で)は?いけません.{0,10}ので",
    r"(?:도와|도움|답변|대답|제공|응답|응할|처리|말씀|알려)\w{0,6}\s?(?:드릴|줄|할|해|될)?\s?\w{0,4}\s?수\s?(?:가\s?)?없|거절|거부",
    # Arabic
    r"لا (?:استطيع|أستطيع|يمكنني|يمكننا|اقدر|أقدر)|لن (?:اتمكن|أتمكن)|اعتذر عن|أعتذر عن",
)]
# a text without any of these (words stand between blanks) holds no refusal, but for those in scripts without letters of Latin
_TRIGGERS = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
for _t in (
    "cannot|can not|can't|won't|will not|not able|not allowed|not permitted|not comfortable|not willing|not going|not prepared|not in a|not auth|not some|not a topic|not a subj|unable|must not|may not|shouldn't|couldn't|wish to|want to|prefer|declin|refus|pass on|sit this one|pass this one|rather not|would not|wouldn't|be given|outside|guidelines|against the|against my|unanswered|let's|something else| no, | no i "
    "|nicht|keine|ablehn|unbeantwortet|untersagt| ab | ab.| ab,|offen|ausserstande"
    "| je | nous |m'est|sans reponse"
    "| no |rechaz|declinar|negarme|prefiero|sin respuesta|sin responder|sin contestar"
    "| nao |recus| non |rifiut|preferisco| niet| geen|weiger|afwijzen|bedanken| inte| ej |avboj|avstar|vagrar| nie |odmow|odmaw|wole nie|amam|emem|zorunday"
).split("|"):
    _TRIGGERS.add_word(_t)
_TRIGGERS.make_automaton()


def _may_refuse(folded: str) -> bool:
    if not folded.isascii() and _NOT_LATIN.search(folded):
        return True
    return next(_TRIGGERS.iter(" " + folded.replace("\n", " ") + " "), None) is not None


COURTESY = [re.compile(_fold(p) if _NOT_ASCII.search(p) else p) for p in (
    r"^(?:i(?: am|'m) )?(?:very |so |really |truly )?sorry\b", r"^i (?:hope|trust) (?:you|this|that)", r"^i (?:appreciate|understand|apologi[sz]e)", r"^(?:my )?apologies\b", r"^thank(?:s| you)\b", r"^(?:please )?feel free\b", r"^(?:is|are) there (?:any|some)", r"^(?:please |you may want to |you should |i (?:suggest|recommend|advise)(?: that)? (?:you )?)?(?:consult|contact|ask|reach out|turn to|see|speak|talk|seek)\w* ", r"^(?:sure|of course|certainly|good question|unfortunately|however|as an assistant|no|sorry)\W*$", r"^let me know\b", r"^what else\b|^can i help|^i(?:'d| would) be (?:happy|glad)", r"^perhaps\b", r"^as an? (?:ai|assistant|language)\b", r"^(?:that|this|it) (?:could|might|may|would) (?:be|cause) (?:harmful|unsafe|dangerous|harm|misuse|illegal)", r"\b(?:qualified|licensed) (?:professional|doctor|lawyer|expert)\b",
    r"^(?:es )?tut mir leid\b", r"^bitte (?:wende|wenden|frag|fragen|sprich|hab|haben)", r"^(?:danke|vielen dank)\b", r"^ich (?:hoffe|verstehe|bitte)", r"^gibt es (?:etwas|sonst)", r"^(?:leider|gerne|naturlich|gute frage|nein)\W*$", r"^kann ich (?:sonst|dir|ihnen)", r"^entschuldig",
    r"^(?:je suis )?(?:desole|navre)", r"^(?:veuillez|merci|n'hesitez|avez-vous|puis-je|j'espere|je comprends|consultez)", r"^(?:malheureusement|bien sur|bonne question)\W*$", r"^y a-t-il",
    r"^(?:lo siento|lo lamento|gracias|por favor|consulte|consulta|espero|entiendo|hay (?:otra|algo)|puedo ayudar|le ruego|te ruego)", r"^(?:por desgracia|claro|buena pregunta)\W*$", r"^dirigete|^dirijase|^pregunta(?:le)? a",
    r"^(?:desculpe|sinto muito|lamento|obrigad\w|por favor|consulte|entendo|espero)", r"^(?:mi dispiace|mi scuso|scusa|grazie|la prego|ti prego|consulti|capisco|spero|rivolgiti|si rivolga)", r"^(?:het spijt me|sorry|bedankt|dank|neem contact|raadpleeg|ik begrijp|vraag het|helaas)", r"^(?:tyvarr|forlat|ursakta|tack|jag beklagar|jag forstar|kontakta)", r"^(?:przykro mi|przepraszam|niestety|dziekuje|prosze|rozumiem|skontaktuj)", r"^(?:uzgunum|maalesef|tesekkur|lutfen)",
    r"^(?:к сожалению|извините|простите|прошу прощения|мне жаль|спасибо|пожалуйста|обратитесь|понимаю|я понимаю)", r"^(?:抱歉|对不起|很抱歉|非常抱歉|请咨询|感谢|谢谢|建议|對不起)", r"^(?:申し訳|すみません|恐れ入り|ごめん|ありがとう|専門)", r"^(?:죄송|미안|감사|전문)", r"^(?:عذرا|اسف|آسف|شكرا)",
)]


def _sentences(text: str) -> list[str]:
    return [s.strip() for s in _SENTENCE.split(text) if s and s.strip()]


def is_refusal(answer: str) -> bool:
    """Says it declines and says nothing else of substance: every sentence is a refusal or a courtesy."""
    if "```" in answer or "~~~" in answer:
        return False
    folded = _fold(answer)
    if not _may_refuse(folded):
        return False
    folded = _fold(_QUOTED.sub(" ", answer))
    declines = False
    for s in _sentences(folded):
        s = s.strip("*_>- \t\"'¿¡")
        if not re.search(r"\w", s):
            continue
        if _may_refuse(s) and any(p.search(s) for p in REFUSALS):
            declines = True
        elif not any(p.search(s) for p in COURTESY):
            return False
    return declines


# -- languages ---------------------------------------------------------------------------------

STOPWORDS = {k: frozenset(v.split()) for k, v in {
    "en": "mean means explain tell give show between lies list describe summarise summarize a make every look needs keep keeps looks looked away next most least nobody somebody whenever without between first twice often rarely let rest add he she his her i my me us no yes one two last back down are too just now lies hides asked wrote older same change changes the and of to in is are was were that this with for on not be have has it as at by from which what how why when who you we they their its there does do did but or if than so can could should would an been will into once only also all more before after over out our your",
    "de": "bedeutet dieser diese dieses satz prufe erklare kurz macht wozu notig unterschied vergleicht schritte damit seit tagen woran liegen ich du sie ihr unser unsere blieb bleibt braucht spielt rolle zeit doppelt ohne gegen ihn ihm dort sehr mehr am zum zur uber unter die der die das und ist nicht ein eine einen einem einer den dem des mit fur von zu auf im in sich auch wie wird war waren wurde wenn dass weil oder aber noch nach bei aus man es sind hat haben kann doch weder zuerst dann hier ob warum welche was jemand muss beides dabei schnell wieder bitte",
    "fr": "comment verifier veut dire phrase explique quelques mots sert etapes suivre pourquoi depuis jours quelle raison il faut je tu mon ma mes leur leurs notre votre y meme aussi bien assez ni donc fut semblait restait reste montre temps devient vont ensemble chez entre le la les des une un et est en que qui dans pour pas ne sur au aux avec ce cette ces il elle ils nous vous du de son sa ses mais ou plus comme sont etait ete par si se quand selon apres vite encore tres sans a d l n qu c s j on peut faut deux ici",
    "es": "compruebo van bien juntos significa frase explica pocas palabras sirve hace falta pasos seguir desde hace dias razon diferencia aqui yo tu mi mis nuestro nuestra su ese esa eso entre hasta hacia tambien aunque ni seguia sigue parecia vuelve importaba decide sirven cuidado tiempo el la los las de que y en un una es no se por con para su sus al del lo como mas pero este esta estos son era fue si cuando hay sin ha han muy segun despues porque donde tan ni otra otro aqui desde primero luego ambos dos cual nada",
    "pt": "o os a as de que e do da dos das em um uma nao para com por se mais como mas ao foi ser tem sao seu sua ou quando muito nos ja esta eu tambem so pelo pela ate isso ela entre depois sem mesmo aos todos pode antes novo",
    "it": "il lo la i gli le di che e un una non per con si da in del della dei delle sono al come piu ma anche nel alla poi se quando era essere ha questo questa dal ogni tutto tutti puo sul perche prima dopo altri anche bisogna",
    "nl": "de het een en van is dat niet in op te zijn met voor aan er om als bij dan maar ook nog wel naar uit over deze wordt worden kan door tot moet alle hebben heeft",
    "sv": "och att det som en av for ar inte med pa till den har de ett om var men sa kan vid fran nar efter alla eller ska mot",
    "pl": "i w na nie sie z do jest to ze o jak po co za od dla ale przez przy oraz tylko gdy moze jego ktory tak",
    "tr": "ve bir bu da de icin ile cok daha olarak gibi var olan kadar sonra en ama her ne ya degil",
}.items()}
SCRIPTS = (("ja", re.compile("[぀-ヿ]")), ("ko", re.compile("[가-힯]")), ("zh", re.compile("[一-鿿]")), ("ru", re.compile("[Ѐ-ӿ]")), ("ar", re.compile("[؀-ۿ]")), ("he", re.compile("[֐-׿]")), ("el", re.compile("[Ͱ-Ͽ]")), ("hi", re.compile("[ऀ-ॿ]")), ("th", re.compile("[฀-๿]")))
NAMES = {k: re.compile(p) for k, p in {
    "en": r"\b(?:english|englisch\w*|anglais|ingles)\b", "de": r"\b(?:german|deutsch\w*|allemand|aleman)\b", "fr": r"\b(?:french|franzosisch\w*|francais|frances)\b", "es": r"\b(?:spanish|spanisch\w*|espagnol|espanol|castellano)\b",
    "pt": r"\b(?:portuguese|portugiesisch\w*|portugais|portugues)\b", "it": r"\b(?:italian|italienisch\w*|italien|italiano)\b", "nl": r"\b(?:dutch|niederlandisch\w*|neerlandais|neerlandes|holandes)\b", "ja": r"\b(?:japanese|japanisch\w*|japonais|japones)\b",
    "zh": r"\b(?:chinese|chinesisch\w*|chinois|chino)\b", "ru": r"\b(?:russian|russisch\w*|russe|ruso)\b", "ko": r"\b(?:korean|koreanisch\w*|coreen|coreano)\b", "ar": r"\b(?:arabic|arabisch\w*|arabe)\b", "pl": r"\b(?:polish|polnisch\w*|polonais|polaco)\b", "sv": r"\b(?:swedish|schwedisch\w*|suedois|sueco)\b", "tr": r"\b(?:turkish|turkisch\w*|turc|turco)\b",
}.items()}
_TRANSLATE = re.compile(r"\b(?:translat\w+|ubersetz\w*|tradu\w+|in which language|auf (?:englisch|deutsch|franzosisch|spanisch)|en (?:anglais|allemand|francais|espagnol|ingles|aleman|frances|espanol)|in (?:english|german|french|spanish)|(?:answer|reply|respond) in|antworte auf|reponds? en|responde en)\b")


def _prose(text: str) -> str:
    if "`" in text or "~~~" in text:
        text = _INLINE_CODE.sub(" ", _FENCED.sub("\n", text))
    if "http" in text or "www." in text:
        text = _URL.sub(" ", text)
    if _QUOTE.search(text):
        text = _QUOTED.sub(" ", text)
    return "\n".join(line for line in text.split("\n") if not line.lstrip().startswith("|")) if "|" in text else text


_QUOTE = re.compile("[\"“„«‹]")
_LIST_AFTER_STOP = re.compile(r"[.!?。！？…][\"'”’»)*_]*\s*(?:[-*+•–]|\(?\d{1,3}[.)]|[a-z][.)])\s")
_ANY_LIST = re.compile(_LIST.pattern, re.M)


_LANGS = list(STOPWORDS)
_OF_WORD = {}
for _i, _k in enumerate(_LANGS):
    for _w in STOPWORDS[_k]:
        _OF_WORD.setdefault(_w, []).append(_i)
_LATIN_WORD = re.compile(r"[a-z]+")


def _word_scores(ws: list[str]) -> dict[str, int]:
    """By language, how many of the words are its function words."""
    score, count = [0] * len(_LANGS), Counter(ws)
    for w in count.keys() & _OF_WORD.keys():
        for i in _OF_WORD[w]:
            score[i] += count[w]
    return dict(zip(_LANGS, score))


@functools.lru_cache(4096)
def language(text: str) -> str | None:
    """Language of prose by script and function words; None where too little tells."""
    if _NOT_LATIN.search(text):
        letters = sum(map(str.isalpha, text))
        if letters < 4:
            return None
        for name, p in SCRIPTS:
            if len(p.findall(text)) * (2 if name == "ja" else 1) >= 0.25 * letters:
                return name
    ws = _LATIN_WORD.findall(_fold(text))
    if len(ws) < 4:
        return None
    score = _word_scores(ws)
    order = sorted(score, key=lambda k: -score[k])
    best, second = order[0], order[1]
    if score[best] < 2 or score[best] < 0.12 * len(ws) or score[best] < 1.15 * score[second]:
        return None
    return best


_ANY_NAME = re.compile("|".join(p.pattern for p in NAMES.values()))


@functools.lru_cache(4096)
def _asks_language(question: str) -> bool:
    folded = _fold(question)
    return bool(_TRANSLATE.search(folded) or _ANY_NAME.search(folded))


@functools.lru_cache(4096)
def _prompt_language(prompt: str) -> str | None:
    return language(_prose(_question(prompt))) or language(_prose(prompt))


def is_other_language(prompt: str | None, answer: str) -> bool:
    if not prompt:
        return False
    question = _question(prompt)
    if _asks_language(question):
        return False
    text = _prose(answer)
    if _ANY_LIST.search(text) or _LIST_AFTER_STOP.search(text):  # short items tell nothing
        text = " ".join(s for s in _sentences(text) if not _LIST.match(s) or len(s.split()) >= 5)
    said, asked = language(text), _prompt_language(prompt)
    if not asked or said == asked:
        return False
    if said is None and asked in STOPWORDS:  # too short to name its language: is it at least not the question's?
        ws = _LATIN_WORD.findall(_fold(text))
        score = {k: n for k, n in _word_scores(ws).items() if k in ("en", "de", "fr", "es")}
        return len(ws) >= 6 and not score.pop(asked, 0) and max(score.values(), default=0) >= 2
    return said is not None


# -- truncation --------------------------------------------------------------------------------

_ANNOUNCED = re.compile(r"(?:^|\s)(\d{1,2})\s+[^\d\n:.]{2,70}:\s*$", re.M)
_ENDS = tuple(".!?。！？…")
_CLOSERS = "\"'”’»)]*_` \t\r\n​﻿"


def is_truncated(answer: str) -> bool:
    """Breaks off before a code block, an announced list, a bracket, a quotation, a word or a sentence is complete."""
    text = answer.strip().strip("​﻿")
    if "```" in text or "~~~" in text:
        if len(re.findall(r"^\s*(?:```|~~~)", text, re.M)) % 2:
            return True
        if re.search(r"(?:```|~~~)\s*$", text):
            return False
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return False
    for m in _ANNOUNCED.finditer(text) if ":" in text else ():
        rest = text[m.end() :]
        items = re.findall(r"^\s*(?:[-*+•]|\(?\d{1,3}[.)])\s+\S", rest, re.M)
        numbered = re.search(r"^\s*\(?\d{1,3}[.)]\s+\S", rest, re.M)
        if len(items) < int(m.group(1)) and (numbered or not rest.strip() or items):
            return True
    last = lines[-1].strip()
    if last.endswith((":", ",", ";", "(", "-", "–", "—", "/")) and not last.startswith("|"):
        return not (last.endswith(";") and re.match(r"^\s*[\w.]+\(.*\);$", last) and len(lines) > 1)
    if last.startswith("|") or _URL.match(last):
        return False
    bare = _INLINE_CODE.sub(" ", last)
    if bare.count("(") > bare.count(")") or bare.count("[") > bare.count("]") or bare.count('"') % 2 or bare.count("“") + bare.count("„") > bare.count("”") + bare.count("“") or bare.count("«") > bare.count("»"):
        return True
    tail = last.rstrip(_CLOSERS)
    if not tail or tail.endswith(_ENDS):
        return False
    if not (tail[-1].isalnum()):
        return False  # an emoji or a symbol closes
    if _URL.search(tail.split()[-1]):
        return False
    said = _LIST.sub("", last)
    if _LIST.match(last):
        items = [_LIST.sub("", x).rstrip(_CLOSERS) for x in lines if _LIST.match(x)]
        return any(x.endswith(_ENDS) for x in items[:-1]) or len(said.split()) > 7
    if re.fullmatch(r"[\W\d_]*", last) or re.fullmatch(r"[*_\s]*[-+]?[\d.,\s]+\s*\S{0,3}[*_\s]*", last):
        return False
    if last.startswith("#"):
        return True  # a heading with nothing under it
    return len(said.split()) > 1 or len(lines) > 1


# -- the operator ------------------------------------------------------------------------------

def defects(prompt: str | None, answer: str | None) -> list[str]:
    """Every defect that is triggered, in the order of the rules.

    An empty answer has nothing further to judge; a copy can only be truncated besides.
    """
    if is_empty(answer):
        return ["empty"]
    out = ["copy"] if is_copy(prompt, answer) else []
    if not out:
        if is_refusal(answer):
            out.append("refusal")
        if is_other_language(prompt, answer):
            out.append("other_language")
    if is_truncated(answer):
        out.append("truncated")
    return out


def flag_pairs(pairs: DataFrame) -> DataFrame:
    """``pair_source, pair_key, defect, place``: a row for every triggered defect; ``place`` counts a pair's, from 1.

    ``pairs``: ``pair_source, pair_key, prompt, answer``, others are ignored. A null prompt leaves only what the answer
    itself tells; a null answer is ``empty``. Whole texts are read. Repeated rows give one row.
    """

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for s, k, p, a in zip(*(b.column(c).to_pylist() for c in ("pair_source", "pair_key", "prompt", "answer"))):
                out += [(s, k, d, i) for i, d in enumerate(defects(p, a), 1)]
            if out:
                s, k, d, i = zip(*out)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in (s, k, d)), pa.array(i, pa.int32())], ["pair_source", "pair_key", "defect", "place"])

    return pairs.select("pair_source", "pair_key", "prompt", "answer").mapInArrow(flag, "pair_source string, pair_key string, defect string, place int").distinct()


def session_pairs(messages: DataFrame, *, slice_seconds: int = 3600) -> DataFrame:
    """``pair_key, prompt, answer``: each ASSISTANT message with the latest USER message before it in its session.

    Order is ``sent_at``, then ``id``; repeated ids count once. An answer with no user message before it
    is in no pair. Sessions are cut into slices of time and the last user message of earlier
    slices is carried in, so that a session with most of the rows is spread over many tasks;
    null sessions, ids and times are left out.
    """
    m = messages.where("session_id is not null and sent_at is not null").select("session_id", "id", "role", "content", "sent_at")
    m = latest_version(m, "id", ["sent_at"]).withColumn("slice", F.floor(F.unix_timestamp("sent_at") / slice_seconds))
    place = F.struct("sent_at", "id", "content")
    is_user = F.upper(F.trim("role")) == "USER"
    ends = m.where(is_user).groupBy("session_id", "slice").agg(F.max(place).alias("last_user"))
    slices = m.select("session_id", "slice").distinct().join(ends, ["session_id", "slice"], "left")
    before = Window.partitionBy("session_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("carried", F.last("last_user", ignorenulls=True).over(before)).select("session_id", "slice", "carried")
    w = Window.partitionBy("session_id", "slice").orderBy("sent_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    here = m.withColumn("user", F.last(F.when(is_user, place), ignorenulls=True).over(w))
    both = here.where(F.upper(F.trim("role")) == "ASSISTANT").join(carried, ["session_id", "slice"], "left").withColumn("asked", F.coalesce("user", "carried"))
    return both.where("asked is not null").select(F.col("id").alias("pair_key"), F.col("asked.content").alias("prompt"), F.col("content").alias("answer"))
