"""Defects of answers to questions: empty, copied, refused, cut off, in another language.

A cut answer ends in an open sentence, and what such a sentence says goes on elsewhere: reduced to its form (function words and
marks stay; names, numbers and other words become signs) it is a strict prefix of longer sentences of other answers, which one global sort
finds for all of them (``prefixes.longer_copies``), and it is the whole of none. What has no longer copy is left to rules on its own end. The other
defects are ordered rules over each answer. Every defect that an answer triggers comes out, in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm.prefixes import longer_copies
from ragtide.sources.tables import durable, spread

MASK = "\u0001"
#: Marks of a cut that are no text themselves.
CUT_MARK = r"\s*(\[\s*(\.\.\.|…|truncated|cut)\s*\]|\(\s*(truncated|continued)\s*\))\s*$"
DOTS = r"\s*(…|\.\.\.+)[\s\"”»’')]*$"
STOP = r"([.!?。！？।]|:)[\s\"”»’')\]*_`]*(\[\d+\][\s.]*)*$"
#: Abbreviations that go on after their full stop.
ABBREVIATION = r"(?<![\p{L}.])(dr|st|mr|mrs|ms|prof|nr|vs|e\.g|i\.e|cf|fig|vol|approx|ca|bzw|z\. ?b|mme|mlle|sr|sra|p\. ?ej|sgt|gen|rev|hon|capt|lt|col)\.$"
#: What stands for a missing value, and labels that stand before an answer.
PLACEHOLDERS = ["", "null", "none", "nan", "na", "nil", "undefined", "empty", "blank", "missing", "tbd", "todo", "void", "novalue", "notavailable", "notapplicable"]
LABELS = r"(?iu)^[\s\"'*#>_-]*(the )?(answer|response|reply|output|assistant|result|antwort|r[ée]ponse|respuesta|risposta|odpowied[źz]|antwoord|ответ|a)\s*[:：]"
QUESTION_LABELS = r"(?iu)^[\s\"'*#>_-]*(query|question|user|prompt|frage|pregunta|q)\s*[:：]"
#: Words that end no sentence.
OPEN_WORDS = (
    "the a an of to in on at by for from with and or that which who whose was were is are be been had has have its as than into near not did so "
    "der die das den dem des ein eine einen einem einer und oder von vom zu zur zum im am für mit auf aus wurde wurden hat hatte ist war dass nur nicht wie "
    "le la les un une des du de et ou à au aux par pour dans sur avec que qui dont est était fut ont a été si ne même comme "
    "el los las una unos del y o a por para en con que cuya fue era es ha había si no como según"
)
#: Frequent words that tell languages apart.
LANGUAGE_WORDS = {
    "en": "the of and to is that it was for on are with as this have from by but not what all were when we there an which their said if will each about how out then she many some so these would other into has more two like him could no than first been who its now the answer says texts name according contexts passages given based stands near records kept although because where which who when why how does did",
    "de": "der die das und ist von zu den dem des ein eine einen nicht mit sich auf für als auch es an er hat war wie wird bei aus nach wurde im am um noch nur oder aber vor zur bis mehr durch man sein einer einem über dann lautet antwort texten diese dieser frage steht ersten text so jahr weil heute gehört stadt wo wer wen wann welche welcher welches warum wem liegt",
    "fr": "le la les de des du et est un une que qui dans pour pas sur au par plus ce se ne avec il elle son sa aux été était sont ou mais comme on nous vous leur cette ces réponse selon textes agit passage premier dit lit texte question à s'agit c'est d'une n'a l'histoire fut même qu'il où quand quel quelle quels combien pourquoi trouve année lequel fut-elle fut-il",
    "es": "el la los las de del y en un una que es por con no se su para al lo como más o pero sus le ha este sí porque esta entre cuando muy sin sobre también hasta hay donde desde todo nos fue era respuesta según textos trata primer pasaje dice pregunta acuerdo pasajes lee texto son a quién quiénes dónde cuándo qué cuál cuántos cuántas año está fundó",
    "it": "il lo la gli le di del della dei e è un una che in per con non si da al nel nella sono come più ma anche questo questa alla domanda risposta secondo testi forniti tratta primo brano legge era si ha i chi dove quando quale quanti quante perché trova anno",
    "nl": "de het een en van is in op te dat die voor met zijn niet aan er ook als bij om uit deze dit vraag antwoord volgens gegeven teksten gaat was zo staat eerste tekst door naar maar of waar wie wanneer welke hoeveel waarom ligt",
    "pl": "i w z na do nie się to że jest o jak po od za co ale przez dla był było była ten ta te pytanie odpowiedź brzmi według podanych tekstów chodzi podaje pierwszy tekst jako gdzie kto kiedy który która ile dlaczego",
    "pt": "o a os as de do da dos das e é um uma que em no na por com não se para ao como mais mas foi era esta este pergunta resposta segundo textos trata primeiro trecho diz são quem onde quando qual quantos ano fica",
    "sv": "och att det som en på är av för den till med har de inte om ett men var jag så från vi han enligt texterna svaret frågan var vem när vilken hur",
    "tr": "ve bir bu da de için ile olarak çok daha göre metinlere cevap sorunun yanıtı olan nerede kim ne zaman hangi kaç",
}
#: Refusals by a denial and what is denied, within one clause, and words that refuse alone.
DENY_EN = r"(don.?t|do not|does not|doesn.?t|did not|didn.?t|cannot|can.?t|can not|could not|couldn.?t|won.?t|will not|would not|wouldn.?t|unable|not able|never|no|not|none of|nothing|neither|rather not|nowhere|without|lacks?|isn.?t|aren.?t|is not|fails? to)"
TOLD_EN = r"(know|knows|knowing|say|says|said|states?|stated|mentions?|mentioned|answers?|answered|answering|respond|tell|tells|told|determined?|find|finds|found|provides?|provided|given|gives?|information|info|idea|clue|help|assist|specif\w+|disclose|reveals?|comment|indicates?|indicated|covers?|covered|address\w*|contains?|establish\w*|clear|enough|sufficient|certain|sure|discuss\w*|details?|evidence|available|possible|way)"
REFUSAL = (
    rf"(?iu)\b{DENY_EN}\b[^.;!?\n]{{0,60}}?\b{TOLD_EN}\b"
    r"|\b(unknown|unclear|unanswerable|undetermined|undisclosed|silent|insufficient|unsure|uncertain|not sure|no idea|no clue|impossible to|beyond what|(must|have to|will) (decline|refuse|pass)|decline to|refuse to|prefer not to|rather not|as an? (ai|language) )"
    r"|\b(nicht|kein\w*|nichts|weder|niemand)\b[^.;!?\n]{0,60}\b(wei(ß|ss)|wissen|beantwort\w*|antwort\w*|sag\w*|angab\w*|information\w*|hervor|finden|genannt|erwähn\w*|bestimm\w*|möglich|helfen|steht|klar|entnehmen|darüber)"
    r"|\b(wei(ß|ss)|sagen|beantwort\w*|kann|könn\w*|geben|enthalten|steht|finde)\b[^.;!?\n]{0,50}\b(nicht|nichts|kein\w*)\b|\bkeine ahnung\b|\bunbekannt\b"
    r"|(\bne\b|\bn'|\bn’|\baucun\w*|\brien\b|\bimpossible\b|\bdésolé)[^.;!?\n]{0,60}\b(sais|sait|savoir|répon\w*|dis\w*|dit|dire|indiqu\w*|information\w*|mention\w*|précis\w*|trouv\w*|détermin\w*|permet\w*|donn\w*|peux|peut)|\binconnue?\b"
    r"|(\bno\b|\bning[uú]n\w*|\bnada\b|\blo siento\b|\bimposible\b)[^.;!?\n]{0,60}\b(sé|sabe\w*|saber|respond\w*|respuesta|dice\w*|decir|informaci\w*|mencion\w*|indica\w*|encontr\w*|determin\w*|contest\w*|especific\w*|puedo|puede)|\bdesconocid[oa]\b|\bse desconoce\b"
    r"|\bnon\b[^.;!?\n]{0,40}\b(so|lo so|sappiamo|posso|può|dic\w*|rispon\w*|informazion\w*)\b|\bnie\b[^.;!?\n]{0,40}\b(wiem|wiadomo|mog\w*|podaj\w*|odpowied\w*)|\b(weet|kan)\b[^.;!?\n]{0,30}\bniet\b|\bgeen (antwoord|informatie|idee)\b|\bnão\b[^.;!?\n]{0,40}\b(sei|sabe\w*|posso|dizem|respond\w*)"
    r"|не\s+(знаю|могу|сказано|указано|известно)|неизвестно|不知道|无法|不能回答|没有(提供|提到|说明)|未(提及|说明)|わかりません|不明"
)
#: A short sentence that is an apology.
APOLOGY = r"(?iu)(?:^|[.!?]\s)[^.!?]{0,60}\b(désolée?|lo siento|sorry|apologies)\b[^.!?]{0,40}(?:[.!?]|$)"
#: An answer at the end that follows upon what reads like a refusal.
YES_NO_END = r"(?iu)(?:^|[\s\"“'«,:;])(yes|no|ja|nein|oui|non|sí|si)[\s\".”»'!)\]]*(\[\d+\]\s*)?$"


SCRIPTS = {"zh": "Han", "ja": "Hiragana|Katakana", "ru": "Cyrillic", "ar": "Arabic", "ko": "Hangul", "el": "Greek", "he": "Hebrew", "hi": "Devanagari"}
YES_NO = {"yes", "no", "ja", "nein", "oui", "non", "sí", "si"}
#: Defect types in the order of their rules; an answer that is empty has no other. copied_start: it begins with the question and goes on.
DEFECTS = ("empty", "copy", "refusal", "truncated", "language", "copied_start")


@cache
def _re(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace("(?iu)", ""), regex.I if "(?iu)" in pattern else 0)


@cache
def _frequent() -> dict[str, frozenset[str]]:
    found: dict[str, set[str]] = {}
    for code, words in LANGUAGE_WORDS.items():
        for w in words.split():
            found.setdefault(w, set()).add(code)
    return {w: frozenset(codes) for w, codes in found.items()}


def _plain(text: str) -> str:
    """Letters and digits in lower case."""
    return _re(r"[^\p{L}\p{N}]+").sub("", text.lower())


def languages_of(text: str) -> tuple[frozenset[str], int]:
    """The languages that a text may be in, and by how many of its distinct words that shows.

    A script of its own tells the language, if at least four letters and a seventh of all are of it (names are often in Latin
    script); else those count that have most of its frequent words, quotations and capitalised words inside left out. Empty if it has none.
    """
    if not text.isascii():
        letters = len(_re(r"\p{L}").findall(text))
        for code, names in SCRIPTS.items():
            own = len(_re("|".join(rf"\p{{{name}}}" for name in names.split("|"))).findall(text))
            if own >= max(4, letters * 0.15):
                return frozenset({code}), own
    loose = _re(r"(?<=\s)\p{Lu}[\p{L}'’]+").sub(" ", _re('«[^»]*»|"[^"]*"|“[^”]*”').sub(" ", text))
    counts: dict[str, int] = {}
    told = 0
    for w in set(_re(r"\p{L}+(?:['’]\p{L}+)?").findall(loose.lower())):
        codes = _frequent().get(w.replace("’", "'"), ())
        told += bool(codes)
        for code in codes:
            counts[code] = counts.get(code, 0) + 1
    most = max(counts.values(), default=0)
    return frozenset(code for code, n in counts.items() if n == most), told


@lru_cache(4096)
def _asked_in(question: str) -> frozenset[str]:
    return languages_of(question)[0]


@lru_cache(4096)
def _asked(question: str) -> str:
    return _plain(question)


def _masked(text: str, names: list[str]) -> str:
    """``text`` with MASK for every whole occurrence of a name, longer names first, in any case."""
    for n in names:
        low, name = text.lower(), n.lower()
        if len(low) != len(text) or len(name) != len(n):  # a letter that grows in lower case
            text = regex.sub(rf"(?<![\p{{L}}\p{{N}}]){regex.escape(n)}(?![\p{{L}}\p{{N}}])", MASK, text, flags=regex.I)
            continue
        at, last, out = low.find(name), 0, []
        while at >= 0:
            end = at + len(name)
            if not (at and low[at - 1].isalnum() or end < len(low) and low[end].isalnum()):
                out += [text[last:at], MASK]
                last = end
                at = low.find(name, end)
            else:
                at = low.find(name, at + 1)
        if last:
            text = "".join(out) + text[last:]
    return text


#: Characters at the end of an answer that its ending is judged by.
TAIL = 400
OPEN = frozenset(OPEN_WORDS.split())
#: Words that stay as they are in the form of a sentence: those of the lists above.
FUNCTION_WORDS = OPEN | frozenset(w for words in LANGUAGE_WORDS.values() for w in words.split())
#: Signs of a form: a word, a name (a capitalised word that isn't the first, or the expected answer), a number.
WORD, NAME, NUMBER = "W", "N", "#"
PIECES = r"\p{L}[\p{L}\p{M}'’]*|\p{N}+(?:[.,]\p{N}+)*|[^\s\p{L}\p{N}]"
SENTENCE_END = r"(?<=[.!?。？！][\"”»’')\]]*)\s+|\n+"
LAST_STOP = r"\s*[.!?。？！।:][\"”»’')\]*_`]*$"


def form(sentence: str, last: str = "") -> str:
    """The form of a sentence: its pieces with a blank between, a run of names as one. ``last``: the last piece, which may be cut, stays as far as it goes ("cut"), or is a sign in any case ("whole")."""
    pieces = _re(PIECES).findall(sentence)
    out: list[str] = []
    for i, p in enumerate(pieces):
        final = last and i == len(pieces) - 1
        if final and last == "cut":
            out.append(NAME if p == MASK else p.lower())
        elif p == MASK:
            out.append(NAME)
        elif p[0].isalpha():
            low = p.lower()
            out.append(low if low in FUNCTION_WORDS and not final else NAME if i and p[0].isupper() else WORD)
        else:
            out.append(NUMBER if p[0].isnumeric() else p)
        if len(out) > 1 and out[-1] == out[-2] == NAME:
            out.pop()
    return " ".join(out)


def forms(text: str) -> tuple[list[str], str | None, str | None]:
    """(forms of the sentences, those that end with their stop marked by ``\\t.`` behind; the form of an open last sentence as it is cut, and with its last piece taken as whole)."""
    sentences = [x for x in (s.strip() for s in _re(SENTENCE_END).split(text)) if x]
    out, left, right = [], None, None
    for i, s in enumerate(sentences):
        stop = _re(LAST_STOP).search(s)
        if stop and not (i == len(sentences) - 1 and _re(ABBREVIATION).search(s[-20:].lower())):
            out.append(form(s[: stop.start()]) + WHOLE)
        elif i < len(sentences) - 1:
            out.append(form(s))
        else:
            left, right = form(s, "cut"), form(s, "whole")
            out.append(form(s))
    return out, left, right


#: What stands behind the form of a sentence that is complete.
WHOLE = "\t."


def judge(value: str, question: str | None, names: list[str]) -> tuple[list[str], list[str], str | None, str | None]:
    """(every defect that the answer triggers by itself, the forms of its sentences, the two forms of an open last sentence if it may be cut).

    Of a sentence that ends in dots, or is an item of a list, only the first form comes out: it is cut if its last word goes on.
    """
    v = (value if value.isascii() else _re(r"[\u200b-\u200f\ufeff\u00ad\u2060]").sub("", value)).strip()
    names = sorted({n for n in names if n and n.strip()}, key=len, reverse=True)
    visible = v if "<" not in v and "&" not in v else _re(r"(?s)<[^<>]{0,40}>|&[a-z]{2,6};").sub("", v)
    if _plain(_re(LABELS).sub("", visible)) in PLACEHOLDERS:
        return ["empty"], [], None, None
    found = []
    asked, plain = _asked(question or ""), _plain(v)
    if asked:
        said = _plain(_re(r"(?iu)[\s\"'*_]*\b(a|answer|antwort|réponse|respuesta)\s*[:：]?[\s\"'*_]*$").sub("", _re(QUESTION_LABELS).sub("", v)))
        if said and said.replace(asked, "") == "" or plain.replace(asked, "") == "":
            found.append("copy")
        elif plain.startswith(asked) or said.startswith(asked):
            found.append("copied_start")
    end = v[-TAIL:]  # what an answer ends with; patterns of its end never run over all of a long one
    core = v[:-TAIL] + _re(DOTS).sub("", _re(CUT_MARK).sub("", end))
    longs = [n for n in names if n.lower() not in YES_NO]
    masked = _masked(core, longs).rstrip()
    yes_no_end = bool(_re(YES_NO_END).search(end))
    named = MASK in masked or yes_no_end or bool(_re(r"(?iu)\b(answer is|texts? says?|second one says|both name|so it is)\s+[\"“']?(yes|no)\b").search(v))
    if not named and "copy" not in found and (_re(REFUSAL).search(v) or _re(APOLOGY).search(v) or _re(r"(?iu)^[^.!?]{0,60}(leider|unfortunately)[^.!?]{0,40}[.!?]?$").search(v)):
        found.append("refusal")
    ends_named = bool(_re(MASK + r"[\s\"”»’')\]*_`]*$").search(masked[-TAIL:])) or bool(_re(YES_NO_END).search(core[-TAIL:]))
    dotted, marked = bool(_re(DOTS).search(end)), bool(_re(CUT_MARK).search(end))
    short_form = bool(_re(ABBREVIATION).search(masked[-TAIL:].lower()))
    stopped = bool(_re(STOP).search(masked[-TAIL:])) and not short_form
    several = bool(_re(r"[.!?。][\"”)\]]*(\s*\[\d+\])?\s+\S").search(masked)) and not _re(r"^\s*([-*•]|\d+[.)])\s").match(masked)
    listed = "\n" in masked and bool(_re(r"\n\s*([-*•]|\d+[.)])").search(masked))
    intro = "\n" in core and bool(_re(r"(?s)^[^\n]*:\s*\n\s*([-*•]|\d+[.)])").match(core))
    stub = intro and bool(_re(r"\n\s*(([-*•]|\d+[.)]?)\s*|([-*•]|\d+[.)])\s*\S{1,4})$").search(core[-TAIL:]))
    unclosed = any(masked.count(a) > masked.count(b) for a, b in DELIMITERS) or masked.count("```") % 2 == 1
    words = masked.split()
    lower = core.lower()
    part = not ends_named and any(len(n) > 1 and any(len(core) > k + 3 and lower.endswith(" " + n[:k].lower()) for k in range(1, len(n))) for n in longs)
    tail = _re(r"([^\s\"“«(]+)$").search(core[-TAIL:])
    opened = bool(tail) and tail[1].lower() in OPEN and len(words) > 3
    ends = ends_named or stopped and not dotted
    sure = marked or stub or short_form and not yes_no_end or unclosed and not stopped or several and not listed and (not stopped or dotted) or dotted and not named
    if "copy" not in found and (sure or not ends and not listed and (part or opened)):
        found.append("truncated")
    if question and "copy" not in found:
        own = _asked_in(question)
        other, told = languages_of(masked.replace(MASK, " "))
        if own and other and not own & other and told >= 2:
            found.append("language")
    sentences, left, right = forms(masked)
    trailing = dotted and named and not several  # dots behind a whole word of one sentence are the writer's own
    goes = not stopped and (len(words) > 3 or MASK in masked) and not {"copy", "refusal"} & set(found)
    found.sort(key=DEFECTS.index)
    return found, sentences, left if goes else None, right if goes and not trailing and not listed else None


#: Marks that open and close.
DELIMITERS = ("()", "«»", "[]", "{}", "“”")
#: Distinct forms, and characters of them, up to which those that go on are broadcast; beyond, both sides are sorted.
BROADCAST_FORMS, BROADCAST_CHARS = 200_000, 64 << 20


def _small(df: DataFrame) -> DataFrame:
    rows, chars = df.agg(F.count("*"), F.coalesce(F.sum(F.length("_f")), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_FORMS and chars <= BROADCAST_CHARS else df.hint("merge")


def classify(values: DataFrame) -> DataFrame:
    """``values`` (value, question, names: array of the expected answers; other columns stay) with its defects, the first of them, and how a cut shows.

    defects: every type of DEFECTS that is triggered, in order, empty where there is none; defect: the first one that makes the answer
    defective (an answer that only begins with the question is not), else null; by: for a truncated answer ``prefix`` where longer copies go on, ``rule`` where only its own end shows it.
    Null values have no defect; null questions and names show nothing. Repeated rows are judged alike.
    A row with ``judged`` false (optional column) only lends its sentences.
    """
    kept = [c for c in values.columns if c not in ("value", "question", "names")]
    schema = ", ".join([*(f"`{c}` {values.schema[c].dataType.simpleString()}" for c in kept), "_found array<string>, _forms array<string>, _left string, _right string"])
    lent = "judged" in kept

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            asked = f["judged"] if lent else [True] * len(f)
            got = [([], [], None, None) if v is None else judge(v, q, [] if n is None else list(n)) if j else ([], lend(v, [] if n is None else list(n)), None, None) for v, q, n, j in zip(f["value"], f["question"], f["names"], asked, strict=True)]
            yield pd.concat([f[kept], pd.DataFrame(got, columns=["_found", "_forms", "_left", "_right"], index=f.index)], axis=1)

    judged = durable(spread(values.select(*kept, "value", "question", "names")).mapInPandas(run, schema))
    said = judged.select(F.explode("_forms").alias("_f")).distinct()
    asking = judged.select(F.explode(F.array("_left", "_right")).alias("_f")).where("_f is not null").distinct()
    both = durable(said.withColumn("_said", F.lit(True)).unionByName(asking.withColumn("_said", F.lit(False))).groupBy("_f").agg(F.max("_said").alias("_said")))
    whole = both.where(F.col("_said") & F.col("_f").endswith(WHOLE)).select(F.expr(f"left(_f, length(_f) - {len(WHOLE)})").alias("_f"))
    goes = longer_copies(both, "_f", "_said").where(F.col("rest") != WHOLE).select("_f", F.col("rest").rlike(r"^\p{L}").alias("_inside"))
    on = (goes.join(asking, "_f", "left_semi").groupBy("_f").agg(F.max("_inside").alias("_inside")))
    known = durable(on.join(whole.join(asking, "_f", "left_semi").withColumn("_whole", F.lit(True)), "_f", "full"))
    own = judged.where("judged") if lent else judged
    small = _small(known)
    asked = own.where("_left is not null").join(small.toDF("_left", "_on_left", "_whole_left"), "_left", "left").join(small.toDF("_right", "_on_right", "_whole_right"), "_right", "left")
    goes_on = F.col("_on_left").isNotNull() | F.col("_on_right").isNotNull()
    prefix = F.when(F.col("_right").isNull(), F.coalesce("_on_left", F.lit(False))).otherwise(goes_on & F.col("_whole_left").isNull() & F.col("_whole_right").isNull())
    rest = own.where("_left is null")
    all_ = asked.select(*kept, "_found", prefix.alias("_prefix")).unionByName(rest.select(*kept, "_found", F.lit(False).alias("_prefix")))
    cut = F.col("_prefix") | F.array_contains("_found", "truncated")
    defects = F.filter(F.array(*map(F.lit, DEFECTS)), lambda d: F.when(d == "truncated", cut).otherwise(F.array_contains("_found", d)))
    first = F.get(F.filter(defects, lambda d: d != "copied_start"), F.lit(0))
    by = F.when(F.col("_prefix"), "prefix").when(cut, "rule")
    return all_.select(*[c for c in kept if c != "judged"], defects.alias("defects"), first.alias("defect"), by.alias("by"))


def lend(value: str, names: list[str]) -> list[str]:
    """The forms of the sentences of an answer that is not judged itself."""
    return forms(_masked(value, sorted({n for n in names if n and n.strip() and n.lower() not in YES_NO}, key=len, reverse=True)).rstrip())[0]
