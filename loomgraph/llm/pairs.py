"""Problem 2: broken prompt and response pairs.

An answer is unwrapped (fences, JSON, list marks, emphasis, labels) by a pushdown
parser that also tells what it leaves open. Then, in this order: nothing left is
empty; a sentence of the refusal grammar is a refusal; greedy string tiling over the
question with nothing else left is an echo; another script or another language's
function words than the question calls for is wrong_language; open structure or an
unfinished last sentence is truncated.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import langid
from loomgraph.plans.runtime import ship, spread

_INVISIBLE = re.compile("[​-‏⁠﻿­\x00-\x08]")
# What stands for an absent answer.
_NOTHING = {"", "na", "none", "null", "nil", "nan", "undefined", "noanswer", "empty", "tbd", "todo", "keine", "aucune", "ninguna", "noresponse", "keineantwort", "sinrespuesta", "sansréponse", "leer", "vacío", "vide", "blank"}
# Labels put before an answer or a repeated question.
_LABEL = re.compile(r"^\s*(?:\*\*|__)?(?:final answer|the answer is|answer|response|note|reply|réponse|respuesta|antwort|hinweis|nota|remarque|assistant|a|r)(?:\*\*|__)?\s*:\s*", re.I)
_ASKED = re.compile(r"^\s*(?:you asked|your question(?: was)?|the question(?: is| was)?|question|query|q|user|sie fragten|ihre frage(?: war)?|die frage(?: ist| war)?|frage|vous avez demandé|votre question|la question(?: est)?|usted preguntó|su pregunta(?: es)?|la pregunta(?: es)?|preguntó|pregunta|f|p)\s*:\s*", re.I)
_WORD = re.compile(r"\w+(?:[’'-]\w+)*")
_FINAL = re.compile(r"[.!?。！？।؟]$")
_CLOSERS = " \t\r\n\"'”’»“)]}）」』›*_`"

# --- refusal grammar ---------------------------------------------------------------------------
# Productions by language. A word in <> is a nonterminal of the same language, ~n a gap of up to n characters
# within the sentence, ^ the beginning of a sentence or clause, $ its end; anything else is a regular expression of one word or more.
GRAMMAR: dict[str, dict[str, list[str]]] = {
    "en": {
        "refusal": [
            "<speaker><be>? <truly>?<sorry>", "<speaker> <cannot> ~60 <answering>", "<speaker> have no <matter>", "<speaking as> <machine>", "my <rules> ~30 <forbid>",
            "<opening><not able> be <answered>", "no answer can be (?:given|provided|found)", "nothing can be (?:concluded|said|determined)", "no conclusion (?:is|can be)", "no answer (?:is|can be)",
            "(?:does|do|did)(?: not|n['’]t) <hold> ~30 <basis>", "<too little> <matter of proof>", "<source> ~30 (?:is|are) silent", "<topic> (?:falls|lies|is) (?:outside|beyond)(?: of)? <remit>",
            "(?:not possible|impossible) for me", "have no access to", "<first>unable to <help>", "^(?:unfortunately|apologies|my apologies|sorry)\\s*[,.!:;]",
            "none of the <source> ~60 (?:says?|mentions?|answers?|states?|tells?)", "^(?:unknown|not known|no idea|no information|not <given>(?: in [^.]*)?)\\.?$",
        ],
        "speaker": ["i", "we"], "be": ["['’]m", " am", "['’]re", " are"], "truly": ["(?:really|very|so|truly) "], "sorry": ["sorry", "afraid"],
        "cannot": ["can(?:no|['’])?t", "can not", "could(?: not|n['’]t)", "will not", "won['’]t", "would not", "am <unfit>", "are (?:unable|not able)", "was unable", "do not", "don['’]t", "must", "have to", "need to", "would rather not", "would only be", "would be", "prefer not", "decline", "refuse", "have no <matter>"],
        "unfit": ["unable", "not able", "not allowed", "not permitted"], "matter": ["access", "information", "way", "knowledge", "data"],
        "answering": ["(?:answer|help|determine|say|know|declin|guess|tell|provid|discuss|assist|giv|find|identif|access|confirm|infer|information|comment|refus|respond)\\w*", "have enough"],
        "speaking as": ["as an?", "being an?"], "machine": ["ai", "(?:large )?language model", "assistant", "artificial"],
        "rules": ["guidelines", "instructions", "policy", "policies", "rules", "training", "programming"], "forbid": ["prevent\\w*", "forbid\\w*", "prohibit\\w*", "(?:do not|don['’]t) (?:allow|permit)"],
        "opening": ["^", "(?:this|that|it|which|answer) "], "not able": ["can ?not", "can['’]t", "could not", "couldn['’]t"], "answered": ["determined", "answered", "said", "established", "inferred", "given", "known"],
        "hold": ["contain", "provide", "include", "give", "have", "offer", "hold", "mention", "allow"], "basis": ["enough", "sufficient", "information", "answer", "evidence to"],
        "too little": ["insufficient", "not enough", "no sufficient"], "matter of proof": ["evidence", "information", "context", "data", "details"],
        "source": ["passages?", "context", "graph", "documents?", "sources?", "nodes", "text", "evidence", "material"], "topic": ["this", "that", "it", "the question", "which"], "remit": ["what", "my", "the scope", "our"],
        "first": ["^", "(?:i|we) (?:am|are|was|were|remain) ", "(?:i['’]m|we['’]re) ", "currently ", "regret "], "help": ["answer", "help", "assist", "determine", "comment", "provide", "respond"], "given": ["stated", "specified", "mentioned", "given", "available", "provided"],
    },
    "de": {
        "refusal": [
            "<speaker> ~50 <negation> ~40 <answering>", "<can> <speaker> ~50 <negation>", "<speaker> <am or can> ~40 <denial>", "tut mir leid", "als <machine>", "(?:lässt|lassen|läßt) sich ~40 nicht <found>",
            "<too little> (?:ausreichenden? )?(?:informationen|angaben|belege|hinweise|antwort möglich)", "reich(?:t|en) ~40 nicht aus", "meine (?:richtlinien|vorgaben)", "^leider ~60 (?:nicht|keine?)",
        ],
        "speaker": ["ich", "wir"], "negation": ["nicht", "keine?n?", "leider"], "answering": ["(?:beantworten|sagen|wissen|helfen|geben|ermitteln|bestimmen|antworten|auskunft|beurteilen)\\w*"],
        "can": ["kann", "können", "darf", "dürfen", "möchte", "weiß", "will"], "am or can": ["weiß", "wissen", "kann", "können", "darf", "möchte", "will", "bin", "habe", "muss"],
        "denial": ["nicht", "keine?n?", "ablehnen", "außerstande", "nicht in der lage"], "machine": ["ki", "sprachmodell", "assistent"], "found": ["(?:ermitteln|beantworten|sagen|bestimmen|feststellen|entnehmen|klären)\\w*"],
        "too little": ["keine", "nicht genügend", "nicht genug", "unzureichende"],
    },
    "fr": {
        "refusal": [
            "je (?:ne|suis (?:désolé|navré|dans l['’]incapacité)|préfère ne pas|refuse|regrette|dois décliner)\\w*", "je n['’]\\w+", "(?:désolée?|navrée?) ~20 [,.]", "ne (?:me )?permet(?:tent)? pas de <answering>",
            "(?:il|cela) (?:ne )?m['’]est (?:pas possible|impossible)", "impossible de (?:répondre|déterminer|le dire|le savoir)", "en tant? que? <machine>", "malheureusement ~80 <none>", "<none> (?:assez d['’]|suffisamment d['’])?informations?",
        ],
        "answering": ["répondre", "le dire", "déterminer", "conclure"], "machine": ["modèle", "ia", "assistant"], "none": ["pas", "aucune?"],
    },
    "es": {
        "refusal": [
            "lo siento", "(?:lamento|lamentablemente|desgraciadamente|por desgracia)", "no <can>", "no (?:me )?es posible", "(?:me )?es imposible", "como <machine>", "no <hold> ~40 <basis>",
            "prefiero no", "no se puede <answering>", "mis (?:normas|directrices|instrucciones)",
        ],
        "can": ["puedo", "podemos", "sé", "sabría", "tengo", "dispongo", "estoy"], "machine": ["modelo", "ia", "asistente"], "hold": ["contiene", "ofrece", "incluye", "permite", "hay", "basta"],
        "basis": ["(?:información|responder|suficiente|datos|determinar|saber)\\w*"], "answering": ["determinar", "responder", "saber", "decir"],
    },
}


def derive(grammar: dict[str, list[str]], symbol: str, open_: tuple[str, ...] = ()) -> str:
    """Regular expression of all that ``symbol`` derives; the grammar has no recursion, so the language is regular."""
    if symbol in open_:
        raise ValueError(f"{symbol} derives itself")
    out = []
    for production in grammar[symbol]:
        x = re.sub(r"<([^<>]+)>", lambda m: derive(grammar, m.group(1), (*open_, symbol)), production)
        x = re.sub(r" ?~(\d+) ", r"\\b[^.!?]{0,\1}?(?<!\\w)", x)
        if x.startswith("^"):
            x = r"(?:\A|(?<=[.!?:;,]\s))" + x[1:]
        out.append(x[:-1] + r"\Z" if x.endswith("$") else x)
    return f"(?:{'|'.join(out)})"


_REFUSALS = [re.compile(rf"(?<!\w){derive(g, 'refusal')}(?!\w)", re.I) for g in GRAMMAR.values()]


def refuses(content: str) -> bool:
    """Whether a sentence of the refusal grammar stands in the text."""
    s = " ".join(content.split())
    return any(r.search(s) for r in _REFUSALS)


# How a question asks for an answer in another language.
_CALLS = [
    ("de", re.compile(r"\b(?:in german|auf deutsch|ins deutsche|en alemán|al alemán|en allemand)\b", re.I)),
    ("es", re.compile(r"\b(?:in spanish|auf spanisch|ins spanische|en español|al español|en espagnol)\b", re.I)),
    ("fr", re.compile(r"\b(?:in french|auf französisch|ins französische|en francés|al francés|en français)\b", re.I)),
    ("en", re.compile(r"\b(?:in english|auf englisch|ins englische|en inglés|al inglés|en anglais)\b", re.I)),
    ("zh", re.compile(r"\b(?:in chinese|auf chinesisch|en chino|en chinois)\b", re.I)),
    ("ja", re.compile(r"\b(?:in japanese|auf japanisch|en japonés|en japonais)\b", re.I)),
    ("ar", re.compile(r"\b(?:in arabic|auf arabisch|en árabe|en arabe)\b", re.I)),
    ("hi", re.compile(r"\b(?:in hindi|auf hindi|en hindi)\b", re.I)),
    ("th", re.compile(r"\b(?:in thai|auf thai|en tailandés|en thaï)\b", re.I)),
]

_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）"}


_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?(/?)>")
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr"}  # fixed values: tags that hold nothing
_MARK = re.compile(r"(?m)^[^\S\n]*(?:[-*•]|\d{1,3}[.)])(?:[^\S\n]+|$)")


def open_structure(s: str) -> str | None:
    """Pushdown parser over fences, brackets, quotations, emphasis, tags and list items: what the text leaves open, or None.

    A closing mark without its opener is ignored; an apostrophe opens nothing; a void
    tag and a self-closing one hold nothing; the mark of a list item closes the emphasis
    and quotation that the item before left open, and leaves the item open if nothing
    follows it.
    """
    stack: list[str] = []
    items = {m.start(): m.end() for m in _MARK.finditer(s)}
    i, n = 0, len(s)
    while i < n:
        if s.startswith("```", i):
            if stack and stack[-1] == "```":
                stack.pop()
            else:
                stack.append("```")
            i += 3
            continue
        if stack and stack[-1] == "```":
            i += 1
            continue
        if i in items:
            if "item" in stack:
                del stack[stack.index("item") :]
            stack.append("item")
            i = items[i]
            continue
        if s.startswith("**", i):
            if "**" in stack:
                del stack[stack.index("**") :]
            else:
                stack.append("**")
            i += 2
            continue
        ch = s[i]
        if ch == "<":
            m = _TAG.match(s, i)
            if m:
                tag = f"</{m.group(2).lower()}>"
                if m.group(1):
                    if tag in stack:
                        del stack[len(stack) - 1 - stack[::-1].index(tag) :]
                elif not m.group(3) and m.group(2).lower() not in _VOID:
                    stack.append(tag)
                i = m.end()
                continue
            if re.match(r"</?[A-Za-z][^<>]*$", s[i:]):
                return "<"  # cut inside a tag
        if ch == "\\":
            i += 2
            continue
        if stack and ch == stack[-1]:
            stack.pop()
        elif ch == '"':
            if '"' in stack:
                del stack[stack.index('"') :]
            else:
                stack.append('"')
        elif ch in _OPEN:
            stack.append(_OPEN[ch])
        elif ch in ")]}”»」』）" and ch in stack:
            del stack[len(stack) - 1 - stack[::-1].index(ch) :]
        i += 1
    if stack and stack[-1] == "item":  # the last item is open if it is empty
        stack.pop() if not s.rstrip() == s[: max(items.values())].rstrip() else None
    return stack[-1] if stack else None


def list_items(s: str) -> list[str]:
    """The items of a text that is a list and nothing else; none otherwise."""
    at = [(m.start(), m.end()) for m in _MARK.finditer(s)]
    if len(at) < 2 or s[: at[0][0]].strip():
        return []
    return [s[e : at[k + 1][0] if k + 1 < len(at) else len(s)].strip() for k, (_, e) in enumerate(at)]


def unwrap(a: str) -> tuple[str, bool]:
    """(content, broken): the answer without wrappers; broken if a wrapper was never closed."""
    s, broken = _INVISIBLE.sub("", a).strip(), False
    for _ in range(12):
        t = s
        if s.startswith("```"):
            head, _, rest = s.partition("\n")
            if rest.rstrip().endswith("```"):
                s = rest.rstrip()[:-3].strip()
            else:
                s, broken = rest, True
        elif s[:1] in "{[" and not re.match(r"\[\d+\]", s):
            try:
                v = json.loads(s)
                while isinstance(v, (dict, list)) and v:
                    v = next(iter(v.values() if isinstance(v, dict) else v))
                s = "" if v is None or isinstance(v, (dict, list)) else str(v).strip()
            except ValueError:
                m = re.match(r'[{\[]\s*(?:"[^"]*"\s*:\s*)?"?', s)
                if '"' in s[:40] and open_structure(s):
                    s, broken = s[m.end() :], True
        else:
            for x in ("**", "__", "*", "_", "`"):
                if len(s) > 2 * len(x) and s.startswith(x) and s.endswith(x):
                    s = s[len(x) : -len(x)].strip()
            for o, c in (('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("'", "'")):
                if len(s) >= 2 and s[0] == o and s[-1] == c and o not in s[1:-1] and c not in s[1:-1]:
                    s = s[1:-1].strip()
        s = re.sub(r"^\s*(?:[-*•>]|#{1,6})\s+", "", s)
        s = _LABEL.sub("", s).strip()
        if s == t:
            break
    return s, broken


def words(s: str) -> list[str]:
    return [w.casefold() for w in _WORD.findall(s)]


def tiles(a: list[str], q: list[str], least: int = 2) -> list[bool]:
    """Greedy string tiling: which words of ``a`` lie in tiles shared with ``q``.

    In rounds of decreasing length the longest matches of unmarked words are found and
    both their sides marked, until none of ``least`` words is left. Where ``a`` repeats
    ``q``, what is left is tiled against the whole of ``q`` again.
    """
    covered, least = [False] * len(a), min(least, len(q))
    while least:
        used, gained = [False] * len(q), False
        while True:
            longest, found = least, []
            at: dict[str, list[int]] = {}
            for j, w in enumerate(q):
                if not used[j]:
                    at.setdefault(w, []).append(j)
            for i in range(len(a)):
                if covered[i]:
                    continue
                for j in at.get(a[i], ()):
                    if i and j and not covered[i - 1] and not used[j - 1] and a[i - 1] == q[j - 1]:
                        continue  # part of a match that began before
                    k = 0
                    while i + k < len(a) and j + k < len(q) and a[i + k] == q[j + k] and not covered[i + k] and not used[j + k]:
                        k += 1
                    if k > longest:
                        longest, found = k, [(i, j)]
                    elif k == longest:
                        found.append((i, j))
            if not found:
                break
            for i, j in found:
                if not any(covered[i : i + longest]) and not any(used[j : j + longest]):
                    covered[i : i + longest] = used[j : j + longest] = [True] * longest
                    gained = True
        if not gained:
            break
    return covered


def is_echo(content: str, query: str) -> bool:
    """The question and nothing else: all words but a label lie in tiles, and the tiles give back the whole question."""
    s = content
    for _ in range(3):
        s = _ASKED.sub("", s).strip(" \t\r\n\"“”„«»*_")
    s = re.sub(r"\s*(?:answer|antwort|réponse|respuesta|a)\s*:\s*$", "", s, flags=re.I)
    a, q = words(s), words(query)
    if len(q) < 2 or len(a) < 0.9 * len(q):
        return False
    covered = tiles(a, q)
    return sum(covered) >= 0.95 * len(a) and sum(tiles(q, a)) >= 0.95 * len(q)


def expected_language(query: str, lang: str | None) -> str | None:
    """The language that the question calls for: the one it names, else its own."""
    for code, rx in _CALLS:
        if rx.search(query):
            return code
    s = langid.script(query)
    if s not in (None, "latin"):
        return s
    return lang if lang in langid.LANGS else langid.detect(query)


def wrong_language(content: str, query: str, lang: str | None) -> bool:
    """Whether the answer is not in the language asked for; a name, number or noun phrase has none."""
    want = expected_language(query, lang)
    if want is None:
        return False
    s = langid.script(content)
    if s is None:
        return False
    if s != "latin" or want not in langid.LANGS:
        return s != want and not (s == "latin" and len(words(content)) <= 6)
    asked = set(words(query))
    own = " ".join(w for w in _WORD.findall(content) if w.islower() and (w.casefold() not in asked or w.casefold() in langid._WEIGHT))
    got = langid.scores(own)
    best = max(got, key=got.get)
    return best != want and got[best] >= 1.5 and got[best] >= 2 * got.get(want, 0.0) and len(words(content)) >= 4


_BEFORE_END = re.compile(r"(?:^|[\s(“„«\"])(?:[A-ZÀ-Ý]|St|Dr|Mr|Mrs|Ms|Prof|Sra?|Mme|No|Nr|Fig|Abb|vs|cf|vgl|ca|approx|aprox|env|z\. ?B|d\. ?h|e\.g|i\.e|p\. ?ej|p\. ?ex)\.$")


def unfinished(content: str, query: str = "") -> bool:
    """Whether the text stops inside a word or sentence; words it takes over from the question show that it is one."""
    s = content.rstrip()
    dots = re.sub(r"(?:\s|…|\.\.\.)+$", "", s)
    if dots != s:
        if _FINAL.search(dots.rstrip(_CLOSERS)):
            s = dots
        else:
            return len(words(dots)) > 1
    if open_structure(s):
        return True
    core = s.rstrip(_CLOSERS)
    if _FINAL.search(core):
        return bool(_BEFORE_END.search(core)) and len(words(core)) > 3
    w = _WORD.findall(core)
    if len(w) < 2:
        return False
    if core[-1] in ",;:-–—(":
        return True
    items = list_items(core)
    if items:  # the last item is judged by its siblings: those without a final mark are names
        if any(_FINAL.search(x.rstrip(_CLOSERS)) for x in items[:-1]):
            return True
        return unfinished(items[-1], query)
    if "\n" in core.strip() and len(w) > 8:
        return True
    small = [x for x in w if x.islower() and x in langid._WEIGHT]
    name_like = sum(x[0].isupper() or x[0].isdigit() for x in w)
    if w[-1].islower() and w[-1] in langid._WEIGHT:
        return True  # a preposition, article or auxiliary cannot end a phrase
    if len(w) >= 10:
        return True
    q = _WORD.findall(query)
    said = {(a, b) for a, b in zip(q, q[1:]) if a.islower() and b.islower()}
    if len(w) > 3 and any((a, b) in said for a, b in zip(w, w[1:])):
        return True
    if len(w) > 3 and any(re.findall(r"(?<!\w)[^\W\d_A-Z]+ (?=[^\W\d_A-Z]+(?!\w))", core)):
        return True  # two words in small letters in a row: more than a name
    if re.search(r"[.!?]\s", core) and not re.fullmatch(r"(?:(?:[A-ZÀ-Ý]|St|Dr)\.\s*)+\S+(?:\s\S+)*", core):
        return True
    return bool(small) and len(w) >= 4 and name_like < len(w) - 1 and (len(small) > 1 or len(w) > 5) or bool(small) and w[0].lower() in _STARTS and len(w) >= 3


#: Words that begin a sentence of an answer, never a noun phrase of four words or less.
_STARTS = {"about", "before", "etwa", "am", "vor", "zuerst", "environ", "avant", "unos", "antes", "fue", "no", "nein", "non", "c'est", "in", "because", "while"}


def defect(query: str | None, answer: str | None, lang: str | None) -> str | None:
    """The defect of one pair, or None. A NULL answer is empty; a NULL question echoes nothing and calls for ``lang``."""
    query = query or ""
    if answer is None:
        return "empty"
    content, broken = unwrap(answer)
    letters = "".join(c for c in content.casefold() if c.isalnum())
    if letters in _NOTHING:
        return "empty" if not broken or not letters else "truncated"
    if is_echo(content, query):
        return "echo"
    if refuses(_LABEL.sub("", content)):
        return "refusal"
    if wrong_language(content, query, lang):
        return "wrong_language"
    if broken or unfinished(content, query):
        return "truncated"
    return None


def broken_pairs(df: DataFrame) -> DataFrame:
    """(id, query, answer, lang, prompt) -> (id, defect) of the defective pairs with a prompt.

    Rows without prompt were not asked; an id delivered twice counts once; NULLs as in ``defect``.
    """
    ship(df.sparkSession)
    schema = pa.schema([("id", pa.string()), ("defect", pa.string())])

    def run(batches):
        for b in batches:
            got = [(i, defect(q, a, g)) for i, q, a, g in zip(*(c.to_pylist() for c in b.columns))]
            got = [x for x in got if x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string())], schema=schema)

    asked = df.where(F.col("prompt").isNotNull()).select(F.col("id").cast("string"), "query", "answer", "lang")
    return spread(asked).mapInArrow(run, "id string, defect string").dropDuplicates(["id"])
