"""Problem 1: sentence units of texts in nine languages.

Corpus statistics are learned unsupervised per language in one distributed pass:
word types with and without a final period, and what follows a period. Log-likelihood
ratios over these counts give abbreviations, sentence starters, and collocations of an
abbreviation with a word or a number; each period is then classified with them. Other scripts use their own
marks, and scripts without marks their spaces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import langid
from loomgraph.plans.runtime import ship, spread

#: A count below this is no evidence, and a list that reaches the driver holds only entries with at least this share of
#: what it is drawn from: it has at most 1 / SHARE entries a language, whatever the number of texts.
MIN_COUNT, SHARE = 3, 2e-5
#: Distinct entries that a counting task holds before it hands them on.
HELD = 400_000
#: Thresholds of the log-likelihood ratios (Dunning): starters, collocations, abbreviations.
STARTER_LLR, COLLOCATION_LLR, ABBREVIATION_SCORE = 10.0, 8.0, 0.3
#: Least share of a word's occurrences that follow a certain sentence end, for a starter.
STARTER_SHARE = 0.35

_TOKEN = re.compile(r"""[^\s.,;:!?()\[\]"“”„«»।؟،؛…]+(?:\.[^\s.,;:!?()\[\]"“”„«»।؟،؛…]+)*\.?""")
_NEXT = re.compile(r"""\.[”"»)]*\s+["“„«(¿¡]*([^\s.,;:!?()\[\]"“”„«»।؟،؛…]+)""")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_EVENT = re.compile(r"""[.!?。！？।؟…‼⁇⁈⁉]+|["“”„«»「」『』()（）\[\]]""")
_CLOSE_OF = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]"}
_OPEN = set("“„«「『(（[\"¿¡‘")
_UNSPACED = {"zh", "ja", "th"}
_ATTRIBUTED = {"zh", "ja", "hi"}  # here a quotation that opens a sentence is followed by its attribution
_NUMBER = re.compile(r"[\d.,]*\d[\d.,]*$")


def language(text: str, lang: str | None) -> str:
    """The column ``lang``, unless the script contradicts it or it is missing."""
    s = langid.script(text)
    if s not in (None, "latin"):
        return s
    if lang in langid.LANGS:
        return lang
    return langid.detect(text) or "en"


# --- learning -----------------------------------------------------------------------------


def count_text(text: str, tok: Counter, pairs: Counter) -> None:
    """Add one text's tokens and period contexts."""
    tok.update(_TOKEN.findall(text))
    for x in _NEXT.finditer(text):
        a, b = _left(text, 0, x.start()), x.group(1)
        if not a:
            continue
        if b[0].isdigit():
            b = "##"
        pairs["##" if _NUMBER.match(a) else a.lower(), b] += 1


_COUNTS = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tok: dict[str, Counter] = {}
    pairs: dict[str, Counter] = {}
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text:
                k = language(text, lang)
                if k not in _UNSPACED:
                    count_text(text, tok.setdefault(k, Counter()), pairs.setdefault(k, Counter()))
        if sum(map(len, tok.values())) + sum(map(len, pairs.values())) > HELD:
            yield from _rows(tok, pairs)
            tok, pairs = {}, {}
    yield from _rows(tok, pairs)


def _rows(tok: dict[str, Counter], pairs: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for k in tok:
        t, p = tok[k], pairs[k]
        types: Counter = Counter()
        for w, n in t.items():
            types["p" if w.endswith(".") else "t", w.rstrip(".") if w.endswith(".") else w] += n
        rows = [(k, kind, w, "", n) for (kind, w), n in types.items()] + [(k, "pair", a, c, n) for (a, c), n in p.items()]
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 50_000]), _COUNTS)], schema=_COUNTS)


def _xlogx(a, b):
    """a * ln(a / b), 0 where a is 0."""
    return F.when(a > 0, a * F.log(a / b)).otherwise(F.lit(0.0))


def llr(k11, n1, k, n):
    """Dunning's log-likelihood ratio of k11 joint events among n1 and k of n, as a column."""
    k12, k21 = n1 - k11, k - k11
    k22 = n - n1 - k21
    e = lambda r, c: r * c / n
    return 2 * (_xlogx(k11, e(n1, k)) + _xlogx(k12, e(n1, n - k)) + _xlogx(k21, e(n - n1, k)) + _xlogx(k22, e(n - n1, n - k)))


class Model(dict):
    """Per language: ``starters`` (set), ``ends`` (type -> probability that its period ends a sentence), ``ordinal`` (words bound to a number before them), ``numbered`` (types bound to a number behind them), ``pairs`` (type and the word bound to it)."""

    def of(self, lang: str) -> dict:
        return self.get(lang) or {"starters": frozenset(), "ends": {}, "ordinal": frozenset(), "numbered": frozenset(), "pairs": frozenset()}


def enough(n, total):
    """Whether a count is evidence and has the least share of its total."""
    return (n >= MIN_COUNT) & (n >= total * SHARE)


def _collocations(pairs: DataFrame, flagged: DataFrame, starters: DataFrame) -> DataFrame:
    """(lang, a, b): abbreviation and next word that go together more often than chance."""
    d = F.col
    total = pairs.groupBy("lang").agg(F.sum("n").alias("tot"))
    left, right = pairs.groupBy("lang", "a").agg(F.sum("n").alias("m")), pairs.groupBy("lang", "b").agg(F.sum("n").alias("k"))
    c = pairs.where("b <> '##' and a <> '##'").join(flagged.select("lang", "a"), ["lang", "a"]).join(F.broadcast(total), "lang").where(enough(d("n"), d("tot")))
    c = c.join(starters, ["lang", "b"], "left_anti").join(left, ["lang", "a"]).join(right, ["lang", "b"])
    return c.where((d("n") / d("m") > d("k") / d("tot")) & (llr(d("n"), d("m"), d("k"), d("tot")) >= COLLOCATION_LLR)).select("lang", "a", "b")


def _numbers(c: DataFrame, pairs: DataFrame, starters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words bound to a number before them, types bound to a number behind them)."""
    d = F.col
    # types bound to a number behind their period, such as "No. 7"
    digit = F.sum(F.when(d("b") == "##", d("n")).otherwise(0.0))
    by_type = pairs.groupBy("lang", "a").agg(digit.alias("k"), F.sum("n").alias("m"))
    share = by_type.where("a <> '##'").groupBy("lang").agg(F.sum("k").alias("kt"), F.sum("m").alias("mt"))
    numbered = (
        by_type.where((d("a") != "##") & (d("k") >= 0.8 * d("m"))).join(F.broadcast(share), "lang")
        .where(enough(d("k"), d("kt")) & (llr(d("k"), d("m"), d("kt"), d("mt")) >= COLLOCATION_LLR)).select("lang", "a")
    )
    nums = c.where("kind = 'pair' and a = '##'").select("lang", "b", "n")
    n_num = nums.groupBy("lang").agg(F.sum("n").alias("nn"))
    after = c.where("kind = 'pair'").groupBy("lang", "b").agg(F.sum("n").alias("k"))
    n_pair = c.where("kind = 'pair'").groupBy("lang").agg(F.sum("n").alias("tot"))
    ordinal = (
        nums.where(d("b") != "##").join(F.broadcast(n_num), "lang").where(enough(d("n"), d("nn"))).join(after, ["lang", "b"]).join(F.broadcast(n_pair), "lang")
        .where((d("n") / d("nn") > d("k") / d("tot")) & (d("n") >= 0.7 * d("k")) & (llr(d("n"), d("nn"), d("k"), d("tot")) >= COLLOCATION_LLR))
        .join(starters, ["lang", "b"], "left_anti").select("lang", "b")
    )
    return ordinal, numbered


def learn(texts: DataFrame, ends_only: bool = False) -> Model:
    """Learn from all rows of ``texts`` (text, lang); only lists that pass the tests and have a least share reach the driver.

    ``ends_only`` leaves out what only the classification of numbers needs.
    """
    ship(texts.sparkSession)
    c = spread(texts.select("text", "lang")).mapInArrow(_count, "lang string, kind string, a string, b string, n bigint")
    c = c.groupBy("lang", "kind", "a", "b").agg(F.sum("n").cast("double").alias("n")).persist()
    d = F.col
    n_all = c.where("kind in ('t','p')").groupBy("lang").agg(F.sum("n").alias("tot"), F.sum(F.when(d("kind") == "p", d("n")).otherwise(0.0)).alias("NP"))
    types = (
        c.where("kind in ('t','p')").groupBy("lang", F.lower("a").alias("a"))
        .agg(F.sum(F.when(d("kind") == "p", d("n")).otherwise(0.0)).alias("cp"), F.sum(F.when(d("kind") == "t", d("n")).otherwise(0.0)).alias("ct"), F.sum(F.when((d("kind") == "p") & (d("a") == F.lower("a")), d("n")).otherwise(0.0)).alias("cl"))
        .where(d("cp") >= MIN_COUNT).join(F.broadcast(n_all), "lang").where(enough(d("cp"), d("NP")))
    )
    p0, k, n = F.least(F.greatest(d("NP") / d("tot"), F.lit(1e-9)), F.lit(1 - 1e-9)), d("cp"), d("cp") + d("ct")
    lam = 2 * (k * F.log(F.lit(0.99) / p0) + d("ct") * F.log(F.lit(0.01) / (1 - p0)))
    bare = F.length(F.translate("a", ".", ""))
    score = lam * F.exp(-bare.cast("double")) * (F.length("a") - bare + 1) * F.pow(bare.cast("double") + 0.001, -d("ct"))
    # in a script without case, a word of four letters or more is none: it may end every sentence it is in
    uncased = (F.lower("a") == F.upper("a")) & (F.length("a") >= 4)
    flagged = types.where((score >= ABBREVIATION_SCORE) & (n > 0) & ~uncased).select("lang", "a", (d("cl") >= 0.9 * d("cp")).alias("small")).persist()
    # a period behind any other type is a certain end
    pairs = c.where("kind = 'pair'").select("lang", "a", "b", "n")
    sure = pairs.where("a <> '##' and length(a) > 1").join(flagged.select("lang", "a"), ["lang", "a"], "left_anti")
    n_sure = sure.groupBy("lang").agg(F.sum("n").alias("n1"))
    total = c.where("kind in ('t','p')").groupBy("lang", d("a").alias("b")).agg(F.sum("n").alias("k"))
    starters = (
        sure.where("b <> '##'").groupBy("lang", "b").agg(F.sum("n").alias("n")).join(F.broadcast(n_sure), "lang").where(enough(d("n"), d("n1")))
        .join(total, ["lang", "b"]).join(F.broadcast(n_all), "lang")
        .where((d("n") / d("k") >= STARTER_SHARE) & (d("n") / d("n1") > d("k") / d("tot")) & (llr(d("n"), d("n1"), d("k"), d("tot")) >= STARTER_LLR))
        .select("lang", "b")
    )
    starters = starters.persist()
    # how often a starter follows each flagged type's period, against the same behind certain ends
    s = starters.withColumn("s", F.lit(1.0))
    hit = F.sum(F.coalesce(d("s"), F.lit(0.0)) * d("n"))
    # a longer word in small letters before capitals only is a common word that happens to end sentences
    word = d("small") & (F.length("a") >= 4) & ~F.contains("a", F.lit(".")) & (d("up") >= 0.9)
    base = sure.join(s, ["lang", "b"], "left").groupBy("lang").agg((hit / F.sum("n")).alias("r0"))
    ends = (
        pairs.join(flagged, ["lang", "a"]).join(s, ["lang", "b"], "left").groupBy("lang", "a", "small")
        .agg((hit / F.sum("n")).alias("r"), (F.sum(F.when(d("b").rlike(r"^\p{Lu}"), d("n")).otherwise(0.0)) / F.sum("n")).alias("up"))
        .join(F.broadcast(base), "lang", "left").select("lang", "a", F.when(word, F.lit(1.0)).otherwise(F.least(F.lit(1.0), d("r") / F.greatest(F.coalesce(d("r0"), F.lit(0.5)), F.lit(0.05)))).alias("p"))
    )
    lists = starters.selectExpr("lang", "'s' kind", "b a", "'' b", "1.0D p").unionByName(ends.selectExpr("lang", "'e' kind", "a", "'' b", "p"))
    if not ends_only:
        ordinal, numbered = _numbers(c, pairs, starters)
        lists = lists.unionByName(ordinal.selectExpr("lang", "'o' kind", "b a", "'' b", "1.0D p")).unionByName(numbered.selectExpr("lang", "'n' kind", "a", "'' b", "1.0D p"))
        lists = lists.unionByName(_collocations(pairs, flagged, starters).selectExpr("lang", "'c' kind", "a", "b", "1.0D p"))
    out = Model()
    for lang, kind, a, b, p in lists.collect():
        m = out.setdefault(lang, {"starters": set(), "ends": {}, "ordinal": set(), "numbered": set(), "pairs": set()})
        if kind == "e":
            m["ends"][a] = p
        elif kind == "c":
            m["pairs"].add((a, b))
        else:
            m[{"s": "starters", "o": "ordinal", "n": "numbered"}[kind]].add(a)
    c.unpersist()
    starters.unpersist()
    flagged.unpersist()
    return out


# --- splitting ----------------------------------------------------------------------------


def _pairs(events: list[tuple[int, str]]) -> dict[int, int]:
    """Positions of matched quotation marks and brackets, opener -> closer."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for pos, ch in events:
        if ch == '"':
            if any(c == '"' for c, _ in stack):
                while stack[-1][0] != '"':
                    stack.pop()
                out[stack.pop()[1]] = pos
            else:
                stack.append(('"', pos))
            continue
        for j in range(len(stack) - 1, -1, -1):
            if stack[j][0] == ch:
                out[stack[j][1]] = pos
                del stack[j:]
                break
        else:
            if ch in _CLOSE_OF:
                stack.append((_CLOSE_OF[ch], pos))
    return out


def _ends(s: str, lo: int, hi: int, lang: str, m: dict) -> list[int]:
    """Ends of the sentences of one paragraph ``s[lo:hi]``, its own end left out."""
    if lang == "th":
        return _thai(s, lo, hi)
    marks, terms = [], []
    for x in _EVENT.finditer(s, lo, hi):
        ch = x.group()
        (marks if ch[0] not in ".!?。！？।؟…‼⁇⁈⁉" else terms).append((x.start(), ch))
    if not terms:
        return []
    match = _pairs(marks)
    closers = {c: o for o, c in match.items()}
    spans = sorted(match.items())
    out: list[int] = []
    start = lo
    while start < hi and s[start].isspace():
        start += 1
    j, reach = 0, -1  # reach: end of the outermost matched span seen so far
    for pos, ch in terms:
        e = pos + len(ch)
        if e <= start:
            continue
        opener = None
        k = e
        while True:  # closing marks belong to the sentence
            q = k
            while q < hi and s[q] in "   " and q - k < 2:
                q += 1
            if q in closers:
                opener, k = closers[q], q + 1
            elif q < hi and s[q] in "”»」』）’)]" and q == k and q not in match:
                k = q + 1  # a closer whose opener is missing
            else:
                break
        while j < len(spans) and spans[j][0] < pos:
            reach = max(reach, spans[j][1]) if spans[j][1] >= k else reach
            j += 1
        if reach >= k or k >= hi:
            continue
        n = k
        while n < hi and s[n].isspace():
            n += 1
        if n >= hi:
            continue
        if _breaks(s, lo, hi, start, pos, ch, e, k, n, opener, lang, m):
            out.append(k)
            start = n
    return out


def _thai(s: str, lo: int, hi: int) -> list[int]:
    """In Thai a space separates sentences; between Latin words or before a digit or mark it does not."""
    out = []
    for x in re.finditer(r"\s+", s[lo:hi]):
        a, b = lo + x.start(), lo + x.end()
        if a > lo and b < hi and not (s[a - 1].isascii() and s[b].isascii()) and s[b] not in ")]”»,:;":
            out.append(a)
    return out


def _breaks(s, lo, hi, start, pos, ch, e, k, n, opener, lang, m) -> bool:
    """Whether the unit that began at ``start`` ends at ``k``, its mark ``ch`` being at ``pos``."""
    nxt = s[n]
    if nxt in ",;:،؛、，；：–-" and nxt != "-":
        return False
    if opener is not None:
        mark = s[opener]
        first = not any(c.isalnum() for c in s[start:opener])
        if mark in "(（[":
            return first
        before = s[lo:opener].rstrip()
        if before.endswith((":", "：")):
            return not (lang == "ja" and nxt in "とっ")
        if lang in _ATTRIBUTED:
            return False if lang == "ja" and nxt in "とっ" else (not first or nxt in _OPEN) and nxt not in "，、"
        return not nxt.islower()
    if ch[0] in "。！？।؟‼⁇⁈⁉":
        return True
    if ch[0] in "!?":
        return n > k or nxt.isupper() or nxt in _OPEN or not nxt.isalnum()
    word = _left(s, lo, pos)
    if len(ch) > 1 or ch == "…":
        return not nxt.islower() and n > k
    if n == k:  # no space follows
        if nxt.isdigit() or not word or word[-1].isdigit():
            return False
        if nxt.isupper() and n + 1 < hi and (s[n + 1].islower() or s[n + 1] in " .") or nxt in _OPEN - {"(", "["}:
            return len(word) > 2 and word[-1].islower() and "." not in word and m["ends"].get(word.lower(), 1.0) >= 0.4
        return False
    if not word:
        return False
    nt = _TOKEN.match(s, n)
    while nt is None and n < hi - 1 and s[n] in _OPEN:
        n += 1
        nt = _TOKEN.match(s, n)
    nw = nt.group().rstrip(".") if nt else ""
    if word[-1].isdigit() and _NUMBER.match(word):
        if pos - len(word) == start and len(word) <= 3:
            return False  # the number of a list item
        return nw not in m["ordinal"] and not nxt.islower() or nw in m["starters"]
    if len(word) == 1 and word.isupper():
        return False  # an initial
    if nxt.isdigit() and word.lower() in m["numbered"]:
        return False
    p = m["ends"].get(word.lower())
    if p is None:
        return True
    if nw in m["starters"]:
        return p >= 0.1
    if (word.lower(), nw) in m["pairs"]:
        return False
    return p >= 0.4 and not nxt.islower()


def _left(s: str, lo: int, pos: int) -> str:
    """The word that ends at ``pos``."""
    a = pos
    while a > lo and not s[a - 1].isspace() and s[a - 1] not in "([“„«\"（「,;:":
        a -= 1
    return s[a:pos]


def boundaries(text: str, lang: str | None, model: Model) -> list[int]:
    """Offsets just behind the last non-blank character of each sentence of ``text``."""
    lang = language(text, lang)
    m = model.of(lang)
    out: list[int] = []
    lo = 0
    for x in [*_BLANK.finditer(text), None]:
        hi = x.start() if x else len(text)
        z = hi
        while z > lo and text[z - 1].isspace():
            z -= 1
        if z > lo:
            out += [e for e in _ends(text, lo, z, lang, m) if e < z]
            out.append(z)
        lo = x.end() if x else hi
    return out


def split_sentences(df: DataFrame, model: Model) -> DataFrame:
    """(id, text, lang) -> (id, end_pos), one row per sentence and id.

    NULL or blank text has no sentence; an id delivered twice counts once; extra columns are ignored.
    """
    ship(df.sparkSession)
    schema = pa.schema([("id", pa.string()), ("ends", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            rows = [boundaries(t, g, model) if t else [] for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(rows, schema.field(1).type)], schema=schema)

    ends = spread(df.select("id", "text", "lang")).mapInArrow(run, "id string, ends array<bigint>")
    return ends.groupBy("id").agg(F.first("ends").alias("ends")).select("id", F.explode("ends").alias("end_pos"))
