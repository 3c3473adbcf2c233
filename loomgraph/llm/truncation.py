"""Problem 10: texts that were cut off before their end.

Discrete length hazards per source (by window functions, in code points and in bytes)
are tested against the hazards of neighbouring lengths, with false-discovery control:
the significant lengths are field limits. Incomplete endings are flagged, at the limits
and, for transfers broken elsewhere, at any length. What a complete ending without a
final mark looks like (headings, titles, table rows, lists, records) is learned from
the places where such lines stand in mid-document. Away from the limits the shape of
such a line is enough; at a limit, where nearly all texts are cut, the line itself must
stand whole in some document, or be one word that ends a clause or line in some.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.runtime import ship, spread
from loomgraph.plans.skew import skew_join

#: Lengths to either side that count as neighbours, the false-discovery rate, the least expected count.
NEIGHBOURS, FDR, FLOOR = 40, 0.01, 0.25
#: A word kept in a line's skeleton makes up at least this share of all words.
FREQUENT = 1e-4
#: A line's skeleton is that of a complete line if it stands in mid-document this often, and has this share of all such lines.
KNOWN, KNOWN_SHARE = 3, 1e-6
#: A word is one, not a part of one, if it has this share of all words (once, in less than a billion words).
SEEN_SHARE = 1e-9
#: A title is one line of at most so many characters; a source of titles has at least so many texts.
TITLE, TITLES = 120, 20
#: Distinct entries that a counting task holds before it hands them on.
HELD = 400_000

_CLOSERS = " \t\n\r\f\v\u00a0\u3000\"'”’»“)]）」』›*_"
_APPENDED = ("…", "...", "[…]", "(…)", "[...]")
_CITED = re.compile(r"\[\d{1,4}\]\Z")
_SIGNED = re.compile(r"[^\S\n]*(?:—|–|--|/)[^\S\n]*\S[^\n]{0,60}\Z")
_WORD = re.compile(r"[A-Za-zÀ-ɏ0-9]+|[^\W_A-Za-zÀ-ɏ]+")
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[|:=•*/—–-]")
_BULLET = re.compile(r"\s*(?:[-*•]|\d{1,3}[.)])\s+\S")
_FIELD = re.compile(r"\s*[^\W\d_]+:\s+\S")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_ROW = re.compile(r"^[^|\t\n]+(?:[|\t][^|\t\n]+){2,}$")  # a table row: three fields at least
_ITEM = "\x01"  # marks the last word of a list item among the skeletons
_EXACT = "\x02"  # marks a line as written among the skeletons
_CLOSING = re.compile(r"([A-Za-zÀ-ɏ0-9]+|[^\W_A-Za-zÀ-ɏ]+)[^\S\n]*([\n.,;:!?)”»؟،]?)")  # a word, and what ends its clause or line, if anything
_MARK = re.compile(r"^(?:[-*•]|\d{1,3}[.)])\s+")
_THAI = re.compile("[฀-๿]")
_CJK = re.compile("[\u3040-\u30ff\u4e00-\u9fff]")
_CJK_MARK = re.compile("[。，、！？；：,.]")
_INITIAL = re.compile(r"(?:^|[\s(“„«\"])[A-ZÀ-Ý]\.$")
_PAIRED = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]"}
_STRUCTURE = re.compile(r"""["“”„«»「」『』()（）\[\]]""")


def source_key(c):
    """One spelling of a source: lower case, separators as underscores; blank is NULL."""
    k = F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "_")
    return F.when(F.length(k) > 0, k)


def final(t: str) -> bool:
    """Whether the text ends with a final mark, closing marks aside."""
    return t.rstrip(_CLOSERS)[-1:] in tuple(".!?。！？।؟")


def unappended(text: str) -> str:
    """The text without blanks and ellipses at its end; only the end is looked at."""
    t = text.rstrip()
    while t.endswith(_APPENDED):
        t = next(t[: -len(x)] for x in sorted(_APPENDED, key=len, reverse=True) if t.endswith(x)).rstrip()
    return t


def body(text: str) -> str:
    """The text without what was put behind it: blanks, an ellipsis, a citation mark, a signature line."""
    t = unappended(text)
    m = _CITED.search(t, max(0, len(t) - 6))
    if m:
        t = t[: m.start()].rstrip()
    k = t.rfind("\n")
    if k >= 0 and _SIGNED.match(t, k + 1):
        t = t[:k].rstrip()
    return t


def last_paragraph(t: str) -> str:
    """What follows the last blank line."""
    k = t.rfind("\n")
    while k >= 0:
        j = t.rfind("\n", 0, k)
        if j >= 0 and not t[j + 1 : k].strip():
            return t[k + 1 :].lstrip()
        k = j
    return t


def unclosed(par: str) -> bool:
    """Whether the last paragraph leaves a quotation mark or bracket open."""
    stack = []
    for ch in _STRUCTURE.findall(par):
        if stack and ch == stack[-1]:
            stack.pop()
        elif ch in _PAIRED:
            stack.append(_PAIRED[ch])
        elif ch == '"':
            stack.append('"')
    return bool(stack) and stack[-1] != "]"


def last_line(t: str) -> str:
    """The last unit of a text without final mark: its last line; in Thai its last space-delimited part."""
    line = t[t.rfind("\n") + 1 :].strip()
    if _THAI.search(line):
        return line.split()[-1]
    return line


def skeleton(line: str, frequent: frozenset) -> str:
    """The line with rare words and numbers masked and runs of masks joined."""
    if _THAI.search(line):
        return re.sub(r"\d[\d.,]*", "#", re.sub(r"[A-Za-zÀ-ɏ]+", "@", line))
    if _CJK.search(line):  # no spaces: the end of the line stands for it, apart from lines with marks inside
        return ("cjk? " if _CJK_MARK.search(line) else "cjk ") + line[-3:]
    out: list[str] = []
    for x in _TOKEN.findall(line):
        y = "#" if x[0].isdigit() else x.lower() if x.lower() in frequent or not x[0].isalnum() else "@"
        if y in "•*" or y in "-—–" and not out:
            y = "-"
        if y != "@" or out[-1:] != ["@"]:
            out.append(y)
    return " ".join(out)


def complete_lines(text: str) -> list[str]:
    """Lines in mid-document that are whole though without a final mark; of list items also the last word, marked."""
    out: list[str] = []
    items_end: list[str] = []
    paragraphs = _BLANK.split(text)
    for k, p in enumerate(paragraphs):
        lines = [x for x in p.split("\n") if x.strip()]
        last = k == len(paragraphs) - 1
        listed = len(lines) > 1 and all(_BULLET.match(x) or _FIELD.match(x) for x in lines)
        if listed:
            items = [x.strip() for x in (lines[:-1] if last else lines) if not final(x)]
            out += items
            items_end += [_ITEM + _WORD.findall(x)[-1].lower() for x in items if _BULLET.match(x) and _WORD.search(x)]
        elif _THAI.search(p):
            units = p.split()
            out += [u for u in (units[:-1] if last else units)]
        elif len(lines) == 1 and not last and not final(lines[0]):
            out.append(lines[0].strip())
    return out + items_end


def title_shaped(t: str, abbreviations: frozenset) -> bool:
    """Whether a body is one short line without a sentence end inside."""
    if not t or len(t) > TITLE or "\n" in t.strip():
        return False
    inner = re.findall(r"(\w+)(?:[.!?؟।]\s|[。！？])", t)
    return all(len(w) < 3 or w.lower() in abbreviations for w in inner)


def exact(line: str) -> str:
    """The line as written, marked: of a list item without its mark, of a table row the last field."""
    x = line.strip()
    return _EXACT + (re.split(r"[|\t]", x)[-1].strip() if _ROW.match(x) else _MARK.sub("", x)).lower()


def _evidence(text: str, frequent: frozenset) -> list[str]:
    """Skeletons of the complete lines, and the lines themselves, table rows included."""
    whole = complete_lines(text)
    lines = [x for x in whole if not x.startswith(_ITEM)]
    rows = [x for x in text.rstrip().split("\n")[:-1] if _ROW.match(x.strip())]
    return [x if x.startswith(_ITEM) else skeleton(x, frequent) for x in whole] + [exact(x) for x in lines + rows]


_DOC = pa.schema(
    [("doc_id", pa.int64()), ("src", pa.string()), ("n", pa.int64()), ("n_own", pa.int64()), ("b", pa.int64()), ("b_own", pa.int64())]
    + [("state", pa.string()), ("skel", pa.string()), ("word", pa.string()), ("line", pa.string()), ("title", pa.bool_())]
)
_DDL = "doc_id bigint, src string, n bigint, n_own bigint, b bigint, b_own bigint, state string, skel string, word string, line string, title boolean"


def _batches(counts: Counter, names: list[str]):
    items = list(counts.items())
    for i in range(0, len(items), 50_000):
        w, n = zip(*items[i : i + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64())], names=names)


def _vocabulary(batches):
    """(word, n, closing): how often a word stands in the texts, and whether it ends a clause or line; each text's last word left out."""
    words: Counter = Counter()
    closing: set = set()

    def held():
        items = list(words.items())
        for i in range(0, len(items), 50_000):
            w, n = zip(*items[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64()), pa.array([x in closing for x in w], pa.bool_())], names=["word", "n", "closing"])

    for b in batches:
        for t in b.column(0).to_pylist():
            if t:
                found = _CLOSING.findall(t)[:-1]
                words.update([w for w, _ in found])
                closing.update([w for w, end in found if end])
        if len(words) > HELD:
            yield from held()
            words.clear()
            closing.clear()
    yield from held()


def ending(t: str, frequent: frozenset, abbreviations: frozenset) -> tuple[str, str | None, str | None]:
    """(state, skeleton, last word) of a body: 'whole' or 'cut' where the marks tell, else 'open' with what decides it."""
    if not t:
        return "whole", None, None
    paragraph = last_paragraph(t)
    if final(t):
        w = t.rsplit(None, 1)[-1].strip("([“„«\"")
        if unclosed(paragraph):
            return "cut", None, None
        if _INITIAL.search(t[-8:]) or w.rstrip(".").lower() in abbreviations and w.endswith("."):
            return "cut", None, None
        return "whole", None, None
    if unclosed(paragraph):
        return "cut", None, None
    line = last_line(t)
    words = _WORD.findall(line)
    word = words[-1] if words and line.endswith(words[-1]) or words and not _THAI.search(line) else None
    if word and (_THAI.search(word) or _CJK.search(word)):
        word = None
    if _ROW.match(line):
        return "open", "|", word
    lines = [x for x in paragraph.split("\n") if x.strip()]
    if len(lines) > 1 and word and all(map(_BULLET.match, lines)):
        # a name may end an item without having been seen there; a common word may not
        return "open", _ITEM + word.lower() if word.lower() in frequent or len(words) > 1 and word[0].islower() else "|", word
    return "open", skeleton(line, frequent), word


def analyse(docs: DataFrame, abbreviations: frozenset = frozenset()) -> tuple[DataFrame, DataFrame]:
    """(documents with their ending's verdict, significant lengths).

    NULL and blank texts are whole; NULL sources are tested together; a doc_id counts once.
    """
    ship(docs.sparkSession)
    docs = spread(docs.select("doc_id", source_key(F.col("source")).alias("src"), "text"))
    vocabulary = docs.select("text").where("text is not null").mapInArrow(_vocabulary, "word string, n bigint, closing boolean").groupBy("word").agg(F.sum("n").alias("n"), F.max("closing").alias("closing")).persist()
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    # at most 1 / FREQUENT words can have this share, which bounds what is collected
    frequent = frozenset(r.w for r in vocabulary.groupBy(F.lower("word").alias("w")).agg(F.sum("n").alias("n")).where(F.col("n") >= max(total * FREQUENT, 3)).select("w").collect())

    def lines(batches):
        got: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    got.update(_evidence(t, frequent))
            if len(got) > HELD:
                yield from _batches(got, ["skel", "k"])
                got.clear()
        yield from _batches(got, ["skel", "k"])

    def look(batches):
        for b in batches:
            out = []
            for i, s, t in zip(*(c.to_pylist() for c in b.columns)):
                t = t or ""
                u = body(t)
                own = unappended(t)
                state, skel, word = ending(u, frequent, abbreviations)
                line = exact(last_line(u)) if state == "open" else None
                out.append((i, s, len(t), len(own), len(t.encode()), len(own.encode()), state, skel, word, line, title_shaped(u, abbreviations)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DOC)] if out else [pa.array([], f.type) for f in _DOC], schema=_DOC)

    shapes = docs.select("text").where("text is not null").mapInArrow(lines, "skel string, k bigint").groupBy("skel").agg(F.sum("k").alias("k")).persist()
    least = max(KNOWN, (shapes.where(~F.col("skel").startswith(_EXACT)).agg(F.sum("k")).first()[0] or 0) * KNOWN_SHARE)
    known = shapes.where((F.col("k") >= least) | F.col("skel").startswith(_EXACT))
    looked = docs.mapInArrow(look, _DDL).dropDuplicates(["doc_id"]).persist()
    limits = significant_lengths(looked)
    judged = looked.where("state <> 'open'").select("doc_id", "src", "n", "n_own", "b", "b_own", "state")
    # a source holds titles if nearly all its texts are short single lines without a mark and no limit holds half of them;
    # titles that recur make their length significant, so lesser ones tell nothing
    top = limits.groupBy(F.col("src").alias("lsrc")).agg(F.max("n").alias("most"))
    titles = looked.groupBy("src").agg(F.avg(((F.col("state") == "open") & F.col("title")).cast("double")).alias("p"), F.count("*").alias("texts")).where((F.col("p") >= 0.9) & (F.col("texts") >= TITLES))
    titles = titles.join(top, F.col("src").eqNullSafe(F.col("lsrc")), "left").where("coalesce(most, 0) * 2 < texts").select(F.col("src").alias("tsrc"), F.lit(True).alias("titled"))
    ends = looked.where("state = 'open'")
    open_ = at_limit(ends, limits)
    for key, right in (("skel", known), ("line", known.select(F.col("skel").alias("line"), F.lit(True).alias("proven"))), ("word", vocabulary.withColumnRenamed("n", "wn"))):
        open_ = skew_join(open_, right, [key], ends.groupBy(key).agg(F.count("*").alias("n")), "left")  # a shape such as one rare word is common
    open_ = open_.join(F.broadcast(titles), F.col("src").eqNullSafe(F.col("tsrc")), "left")  # one row per source
    seen = F.col("word").isNull() | (F.coalesce("wn", F.lit(0)) >= max(1, total * SEEN_SHARE))
    titled = F.coalesce("titled", F.lit(False)) & F.col("title")
    shaped = F.col("k").isNotNull() | (F.col("skel") == "|")
    whole = seen & (titled | shaped & (~F.col("limited") | F.coalesce("proven", F.lit(False)) | F.coalesce("closing", F.lit(False)) & ~F.col("line").rlike(r"\s")))
    judged = judged.unionByName(open_.select("doc_id", "src", "n", "n_own", "b", "b_own", F.when(whole, "whole").otherwise("cut").alias("state")))
    return judged, limits


def significant_lengths(looked: DataFrame) -> DataFrame:
    """(src, unit, len, n, expected, p): lengths whose hazard stands out from its neighbours'.

    hazard = texts of the length / texts at least as long; the expected number is the
    neighbours' hazard times the texts at risk; the bound of Chernoff on the Poisson
    tail gives p; Benjamini and Hochberg's procedure sets the threshold.
    """
    one = lambda unit, c: looked.select("src", F.lit(unit).alias("unit"), F.col(c).alias("len"))
    h = one("chars", "n_own").unionByName(one("bytes", "b_own")).groupBy("src", "unit", "len").agg(F.count("*").alias("n"))
    up = Window.partitionBy("src", "unit").orderBy(F.desc("len"))
    near = Window.partitionBy("src", "unit").orderBy("len").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    h = h.withColumn("risk", F.sum("n").over(up)).withColumn("hazard", F.col("n") / F.col("risk"))
    h = h.withColumn("expected", F.greatest((F.sum("hazard").over(near) - F.col("hazard")) / (2 * NEIGHBOURS) * F.col("risk"), F.lit(FLOOR)))
    h = h.withColumn("p", F.when(F.col("n") > F.col("expected"), F.exp(-(F.col("n") * F.log(F.col("n") / F.col("expected")) - F.col("n") + F.col("expected")))).otherwise(F.lit(1.0)))
    h = h.persist()
    m = max(h.count(), 1)
    small = h.where(F.col("p") <= FDR).select("p").persist()  # no other can pass
    # the procedure's threshold is the largest t with t = FDR * (number of p <= t) / m, reached from above by iteration: no sort of all lengths
    t, seen = FDR, -1
    while True:
        n = small.where(F.col("p") <= t).count()
        if n == seen:
            break
        t, seen = FDR * n / m, n
    small.unpersist()
    return h.where((F.col("p") <= t) & F.lit(seen > 0)).select("src", "unit", "len", "n", "expected", "p")


def at_limit(judged: DataFrame, limits: DataFrame) -> DataFrame:
    """Judged documents with ``limited``: whether the length is a significant one of the source (a byte limit may have dropped a broken last character)."""
    c = limits.where("unit = 'chars'").groupBy("src").agg(F.collect_set("len").alias("c"))
    b = limits.where("unit = 'bytes'").groupBy("src").agg(F.collect_set("len").alias("y"))
    j = judged.join(F.broadcast(c.withColumnRenamed("src", "s1")), F.col("src").eqNullSafe(F.col("s1")), "left").join(F.broadcast(b.withColumnRenamed("src", "s2")), F.col("src").eqNullSafe(F.col("s2")), "left")
    hit = F.array_contains("c", F.col("n_own")) | F.exists("y", lambda x: (F.col("b_own") <= x) & (F.col("b_own") > x - 4))
    return j.withColumn("limited", F.coalesce(hit, F.lit(False))).drop("c", "y", "s1", "s2")


def cut_documents(docs: DataFrame, abbreviations: frozenset = frozenset()) -> DataFrame:
    """(doc_id, src, limited) of the documents that were cut: incomplete endings at significant lengths, and elsewhere."""
    judged, limits = analyse(docs, abbreviations)
    return at_limit(judged, limits).where("state = 'cut'").select("doc_id", "src", "limited")


def truncation_rates(docs: DataFrame, abbreviations: frozenset = frozenset()) -> DataFrame:
    """(source, documents, cut, cut_at_limit, rate) per source."""
    judged, limits = analyse(docs, abbreviations)
    j, cut = at_limit(judged, limits), (F.col("state") == "cut").cast("bigint")
    return j.groupBy(F.col("src").alias("source")).agg(F.count("*").alias("documents"), F.sum(cut).alias("cut"), F.sum(cut * F.col("limited").cast("bigint")).alias("cut_at_limit"), F.avg(cut.cast("double")).alias("rate"))
