"""Problem 4: noise in text from scanned pages.

Three learned parts. Line-pair classifiers (boosted trees over a line and its
neighbours) find page furniture and decide which line-end hyphens divide a word.
Words that no clean text of the corpus has are looked up in an inverted join of
character q-grams over confusion-folded spellings; boosted trees rank the candidates
and decide on a replacement. The models are trained here on pages synthesised from a
bounded sample of clean texts; all counts and the search cover the whole corpus.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.boost import Boosted
from loomgraph.plans.runtime import cut, ship, spread

#: Bounds of what the models are trained on: clean texts (of 200 to 3,000 characters) from which pages are made, words and
#: compounds from which errors are (three times as many are fetched, as look-alikes), and books. All counts and the search cover everything.
TRAIN_TEXTS, TRAIN_WORDS, TRAIN_BOOKS = 1200, 4000, 2000
#: A sound-looking word that no clean text has may itself be a correction if it is met this often in the scans, and has this share of their words.
TRUSTED, TRUSTED_SHARE = 3, 1e-6
#: A word with at least this share of all clean words is never looked up.
FREQUENT = 1e-5
Q, TAU = 3, 1

HYPHENS = "-‐­¬"
WORD = re.compile(r"[^\W_]+(?:[!@|$][^\W_]+)*")
_COMPOUND = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:-[^\W\d_]++)+")  # looked for at word starts only: long strings of letters stay linear
# Shapes that recognition confuses; each character's fold, so that confused spellings fold alike.
_FOLD = str.maketrans({"@": "a", "b": "h", "8": "h", "c": "e", "d": "ei", "f": "t", "q": "g", "9": "g", "l": "i", "1": "i", "!": "i", "|": "i", "m": "rri", "n": "ri", "u": "ii", "w": "vv", "0": "o", "5": "s", "$": "s", "í": "i", "ı": "i"})
# The confusions themselves, true shape to misread shape, for training errors.
CONFUSIONS = [("l", "1"), ("i", "!"), ("s", "5"), ("a", "@"), ("n", "ri"), ("u", "ii"), ("d", "cl"), ("t", "f"), ("h", "b"), ("e", "c"), ("g", "q"), ("m", "rn"), ("o", "0"), ("B", "8"), ("I", "l"), ("I", "|"), ("O", "0"), ("S", "5")]
_NUMERAL = str.maketrans("lIi|!OoSsBZqg", "1111100558299")
_PAGE = re.compile(
    r"^(?:(?P<dash>[—–\-·•*~]\s*N\s*[—–\-·•*~])|(?P<brack>[\[(]\s*N\s*[\])])|(?P<of>N\s*/\s*N)|(?P<word>(?:page|pag[e.]?|p\.|pp\.|seite|s\.|página|pág\.|pg\.)\s*N)|(?P<dot>N\.)|(?P<bare>N))$".replace("N", r"[\dlI|!OoSsBZqg]{1,5}"),
    re.I,
)
_STYLES = ("dash", "brack", "of", "word", "dot", "bare")
_CHAPTER = re.compile(r"^(\S{4,9})\s+\S{1,4}\s*[:.]")
_EDGE_NUMBER = re.compile(r"^\s*[\[(]?[\dlI|!OoSsBZ]{1,5}[\])]?(?:\s{2,}|\s*\|\s*)(?=\S)|(?:\s{2,}|\s*\|\s*)[\[(]?[\dlI|!OoSsBZ]{1,5}[\])]?\s*$")


def fold(s: str) -> str:
    """Confusion-folded lower-case spelling."""
    return s.lower().translate(_FOLD)


_MARKS = re.compile(r"[^\w@!|$]+|_")


def letters(s: str) -> str:
    """Folded letters of a line, without spaces, marks and digits that stand alone."""
    return fold(_MARKS.sub("", s))


def close(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most`` (banded)."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        if min(new[max(0, lo - 1) : hi + 1]) > most:
            return False
        row = new
    return row[len(b)] <= most


def bare(line: str) -> str:
    """A line without a page number set off at its edge."""
    return _EDGE_NUMBER.sub("", line.strip(), count=1)


# The word for a chapter in the four languages of the books, folded.
_CHAPTER_WORDS = {fold(w) for w in ("chapter", "chapitre", "kapitel", "capítulo")}


def is_chapter(line: str) -> bool:
    """A chapter line, its word perhaps misread."""
    m = _CHAPTER.match(bare(line))
    return bool(m) and fold(m.group(1)) in _CHAPTER_WORDS


def title_match(line: str, title: str, author: str) -> float:
    """How much the line, without a page number at its edge, is the beginning of the title, or author and title: 0 to 1."""
    s = bare(line)
    a = letters(s)
    if len(a) < 6:
        return 0.0
    best = 0.0
    for full in (title, author + title):
        b = full[: len(a)]
        if len(b) < 0.9 * len(a):
            continue
        if a == b or len(a) >= 8 and sum(map(str.__eq__, a[:6], b[:6])) >= 3 and close(a, b, max(1, len(a) // 10)):
            best = max(best, 0.5 + 0.5 * min(1.0, len(a) / max(len(full), 1)))
    return best


def page_value(s: str) -> tuple[int, int]:
    """(style, number) of a line that holds only a page number; style -1 if it does not."""
    m = _PAGE.match(s.strip())
    if not m:
        return -1, 0
    d = re.findall(r"[\dlI|!OoSsBZqg]{1,5}", re.sub(r"(?i)^(?:page|pag[e.]?|p\.|pp\.|seite|s\.|página|pág\.|pg\.)\s*", "", m.group().strip()))
    v = d[0].translate(_NUMERAL) if d else ""
    if not v.isdigit() or not any(c.isdigit() for c in (d[0] if d else "")) and m.lastgroup in ("bare", "dot") and len(v) < 2:
        return -1, 0
    return _STYLES.index(m.lastgroup), int(v)


_FINAL = re.compile(r"""[.!?:]["'”’»“)\]]*\s*$""")


def line_features(lines: list[str], k: int, tit: list[float], pages: int) -> list[float]:
    """Features of line ``k`` with its neighbours."""
    s = lines[k].strip()
    style, v = page_value(s)
    prev = next((x for x in range(k - 1, -1, -1) if lines[x].strip()), None)
    nxt = next((x for x in range(k + 1, len(lines)) if lines[x].strip()), None)
    gap_b, gap_a = k > 0 and not lines[k - 1].strip(), k + 1 < len(lines) and not lines[k + 1].strip()
    near = max([tit[x] for x in (k - 1, k + 1) if 0 <= x < len(lines)] + [0.0])
    pn = any(0 <= x < len(lines) and page_value(lines[x])[0] >= 0 for x in (k - 1, k + 1))
    chapter = is_chapter(s)
    n = len(s.split())
    return [
        tit[k], float(chapter), float(style), float(v), float(style >= 0 and 0 < v <= max(pages, 1)), float(style >= 0 and 1500 <= v <= 2100),
        float(gap_b), float(gap_a), float(prev is None), float(nxt is None), near, float(pn),
        float(prev is not None and not _FINAL.search(lines[prev])), float(nxt is not None and lines[nxt].lstrip()[:1].islower()),
        float(n), float(bool(_FINAL.search(s))), float(s.isupper()), float(bool(re.search(r"\d", s))),
    ]


def candidate(s: str, t: float) -> bool:
    """A line that may be furniture; all others are running text."""
    return bool(s) and (t > 0 or page_value(s)[0] >= 0 or is_chapter(s))


@dataclass
class Models:
    furniture: Boosted
    hyphen: Boosted
    word: Boosted
    frequent: frozenset = field(default_factory=frozenset)


# --- reading a scanned text -----------------------------------------------------------------


def page_candidates(text: str, title: str | None, author: str | None, pages: int | None) -> tuple[list[str], list[int], list[list[float]]]:
    """(lines, numbers of the lines that may be furniture, their features)."""
    lines = text.split("\n")
    t, a = letters(title or ""), letters(author or "")
    tit = [title_match(x, t, a) if t and x.strip() else 0.0 for x in lines]
    at = [k for k, x in enumerate(lines) if candidate(x.strip(), tit[k])]
    return lines, at, [line_features(lines, k, tit, pages or 0) for k in at]


def line_kinds(lines: list[str], at: list[int], p: np.ndarray) -> list[str]:
    """The kind of each line: '' blank, 'text', 'header' or 'page_number'."""
    kinds = ["text" if x.strip() else "" for x in lines]
    for k, q in zip(at, p):
        if q >= 0.5:
            kinds[k] = "page_number" if page_value(lines[k])[0] >= 0 else "header"
    return kinds


def read_pages(rows: list[tuple], model: Boosted) -> list[tuple[list[str], list[str]]]:
    """(lines, kinds) of each (text, title, author, pages); the lines of all are classified at once."""
    got = [page_candidates(*r) for r in rows]
    feats = [f for _, _, fs in got for f in fs]
    p = model.predict(np.array(feats)) if feats else np.empty(0)
    out, i = [], 0
    for lines, at, fs in got:
        out.append((lines, line_kinds(lines, at, p[i : i + len(fs)])))
        i += len(fs)
    return out


def split_word(a: str, b: str) -> tuple[str, str, str] | None:
    """(left, mark, right) if line ``a`` ends inside a word with a hyphen that ``b`` may continue."""
    s = a.rstrip()
    if len(s) < 2 or s[-1] not in HYPHENS or not s[-2].isalnum():
        return None
    left = re.search(r"[^\W_]+(?:[!@|$-][^\W_]+)*$", s[:-1])
    right = re.match(r"\s*([^\W_]+(?:[!@|$][^\W_]+)*)", b)
    return (left.group(), s[-1], right.group(1)) if left and right else None


def joins(lines: list[str], kinds: list[str]) -> list[tuple[int, int, str, str, str]]:
    """(line, next text line, left, mark, right) of every line-end hyphen within a word."""
    text = [k for k, x in enumerate(kinds) if x == "text"]
    out = []
    for k, n in zip(text, text[1:]):
        w = split_word(lines[k], lines[n])
        if w:
            out.append((k, n, *w))
    return out


def hyphen_features(left: str, mark: str, right: str, joined: float, hyphened: float) -> list[float]:
    last = left.rsplit("-", 1)[-1]
    return [float(np.log1p(joined)), float(np.log1p(hyphened)), float(right[:1].isupper()), float(mark == "-"), float(len(last)), float(len(right)), float("-" in left)]


# --- training ---------------------------------------------------------------------------------


def corrupt(w: str, rnd: random.Random) -> str | None:
    """The word with one or two shapes misread."""
    for _ in range(1 if rnd.random() < 0.8 else 2):
        have = [(x, y) for x, y in CONFUSIONS if x in w]
        if not have:
            return None
        x, y = rnd.choice(have)
        at = [i for i in range(len(w)) if w.startswith(x, i)]
        i = rnd.choice(at)
        w = w[:i] + y + w[i + len(x) :]
    return w


def synthetic_page(text: str, title: str, author: str, pages: int, rnd: random.Random) -> tuple[list[str], list[int]]:
    """Lines of a made-up scanned page and whether each is furniture."""
    lines, mark = [], []
    width = rnd.randint(45, 75)
    for par in text.split("\n\n"):
        cur = ""
        for w in par.split():
            if cur and len(cur) + len(w) + 1 > width:
                lines.append(cur)
                mark.append(0)
                cur = ""
            cur = f"{cur} {w}" if cur else w
        lines += [cur, ""]
        mark += [0, 0]
        if rnd.random() < 0.15:  # short paragraphs that are no furniture
            lines += [rnd.choice([str(rnd.randint(1900, 2024)), f"{rnd.randint(1, 90)} mg", f"Table {rnd.randint(1, 9)}", f"{rnd.randint(1, 30)}.{rnd.randint(1, 9)}", f"No. {rnd.randint(1, 9)}", "II.", "Grade II"]), ""]
            mark += [0, 0]
    n, style = rnd.randint(1, max(pages - 2, 1)), rnd.randrange(9)
    number = lambda v: [f"— {v} —", f"- {v} -", f"· {v} ·", f"[{v}]", f"{v}/{pages}", f"Page {v}", f"p. {v}", f"{v}.", str(v)][style]
    how = rnd.randrange(6)
    head = [title, title.upper(), " ".join(title.split()[:3]), f"{author} · {' '.join(title.split()[:3])}", f"Chapter {rnd.randint(1, 28)}: {' '.join(text.split()[:3])}", "   ".join(" ".join(w) for w in title.upper().split()[:3])][how]
    for _ in range(rnd.randint(1, 2)):
        at = rnd.choice([0, len(lines), rnd.randint(0, len(lines))])
        new = [head, number(n)] if rnd.random() < 0.6 else [number(n)] if rnd.random() < 0.5 else [f"{head}   {n}"] if rnd.random() < 0.5 else [head]
        if rnd.random() < 0.5:
            new = [corrupt(x, rnd) or x if rnd.random() < 0.3 else x for x in new]
        if rnd.random() < 0.5:
            new.reverse()
        pad = [""] if rnd.random() < 0.5 else []
        lines[at:at] = pad + new + pad
        mark[at:at] = [0] * len(pad) + [1] * len(new) + [0] * len(pad)
        n += 1
    return lines, mark


def train(texts: list[str], books: list[tuple[str, str, int]], counts: dict[str, int], compounds: dict[str, int], seed: int = 5) -> Models:
    """Fit the three models on pages and errors made from clean texts and words."""
    rnd = random.Random(seed)
    xs, ys = [], []
    books = [b for b in books if b[0]] or [("Handbook of the Unknown", "ed. A. Nobody", 300)]
    for text in texts:
        title, author, pages = rnd.choice(books)
        lines, mark = synthetic_page(text, title, author or "", pages or 300, rnd)
        t, a = letters(title), letters(author or "")
        tit = [title_match(x, t, a) if x.strip() else 0.0 for x in lines]
        for k, x in enumerate(lines):
            if candidate(x.strip(), tit[k]):
                xs.append(line_features(lines, k, tit, pages or 300))
                ys.append(mark[k])
    furniture = Boosted().fit(np.array(xs or [[0.0] * 18] * 12), np.array(ys or [0, 1] * 6))
    # hyphens: words divided anywhere, and compounds divided at their own hyphen
    xs, ys = [], []
    long = [w for w in counts if len(w) >= 6 and w.isalpha()][:TRAIN_WORDS]
    for w in long:
        i = rnd.randint(2, len(w) - 2)
        unseen = rnd.random() < 0.2
        xs.append(hyphen_features(w[:i], rnd.choice(HYPHENS), w[i:], 0 if unseen else counts[w], 0))
        ys.append(1)
    for c in list(compounds)[:TRAIN_WORDS]:
        i = rnd.choice([k for k, ch in enumerate(c) if ch == "-"])
        unseen = rnd.random() < 0.1
        xs.append(hyphen_features(c[:i], "-", c[i + 1 :], 0, 0 if unseen else compounds[c]))
        ys.append(0)
    hyphen = Boosted().fit(np.array(xs or [[0.0] * 7] * 12), np.array(ys or [0, 1] * 6))
    # words: errors against their source, and sound words against their look-alikes
    by: dict[str, list[str]] = {}
    for w in counts:
        by.setdefault(fold(w), []).append(w)
    xs, ys = [], []
    words_ = [w for w in counts if len(w) >= 3 and w.isalpha()][:TRAIN_WORDS]
    for w in words_:
        e = corrupt(w, rnd)
        if e and e not in counts:
            xs.append(word_features(e, 1, w, counts[w]))
            ys.append(1)
        for v in by[fold(w)]:
            if v != w and v.lower() != w.lower():
                xs.append(word_features(w, 1, v, counts[v]))
                ys.append(0)
        v = w[: rnd.randrange(len(w))] + rnd.choice("aeioukvz") + w[rnd.randrange(len(w)) :]  # an unseen sound word near a seen one
        if v not in counts and abs(len(v) - len(w)) <= 1:
            xs.append(word_features(v, 1, w, counts[w]))
            ys.append(0)
    word = Boosted().fit(np.array(xs or [[0.0] * 9] * 12), np.array(ys or [0, 1] * 6))
    return Models(furniture, hyphen, word)


def word_features(w: str, n: int, v: str, m: int) -> list[float]:
    """Features of replacing ``w`` (seen ``n`` times in scans) by ``v`` (``m`` times in clean text)."""
    a, b = fold(w), fold(v)
    same = a == b
    odd = sum(c in "!@|$" or c.isdigit() for c in w) if any(c.isalpha() for c in w) else 0
    return [float(same), float(odd), float(np.log1p(n)), float(np.log1p(m)), float(len(w)), float(len(v) - len(w)), float(w[:1].isupper() == v[:1].isupper()), float(w.lower() == v.lower()), float(sum(x != y for x, y in zip(w, v)))]


# --- the operator -------------------------------------------------------------------------------


def vocabulary(clean: DataFrame) -> DataFrame:
    """(word, n, compound) of all clean texts; compounds are counted besides their parts."""

    def run(batches):
        words, comp = Counter(), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    words.update(WORD.findall(t))
                    if "-" in t:
                        comp.update(_COMPOUND.findall(t))
        rows = [(w, n, False) for w, n in words.items()] + [(w, n, True) for w, n in comp.items()]
        for i in range(0, len(rows), 50_000):
            w, n, c = zip(*rows[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n, pa.int64()), pa.array(c)], names=["word", "n", "compound"])

    return spread(clean.select("text")).mapInArrow(run, "word string, n bigint, compound boolean").groupBy("word", "compound").agg(F.sum("n").alias("n"))


def learn(clean: DataFrame, books: DataFrame, vocab: DataFrame) -> Models:
    """Train on a bounded sample of clean texts and words (by hash order); the frequent words are at most 1 / FREQUENT."""
    h = F.xxhash64("text")
    texts = [r.text for r in clean.where("length(text) between 200 and 3000").select("text").orderBy(h).limit(TRAIN_TEXTS).collect()]
    some = vocab.where("n >= 2 and length(word) <= 40").orderBy(F.xxhash64("word"))
    words = {r.word: r.n for r in some.where("not compound").limit(3 * TRAIN_WORDS).collect()}
    compounds = {r.word: r.n for r in some.where("compound").limit(TRAIN_WORDS).collect()}
    shelf = [(r.title or "", r.author_line or "", r.n_pages or 0) for r in books.select("title", "author_line", "n_pages").orderBy(F.xxhash64("title")).limit(TRAIN_BOOKS).collect()]
    m = train(texts, shelf, words, compounds)
    total = vocab.where("not compound").agg(F.sum("n")).first()[0] or 0
    m.frequent = frozenset(r.word for r in vocab.where("not compound").where(F.col("n") >= max(total * FREQUENT, 3)).select("word").collect())
    return m


_FOUND = pa.schema([("id", pa.string()), ("line_no", pa.int64()), ("what", pa.string()), ("a", pa.string()), ("b", pa.string()), ("x", pa.string()), ("line2", pa.int64())])
_FOUND_DDL = "id string, line_no bigint, what string, a string, b string, x string, line2 bigint"


def read_scans(scans: DataFrame, books: DataFrame, models: Models) -> DataFrame:
    """Rows of what one reading of the scanned texts finds: furniture lines, line-end hyphens, words to look up."""
    ship(scans.sparkSession)
    shelf = books.select("book_id", "title", "author_line", F.col("n_pages").cast("bigint").alias("n_pages")).dropDuplicates(["book_id"])
    rows = scans.select("id", "book_id", "text").join(shelf, "book_id", "left").select("id", "text", "title", "author_line", "n_pages")

    def run(batches):
        for b in batches:
            out = []
            rows_ = [r for r in zip(*(c.to_pylist() for c in b.columns)) if r[1] and r[0] is not None]
            for (i, *_), (lines, kinds) in zip(rows_, read_pages([r[1:] for r in rows_], models.furniture)):
                out += [(i, k, x, None, None, None, None) for k, x in enumerate(kinds) if x in ("header", "page_number")]
                cut_left, cut_right = {}, {}
                for k, n, left, mark, right in joins(lines, kinds):
                    out.append((i, k, "join", left, right, mark, n))
                    cut_left[k], cut_right[n] = left, right
                for k, x in enumerate(kinds):
                    if x != "text":
                        continue
                    s = lines[k]
                    if k in cut_left:
                        s = s.rstrip()[:-1]
                        s = s[: len(s) - len(cut_left[k])]
                    if k in cut_right:
                        s = s.lstrip()[len(cut_right[k]) :]
                    out += [(i, k, "word", w, None, None, None) for w in set(WORD.findall(s)) if w not in models.frequent and not w.isdigit() and not (len(w) < 4 and w.isupper()) and not (len(w) < 3 and w.isalpha())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)] if out else [pa.array([], f.type) for f in _FOUND], schema=_FOUND)

    return spread(rows).mapInArrow(run, _FOUND_DDL)


def judge_joins(found: DataFrame, vocab: DataFrame, models: Models) -> DataFrame:
    """(id, line_no, line2, a, b, divided): whether the hyphen at the line's end divides a word."""
    one = vocab.where("not compound").select(F.col("word").alias("j"), F.col("n").alias("nj"))
    two = vocab.where("compound").select(F.col("word").alias("c"), F.col("n").alias("nc"))
    j = found.where("what = 'join'").withColumn("j", F.concat(F.substring_index("a", "-", -1), "b")).withColumn("c", F.concat("a", F.lit("-"), "b"))
    j = j.join(one, "j", "left").join(two, "c", "left").select("id", "line_no", "line2", "a", "b", "x", F.coalesce("nj", F.lit(0)).alias("nj"), F.coalesce("nc", F.lit(0)).alias("nc"))
    schema = pa.schema([("id", pa.string()), ("line_no", pa.int64()), ("line2", pa.int64()), ("a", pa.string()), ("b", pa.string()), ("divided", pa.bool_())])

    def run(batches):
        for b in batches:
            c = [x.to_pylist() for x in b.columns]
            p = models.hyphen.predict(np.array([hyphen_features(*r) for r in zip(c[3], c[5], c[4], c[6], c[7])]).reshape(-1, 7)) >= 0.5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), pa.array(p)], schema=schema)

    return j.mapInArrow(run, "id string, line_no bigint, line2 bigint, a string, b string, divided boolean")


#: Characters that no sound word has within it.
_ODD = r"\p{L}[!@|$]\p{L}|^[!@|$]\p{L}|\p{Ll}{2}[015]|[015]\p{Ll}{2}|\p{Ll}[015]\p{Ll}|\d[OolIS]\d|^[lI|]\d{2,}$|^\d{2,}[OolI]$"


def _grams(s: str) -> list[str]:
    s = f"\x02{s}\x03"
    return [s[i : i + Q] for i in range(max(1, len(s) - Q + 1))]


def _gram_rows(kind: str, weight: dict[str, int], probe: bool):
    """Prefix filter: two folded spellings within TAU edits share one of their first Q * TAU + 1 grams in any one order (here rarest first).

    A common gram is keyed with the length of the spelling, and the probing side asks
    for all lengths within TAU: no pair is lost, and no key holds all words of a gram.
    Spellings too short for the filter are keyed by themselves and without each letter.
    """
    short = Q * TAU + 1
    schema = pa.schema([("gram", pa.string()), (kind, pa.string()), (f"f_{kind}", pa.string()), (f"n_{kind}", pa.int64())])

    def run(batches):
        for b in batches:
            out = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = fold(w)
                g = sorted(set(_grams(f)), key=lambda x: (weight.get(x, 0), x))[: Q * TAU + 1]
                for x in g:
                    if x in weight:
                        out += [(f"{x}{k}", w, f, n) for k in (range(len(f) - TAU, len(f) + TAU + 1) if probe else (len(f),))]
                    else:
                        out.append((x, w, f, n))
                if len(f) <= short:
                    out += [(f"\x04{x}", w, f, n) for x in {f, *(f[:k] + f[k + 1 :] for k in range(len(f)))}]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)] if out else [pa.array([], t.type) for t in schema], schema=schema)

    return run, f"gram string, {kind} string, f_{kind} string, n_{kind} bigint"


def correct_words(words: DataFrame, vocab: DataFrame, models: Models) -> DataFrame:
    """(word) -> (word, fix) of the words judged misrecognised; ``fix`` is the best candidate, NULL where none explains the odd characters."""
    clean = vocab.where("not compound").select("word", "n")
    types = cut(words.groupBy("word").agg(F.count("*").alias("n")))
    often = max(TRUSTED, (types.agg(F.sum("n")).first()[0] or 0) * TRUSTED_SHARE)
    lower = clean.select(F.lower("word").alias("lw")).distinct()
    unseen = cut(types.join(clean.select("word"), "word", "left_anti").withColumn("lw", F.lower("word")).join(lower, "lw", "left_anti").select("word", "n"))
    is_odd = F.col("word").rlike(_ODD)
    trusted = clean.where("n >= 2 and length(word) >= 2").unionByName(unseen.where(F.col("n") >= often).where(~is_odd))
    good = clean.select(F.col("word").alias("v"), F.lit(True).alias("clean"))

    def count_grams(batches):
        c: Counter = Counter()
        for b in batches:
            for w in b.column(0).to_pylist():
                c.update(set(_grams(fold(w))))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["gram", "n"])

    # an order by rarity needs the common grams only: at most 1 / 0.0005 * grams of a word have such a share
    grams = trusted.select("word").mapInArrow(count_grams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).persist()
    top = (grams.agg(F.sum("n")).first()[0] or 0) * 0.0002
    weight = {r.gram: r.n for r in grams.where(F.col("n") >= top).collect()}
    run_w, ddl_w = _gram_rows("w", weight, True)
    run_v, ddl_v = _gram_rows("v", weight, False)
    left = unseen.select("word", "n").mapInArrow(run_w, ddl_w)
    right = trusted.mapInArrow(run_v, ddl_v)
    pairs = left.join(right, "gram").where("w <> v and abs(length(f_w) - length(f_v)) <= 1").where(F.levenshtein("f_w", "f_v", TAU) >= 0).select("w", "n_w", "v", "n_v").distinct()
    schema = pa.schema([("w", pa.string()), ("v", pa.string()), ("p", pa.float64())])

    def rank(batches):
        for b in batches:
            c = [x.to_pylist() for x in b.columns]
            keep = [k for k in range(len(c[0])) if c[0][k].lower() != c[2][k].lower() and (c[3][k] > c[1][k])]
            x = np.array([word_features(c[0][k], c[1][k], c[2][k], c[3][k]) for k in keep]).reshape(-1, 9)
            p = models.word.predict(x)
            yield pa.RecordBatch.from_arrays([pa.array([c[0][k] for k in keep], pa.string()), pa.array([c[2][k] for k in keep], pa.string()), pa.array(p)], schema=schema)

    ranked = pairs.select("w", "n_w", "v", "n_v").mapInArrow(rank, "w string, v string, p double").where("p >= 0.5")
    ranked = ranked.join(good, "v", "left").withColumn("clean", F.coalesce("clean", F.lit(False)))
    best = ranked.groupBy(F.col("w").alias("word")).agg(F.max_by("v", F.struct("clean", "p", "v")).alias("fix"))
    odd = unseen.where(is_odd).select("word")
    return best.join(odd, "word", "full_outer")


def _fragments(joined: DataFrame) -> DataFrame:
    """Words put together across a line end, with both lines."""
    return joined.select("id", "line_no", "line2", F.col("a").alias("left"), F.when(F.col("divided"), F.concat(F.substring_index("a", "-", -1), "b")).alias("word"), "b")


def analyse(chunks: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(furniture, joins, misread words): rows per line of the scanned chunks, and the corrections."""
    scans = chunks.where("origin = 'scan'").select("id", "book_id", "text").where("id is not null").dropDuplicates(["id"])
    clean = chunks.where("origin is null or origin <> 'scan'").select("text")
    ship(chunks.sparkSession)
    vocab = cut(vocabulary(clean))  # what several steps read is written once: their plans stay short
    models = learn(clean, books, vocab)
    found = cut(read_scans(scans, books, models))
    joined = cut(judge_joins(found, vocab, models))
    parts = _fragments(joined)
    # both lines of a divided word are candidates; the one whose own part differs from the correction is misread
    whole = parts.where("word is not null").select("id", "line_no", "word", F.length(F.substring_index("left", "-", -1)).alias("cut"), "line2")
    ends = parts.where("word is null").select("id", "line_no", "line2", F.substring_index("left", "-", -1).alias("a"), "b")
    words = found.where("what = 'word'").select("id", "line_no", F.col("a").alias("word"))
    words = words.unionByName(ends.select("id", "line_no", F.col("a").alias("word"))).unionByName(ends.select("id", F.col("line2").alias("line_no"), F.col("b").alias("word")))
    frequent = models.frequent
    fixes = cut(correct_words(words.select("word").unionByName(whole.select("word")), vocab, models))
    plain = words.join(fixes, "word").select("id", "line_no", "word", "fix")
    split = whole.join(fixes, "word").withColumn("here", F.substring("word", F.lit(1), F.col("cut")) != F.coalesce(F.substring("fix", F.lit(1), F.col("cut")), F.lit("")))
    split = split.select("id", F.when(F.col("here"), F.col("line_no")).otherwise(F.col("line2")).alias("line_no"), "word", "fix")
    return found.where("what in ('header', 'page_number')").select("id", "line_no", F.col("what").alias("kind")), joined, plain.unionByName(split)


def noisy_lines(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """(id, line_no, kind) of the scanned chunks: header, page_number, hyphen and ocr lines.

    NULL and blank texts have none; a chunk whose book is unknown has no title to
    compare with; an id delivered twice counts once.
    """
    furniture, joined, misread = analyse(chunks, books)
    hyphen = joined.where("divided").select("id", "line_no", F.lit("hyphen").alias("kind"))
    return furniture.unionByName(hyphen).unionByName(misread.select("id", "line_no", F.lit("ocr").alias("kind"))).distinct()


def repaired(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """(id, text): the scanned chunks as continuous paragraphs, free of furniture, line-end hyphens and misread words."""
    furniture, joined, misread = analyse(chunks, books)
    drop = furniture.groupBy("id").agg(F.collect_set("line_no").alias("drop"))
    glue = joined.where("divided").groupBy("id").agg(F.collect_set("line_no").alias("glue"))
    fix = misread.where("fix is not null").groupBy("id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "fix")))).alias("fix"))
    texts = chunks.where("origin = 'scan' and id is not null").select("id", "text").dropDuplicates(["id"])
    rows = texts.join(drop, "id", "left").join(glue, "id", "left").join(fix, "id", "left")
    schema = pa.schema([("id", pa.string()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            out = [rebuild(t, set(d or ()), set(g or ()), dict(f or ())) for t, d, g, f in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], schema=schema)

    return rows.select("id", "text", "drop", "glue", "fix").mapInArrow(run, "id string, text string")


def rebuild(text: str | None, drop: set[int], glue: set[int], fix: dict[str, str]) -> str | None:
    """One text repaired: a paragraph that furniture interrupts is closed up again."""
    if text is None:
        return None
    out: list[str] = []
    gap = cut = joined = False
    for k, line in enumerate(text.split("\n")):
        s = line.strip()
        if k in drop:
            cut = True
            continue
        if not s:
            gap = True
            continue
        if out and gap and not (cut and (joined or not _FINAL.search(out[-1]))):
            out.append(s)
        elif out:
            out[-1] += s if joined else " " + s
        else:
            out.append(s)
        gap = cut = False
        joined = k in glue
        if joined:
            out[-1] = out[-1].rstrip()[:-1]
        elif s[-1] in HYPHENS and len(s) > 1 and s[-2].isalnum():
            joined = True  # a compound: its hyphen stays, without a space
    return "\n\n".join(WORD.sub(lambda m: fix.get(m.group(), m.group()), p) for p in out)
