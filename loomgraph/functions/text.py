"""Text functions as column expressions: sentences, words, names, answers, parsers of model output."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32 ASCII punctuation marks that answer normalisation drops.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Patterns of the two parsers of model output.
ENTITY_PATTERN = r'"([a-zA-Z][^"]*[a-zA-Z])"'
TRIPLE_PATTERN = r"""['"]?Source['"]?\s*:\s*['"]?([^,'"}]+)['"]?\s*,\s*['"]?Relationship['"]?\s*:\s*['"]?([^,'"}]+)['"]?\s*,\s*['"]?Destination['"]?\s*:\s*['"]?([^,'"}]+)['"]?"""
# White space of a plain split, Unicode's included.
SPACE = r"[\s\x0B\x85\p{Z}]+"


def words(c: Column) -> Column:
    """White-space separated words; none for NULL."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Sentences by final mark and white space, trimmed."""
    trimmed = F.regexp_replace(c, rf"^{SPACE}|{SPACE}$", "")
    return F.filter(F.split(F.regexp_replace(trimmed, rf"([.!?]){SPACE}", "$1\x01"), "\x01"), lambda x: x != "")


def normalize_name(c: Column) -> Column:
    """Key of an entity name: lower case, space and hyphen as underscore."""
    return F.translate(F.lower(c), " -", "__")


def normalize_answer(c: Column) -> Column:
    """Lower case, without punctuation and articles, single spaces."""
    bare = F.translate(F.lower(c), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), SPACE, " "))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token sets whose union counts the token '.' once more."""
    union = F.array_union(F.array_union(a, b), F.array(F.lit(".")))
    return F.size(F.array_intersect(a, b)) / F.size(union)


def parse_entities(c: Column) -> Column:
    """Quoted strings that begin and end with a letter."""
    return F.regexp_extract_all(c, F.lit(ENTITY_PATTERN), F.lit(1))


def parse_relations(c: Column) -> Column:
    """Triples of the key-value layout; NULL where nothing matches."""
    part = lambda k: F.regexp_extract_all(c, F.lit(TRIPLE_PATTERN), F.lit(k))
    z = F.arrays_zip(part(1).alias("Source"), part(2).alias("Relationship"), part(3).alias("Destination"))
    return F.when(F.size(part(1)) > 0, z)


def hit_count(hay: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of lower-case ``needle`` in lower-case ``hay``; an empty needle is found length + 1 times."""
    h, n = F.lower(F.coalesce(hay, F.lit(""))), F.lower(F.coalesce(needle, F.lit("")))
    gone = F.length(h) - F.length(F.replace(h, n, F.lit("")))
    return F.when(n == "", F.length(h) + 1).otherwise((gone / F.greatest(F.length(n), F.lit(1))).cast("int"))


def answer_f1(pred: Column, gold: Column) -> Column:
    """struct(f1, precision, recall): common distinct tokens over the lengths of both token lists."""
    p, g = words(normalize_answer(pred)), words(normalize_answer(gold))
    same = F.size(F.array_intersect(p, g))
    prec, rec = same / F.size(p), same / F.size(g)
    zero = F.struct(F.lit(0.0).alias("f1"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))
    return F.when(same == 0, zero).otherwise(F.struct((2 * prec * rec / (prec + rec)).alias("f1"), prec.alias("precision"), rec.alias("recall")))


def chunk_fold(sents: Column, size: int = 400, overlap: int = 40, order: str = "natural") -> Column:
    """Chunks of a sentence array: sentences are packed up to ``size`` words; the tail of at least ``overlap`` words begins the next chunk.

    ``order='reference'`` reverses the words of the repeated tail within each sentence,
    'natural' keeps them. A sentence over the size is a chunk of its own.
    """
    n = lambda s: F.size(words(s))
    item = lambda w, t: F.struct(w.cast("int").alias("w"), t.alias("t"))
    join = lambda items: F.array_join(F.transform(items, lambda x: x["t"]), " ")
    total = lambda items: F.aggregate(items, F.lit(0), lambda a, x: a + x["w"])

    def tail(cur):
        start = F.struct(F.lit(0).alias("w"), F.array().cast("array<struct<w:int,t:string>>").alias("k"))
        pop = lambda a, x: F.when(a["w"] >= overlap, a).otherwise(F.struct((a["w"] + x["w"]).cast("int").alias("w"), F.array_append(a["k"], x).alias("k")))
        return F.aggregate(F.reverse(cur), start, pop)

    def step(a, s):
        full = (total(a["cur"]) + n(s) > size) & (F.size(a["cur"]) > 0)
        t = tail(a["cur"])
        if order == "reference":
            text = F.array_join(F.reverse(F.flatten(F.transform(t["k"], lambda x: words(x["t"])))), " ")
        else:
            text = join(F.reverse(t["k"]))
        kept = F.when(t["w"] > 0, F.array(item(t["w"], text))).otherwise(F.array().cast("array<struct<w:int,t:string>>"))
        out = F.when(full, F.array_append(a["out"], F.struct(total(a["cur"]).cast("int").alias("n_words"), join(a["cur"]).alias("text")))).otherwise(a["out"])
        cur = F.array_append(F.when(full, kept).otherwise(a["cur"]), item(n(s), s))
        return F.struct(cur.alias("cur"), out.alias("out"))

    init = F.struct(F.array().cast("array<struct<w:int,t:string>>").alias("cur"), F.array().cast("array<struct<n_words:int,text:string>>").alias("out"))
    end = lambda a: F.when(F.size(a["cur"]) > 0, F.array_append(a["out"], F.struct(total(a["cur"]).cast("int").alias("n_words"), join(a["cur"]).alias("text")))).otherwise(a["out"])
    return F.aggregate(sents, init, step, end)


_SPACES = re.compile("[\\s\x0b\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _words(s: str) -> list[str]:
    return [w for w in _SPACES.split(s) if w]


def chunk_list(sents: list[str], size: int = 400, overlap: int = 40, order: str = "natural") -> list[tuple[int, str]]:
    """The same fold over a Python list, for Arrow batches."""
    out: list[tuple[int, str]] = []
    cur: list[tuple[int, str]] = []
    n = 0
    for s in sents:
        w = len(_words(s))
        if cur and n + w > size:
            out.append((n, " ".join(t for _, t in cur)))
            tail: list[tuple[int, str]] = []
            kept = 0
            while cur and kept < overlap:
                x = cur.pop()
                tail.append(x)
                kept += x[0]
            text = " ".join(t for _, t in reversed(tail)) if order == "natural" else " ".join([v for _, t in tail for v in _words(t)][::-1])
            cur, n = ([(kept, text)] if kept else []), kept
        cur.append((w, s))
        n += w
    return [*out, (n, " ".join(t for _, t in cur))] if cur else out
