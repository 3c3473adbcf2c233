"""From documents to chunks and their offline enrichment."""

from __future__ import annotations

import re
import time

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import chunk_list, sentences, words
from loomgraph.plans.runtime import ship, spread


def sentence_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent_no, sentence, n_words)."""
    s = spread(docs.select(key, text)).select(key, F.posexplode(sentences(F.col(text))).alias("sent_no", "sentence"))
    return s.withColumn("n_words", F.size(words(F.col("sentence"))))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) over all texts."""
    return docs.select(F.explode(words(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_SPACE = "[\\s\x0b\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_EDGE = re.compile(f"^{_SPACE}|{_SPACE}$")
_BREAK = re.compile(f"(?<=[.!?]){_SPACE}")


def chunk_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 400, overlap: int = 40, order: str = "natural") -> DataFrame:
    """(chunk_id, key, chunk_no, n_words, text): the fold of ``chunk_list`` in Arrow batches; NULL and blank texts have no chunk."""
    ship(docs.sparkSession)
    kind = dict(docs.select(key).dtypes)[key]

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = [x for x in _BREAK.split(_EDGE.sub("", t))] if t else []
                out += [(k, n, w, c) for n, (w, c) in enumerate(chunk_list([p for p in parts if p], size, overlap, order))]
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=[key, "chunk_no", "n_words", "text"])

    c = spread(docs.select(key, text)).mapInArrow(run, f"{key} {kind}, chunk_no bigint, n_words bigint, text string")
    return c.select(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("chunk_no").cast("string"))).alias("chunk_id"), key, "chunk_no", "n_words", "text")


class OfflineModel:
    """Deterministic stand-in for the text model; replace it with a client of the same methods.

    ``entities``: capitalised phrases, at most 12; ``relations``: neighbouring entities of
    a sentence with the words between them; ``summary``: the first 50 words.
    """

    name = re.compile(r"\b[A-ZÀ-Ý][\w’-]*(?:\s+[A-ZÀ-Ý][\w’-]*)*")

    def entities(self, text: str) -> list[str]:
        found = [m.group() for s in re.split(r"(?<=[.!?])\s+", text) for m in self.name.finditer(s) if m.start() > 0]
        return list(dict.fromkeys(found))[:12]

    def relations(self, text: str, entities: list[str]) -> list[tuple[str, str, str]]:
        out = []
        for s in re.split(r"(?<=[.!?])\s+", text):
            at = sorted((s.find(e), e) for e in entities if e in s)
            for (i, a), (j, b) in zip(at, at[1:]):
                mid = s[i + len(a) : j].strip(" ,;")
                if mid and len(mid.split()) <= 8:
                    out.append((a, mid, b))
        return out[:12]

    def summary(self, text: str) -> str:
        return " ".join(text.split()[:50])

    def attributes(self, entity: str, text: str) -> str:
        """What the sentences that name the entity say, in 50 words at most."""
        said = [s for s in re.split(r"(?<=[.!?])\s+", text) if entity and entity in s]
        return " ".join(" ".join(said).split()[:50])

    def reasoning(self, prompt: str) -> str:
        """The context of a reasoning prompt, as its own chain of reasons."""
        return " ".join(prompt.partition("\n\nContext:\n")[2].rpartition("\n\n")[0].split("\n"))

    def answer(self, prompt: str) -> str:
        """The evidence line that shares most words with the question, the first at a tie."""
        evidence, _, asked = prompt.partition("\n\nQuestion: ")
        want = set(re.findall(r"\w+", asked.lower().removesuffix("answer:")))
        lines = [x.partition("] ")[2] for x in evidence.split("\n") if x.startswith("[") and not x.startswith("[EDGE")]
        return max(lines, key=lambda x: len(want & set(re.findall(r"\w+", x.lower()))), default="")


def call(method, *args, tries: int = 3, wait: float = 0.0):
    """One call of a model: tried again after ``wait`` seconds, doubled each time, on any error; None when all ``tries`` failed."""
    for k in range(tries):
        try:
            return method(*args)
        except Exception:  # a client may raise anything; a failed row is retried by a later round
            if k + 1 < tries and wait:
                time.sleep(wait * 2**k)
    return None


def ask_model(df: DataFrame, model: type, method: str, args: list[str], out: str, tries: int = 3) -> DataFrame:
    """``df`` with the text that ``method`` of the model gives for the columns ``args``; NULL where an argument is or all tries failed."""
    ship(df.sparkSession)
    keep = df.drop(out)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields) + f", `{out}` string"

    def run(batches):
        m = model()
        for b in batches:
            rows = zip(*(b.column(b.schema.get_field_index(a)).to_pylist() for a in args))
            got = [None if None in r else call(getattr(m, method), *r, tries=tries) for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, out])

    return keep.mapInArrow(run, ddl)


def entity_attributes(chunks: DataFrame, model: type = OfflineModel) -> DataFrame:
    """(id, entity, attributes) of every named entity of every chunk."""
    e = chunks.where("text is not null").select("id", "text", F.explode(F.array_distinct("entities")).alias("entity")).where("trim(coalesce(entity, '')) <> ''")
    return ask_model(e, model, "attributes", ["entity", "text"], "attributes").select("id", "entity", "attributes")


def enrich(chunks: DataFrame, model: type = OfflineModel, text: str = "text") -> DataFrame:
    """Adds summary, entities and relations by a model that each worker builds once per task; a field whose calls all failed is NULL."""
    ship(chunks.sparkSession)
    keep = chunks.drop("summary", "entities", "relations")
    rel = pa.list_(pa.struct([("Source", pa.string()), ("Relationship", pa.string()), ("Destination", pa.string())]))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields) + ", summary string, entities array<string>, relations array<struct<Source:string,Relationship:string,Destination:string>>"

    def run(batches):
        m = model()
        for b in batches:
            t = [x or "" for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            e = [call(m.entities, x) for x in t]
            got = [call(m.relations, x, z) if z is not None else None for x, z in zip(t, e)]
            r = [None if y is None else [dict(zip(("Source", "Relationship", "Destination"), z)) for z in y] for y in got]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([call(m.summary, x) for x in t], pa.string()), pa.array(e, pa.list_(pa.string())), pa.array(r, rel)], names=[*b.schema.names, "summary", "entities", "relations"])

    return keep.mapInArrow(run, ddl)


def pending(incomplete: DataFrame, done: DataFrame) -> DataFrame:
    """Rows still to do: listed as incomplete and without a result."""
    return incomplete.join(done.select("doc_id").distinct(), "doc_id", "left_anti")


def progress(chunks: DataFrame) -> DataFrame:
    """(task, processed, unprocessed) per field that a task fills."""
    one = [F.struct(F.lit(c).alias("task"), ok.cast("int").alias("ok")) for c, ok in (("summary", F.coalesce(F.col("summary"), F.lit("")) != ""), ("entity", F.coalesce(F.size("entities"), F.lit(0)) > 0), ("relationship", F.coalesce(F.size("relations"), F.lit(0)) > 0))]
    r = chunks.select(F.explode(F.array(*one)).alias("x")).select("x.*")
    return r.groupBy("task").agg(F.sum("ok").cast("bigint").alias("processed"), F.sum(1 - F.col("ok")).cast("bigint").alias("unprocessed"))
