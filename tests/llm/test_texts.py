"""Sentences, pieces, truncation, answers, scans: small cases and edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import pairs, pieces, scans, sentences, truncation

EN = (
    ["Dr. Smith met Mr. Jones in No. 7 of the series. The board saw e.g. two cases, approx. 5 in all. "] * 30
    + ["The clinic opens at 7 a.m. and closes at 6 p.m. The board agreed. Dr. Brown left. See Fig. 3 and No. 9 there. "] * 30
    + ["The register lists two cases before discharge. The team saw Dr. White again. An autopsy was made. "] * 30
)


@pytest.fixture(scope="module")
def model(spark):
    return sentences.learn(spark.createDataFrame([(t, "en") for t in EN], "text string, lang string"))


def cuts(model, text, lang="en"):
    lo, out = 0, []
    for e in sentences.boundaries(text, lang, model):
        out.append(text[lo:e].strip())
        lo = e
    return out


def test_abbreviations_are_learned(model):
    assert model["en"]["ends"]["dr"] < 0.1 and "no" in model["en"]["numbered"]
    assert cuts(model, "Dr. Smith left. The board agreed at 6 p.m. The end.") == ["Dr. Smith left.", "The board agreed at 6 p.m.", "The end."]
    assert cuts(model, "He paid 3.14 for No. 7 there. Then A. B. Carr left.") == ["He paid 3.14 for No. 7 there.", "Then A. B. Carr left."]


def test_quotes_headings_and_breaks(model):
    assert cuts(model, "“Is it safe?” asked Ann. She left.") == ["“Is it safe?” asked Ann.", "She left."]
    assert cuts(model, 'He wrote: "It was high." The end.') == ['He wrote: "It was high."', "The end."]
    assert cuts(model, "A heading\n\nOne line\nbroken here. (The table is long.) Next") == ["A heading", "One line\nbroken here.", "(The table is long.)", "Next"]
    assert cuts(model, "It was over ... then it rose.") == ["It was over ... then it rose."]


def test_other_scripts(model):
    assert cuts(model, "护士写道：“太高了。”“安全吗？”医生问道。好。", "zh") == ["护士写道：“太高了。”", "“安全吗？”医生问道。", "好。"]
    assert cuts(model, "看護師は「量が多すぎた。」と書いた。次。", "ja") == ["看護師は「量が多すぎた。」と書いた。", "次。"]
    assert cuts(model, "โรคนี้ลุกลาม ยาAbcปลอดภัย", "th") == ["โรคนี้ลุกลาม", "ยาAbcปลอดภัย"]
    assert cuts(model, '"मात्रा अधिक थी।" यह नर्स ने लिखा। और।', "hi") == ['"मात्रा अधिक थी।" यह नर्स ने लिखा।', "और।"]


def test_split_edge_rows(spark, model):
    rows = [("a", "One. Two.", "en", 1), ("a", "One. Two.", "en", 1), ("b", None, None, 1), ("c", "  \n ", "en", 1), ("d", "x" * 200_000, None, 1), (None, None, None, None)]
    got = sentences.split_sentences(spark.createDataFrame(rows, "id string, text string, lang string, end_pos int"), model)
    assert {(r.id, r.end_pos) for r in got.collect()} == {("a", 4), ("a", 9), ("d", 200_000)}
    empty = spark.createDataFrame([], "text string, lang string, id string")
    assert sentences.split_sentences(empty, sentences.learn(empty)).count() == 0


def test_pieces_round_trip(spark, model):
    rnd = random.Random(2)
    for _ in range(30):
        t = "".join(rnd.choice(["ab ", "Word. ", "\n\n", "x" * rnd.randint(1, 90), "。"]) for _ in range(rnd.randint(1, 400)))
        ps = pieces.cut(t, sentences.boundaries(t, "en", model), 100, 20)
        assert "".join(t[o:z] for _, o, z in ps) == t
        assert all(z - a <= 100 and o - a <= 20 for a, o, z in ps)
    rows = [("p", ("a" * 60 + ". " + "b" * 30 + "\n\n") * 3, "en"), ("s", ("Aaa bbb ccc. " * 20), "en"), ("w", "aaa " * 60, "en"), ("n", "a" * 300, "en"), ("n", "a" * 300, "en"), ("k", "short", "en"), ("z", None, None)]
    df = spark.createDataFrame(rows, "id string, text string, lang string")
    assert {r.id: r.cut_at for r in pieces.cut_levels(df, model, 100).collect()} == {"p": "paragraph", "s": "sentence", "w": "word", "n": "none"}
    assert pieces.cut_pieces(df, model, 100, 20).where(F.length("text") > 100).count() == 0
    with pytest.raises(ValueError):
        pieces.cut_pieces(df, model, 10, 10)


def test_truncation(spark):
    rnd = random.Random(4)
    names = [f"N{rnd.choice('aeiou')}{rnd.choice('bdgk')}{i}x".replace("1", "o") for i in range(40)]
    sent = lambda: f"The {rnd.choice(['board', 'nurse', 'team'])} saw {rnd.choice(names)} near the {rnd.choice(['river', 'ward'])} before the visit."
    docs = []
    for i in range(600):
        t = " ".join(sent() for _ in range(rnd.randint(1, 9)))
        if rnd.random() < 0.5:
            t = f"Use of {rnd.choice(names)} in the ward\n\n" + t
        docs.append((i, t[:150] if len(t) > 150 else t, rnd.choice(["Feed", " feed ", "FEED"])))
    docs += [(1000, None, "feed"), (1001, "", None), (1002, "The nurse saw the river.\n\n- board\n- nurse", "x"), (1003, "The nurse said: “the board saw the", "x"), (1004, "a | 3 mg | board", "x"), *((1010 + i, "The nurse saw the river.\n\n- nurse\n- board\n- nurse", "x") for i in range(4)), (0, docs[0][1], docs[0][2])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("state", F.lit("clash"))
    judged, limits = truncation.analyse(df)
    assert 150 in {r.len for r in limits.where("src = 'feed' and unit = 'chars'").collect()}
    got = {r.doc_id for r in truncation.cut_documents(df).collect()}
    exp = {i for i, t, _ in docs if t and len(t) == 150 and not t.rstrip().endswith((".", "ward"))}
    assert len(got & exp) >= 0.95 * len(exp) and len(got - exp - {1003}) <= 0.05 * len(exp)
    assert 1003 in got and not got & {1000, 1001, 1002, 1004, 1010}
    assert truncation.truncation_rates(df).where("source = 'feed'").first().documents == 601
    assert truncation.cut_documents(df.limit(0)).count() == 0


def test_only_titles_are_titles(spark):
    """Long texts that nearly all stop in mid-sentence, and a source of few texts, are no titles."""
    words = ["river", "ward", "midwife", "board", "letter", "visit"]
    title = lambda i: f"Use of {words[i % 6]} in {words[i // 6]}"
    long = lambda i: f"The {words[i % 6]} saw the {words[i // 6]}. " * (i + 4) + "The nurse went to the river"
    docs = [(i, title(i), "titles") for i in range(36)] + [(1000 + i, long(i), "broken") for i in range(30)] + [(2000 + i, f"The {words[i]} went to the river", "tiny") for i in range(3)]
    got = {r.doc_id for r in truncation.cut_documents(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()}
    assert got == {*range(1000, 1030), *range(2000, 2003)}


def test_limit_takes_part_in_the_verdict(spark):
    """At a significant length a known shape is no proof: the item itself must stand whole somewhere."""
    rnd = random.Random(5)
    pad = lambda n: ("".join(rnd.choice("abdegiknorstu") if rnd.random() < 0.85 else " " for _ in range(n - 1)) + ".").replace(" .", "o.")
    name = lambda i: "K" + "".join("aeioudgkmn"[int(c)] for c in f"{i:03}") + "vo"
    tail = lambda last: f"\n\n- Tissue sample\n- Numbness\n- {last}"
    whole = [(i, pad(rnd.randint(60, 400)) + tail(f"{name(i)} Heights") + "\n- Numbness\n\nThe end came.", "feed") for i in range(300)]
    at = lambda i, last: (i, pad(200 - len(tail(last))) + tail(last), "feed")
    docs = whole + [at(1000 + i, name(i)) for i in range(30)] + [at(2000, "Numbness"), at(2001, f"{name(90)} Heights"), (3000, pad(120) + tail(name(99)), "feed")]
    got = {r.doc_id: r.limited for r in truncation.cut_documents(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()}
    assert got == {1000 + i: True for i in range(30)}


@pytest.mark.parametrize(
    ("q", "a", "lang", "want"),
    [
        ("Who was born?", None, "en", "empty"), ("Who?", '{"answer": ""}', "en", "empty"), ("Who?", " ​ ", "en", "empty"), ("Who?", "n/a.", "en", "empty"),
        ("Who founded it?", "who  founded it", "en", "echo"), ("Who founded it?", "You asked: “Who founded it?”", "en", "echo"),
        ("Who founded it?", "I'm sorry, but I can't answer this question.", "en", "refusal"), ("Who founded it?", "Bob refused to answer the inquiry and left in 1990.", "en", None),
        ("Wer war es?", "Das weiß ich leider nicht.", "de", "refusal"), ("¿Quién fue?", "Lo siento, no puedo responder.", "es", "refusal"), ("Qui ?", "Le contexte ne permet pas de répondre.", "fr", "refusal"),
        ("Who founded the clinic?", "Das Haus wurde von der Frau in dem Jahr gegründet.", "en", "wrong_language"), ("How would it sound in German?", "Das Haus wurde von der Frau gegründet.", "en", None),
        ("Who founded the clinic?", "护士写道。", None, "wrong_language"), ("Who founded the clinic?", "Ann Bee", "en", None), ("When?", "1999", "en", None),
        ("Who founded the clinic?", "The founder of the clinic was bor", "en", "truncated"), ("Who founded it?", '{"answer": "The founder was Ann', "en", "truncated"),
        ("Who founded it?", "```\nThe founder was Ann.", "en", "truncated"), ("Which organ?", "Bone marrow", "en", None), (None, "The founder was Ann Bee.", None, None), ("Which organ?", "**The skin is harmed.**", "en", None),
    ],
)
def test_pairs(q, a, lang, want):
    assert pairs.defect(q, a, lang) == want


def test_pairs_rows(spark):
    rows = [("1", "Who?", None, "en", "p", "x"), ("1", "Who?", None, "en", "p", "x"), ("2", "Who?", None, "en", None, "x"), ("3", None, None, None, "p", None)]
    df = spark.createDataFrame(rows, "id string, query string, answer string, lang string, prompt string, defect string")
    assert {tuple(r) for r in pairs.broken_pairs(df).collect()} == {("1", "empty"), ("3", "empty")}
    assert pairs.broken_pairs(df.limit(0)).count() == 0


def test_tiling_marks_and_repeats():
    assert pairs.tiles("what is it what is it".split(), "what is it".split()) == [True] * 6
    # the longest tile comes first; its words cannot serve a shorter one
    assert pairs.tiles("a b c a b x".split(), "a b c".split()) == [True, True, True, True, True, False]
    assert pairs.tiles("c b a".split(), "a b c".split()) == [False] * 3
    assert pairs.tiles([], ["a"]) == [] and pairs.tiles(["a"], []) == [False] and pairs.tiles(["a"], ["a"]) == [True]


def test_parser_of_tags_and_lists():
    left_open = {"<b>bold": "</b>", "<b>x</b>": None, "a < b": None, "x <br> y": None, "<i/>": None, "see <a href='": "<", "- one\n- ": "item", "- one\n- two": None, "1. “a\n2. b": None, "<ul><li>x</li>": "</ul>"}
    assert {x: pairs.open_structure(x) for x in left_open} == left_open
    assert pairs.list_items("- a\n- b c") == ["a", "b c"] and pairs.list_items("a - b") == [] and pairs.list_items("Text:\n- a\n- b") == []
    assert not pairs.unfinished("- Ann Bee\n- Besi Nara") and pairs.unfinished("- It is good.\n- It is") and pairs.unfinished("- alpha\n- beta of the")


def test_refusal_grammar():
    assert pairs.refuses("I was unable to say.") and pairs.refuses("It is late. Unable to answer.") and not pairs.refuses("Ann was unable to answer the inquiry.")
    with pytest.raises(ValueError):
        pairs.derive({"a": ["x <b>"], "b": ["<a>"]}, "a")


def test_collocations_keep_a_period_inside():
    m = {"starters": frozenset(), "ends": {"univ": 0.9}, "ordinal": frozenset(), "numbered": frozenset(), "pairs": {("univ", "Press")}}
    model = sentences.Model(en=m)
    assert sentences.boundaries("At the Univ. Press it is. So.", "en", model) == [25, 29]
    assert sentences.boundaries("At the Univ. Staff left. So.", "en", model) == [12, 24, 28]


def test_cut_level_comes_from_the_bisection(monkeypatch):
    t = "a" * 15 + " " + "b" * 15 + ".\n\n" + "c" * 12
    assert pieces.level(t, [32, 46], 40) == "paragraph" and pieces.level("x y. " * 10, list(range(4, 50, 5)), 20) == "sentence" and pieces.level(t, [32, 46], 20) == "word" and pieces.level(t, [32, 46], 14) == "none"
    monkeypatch.setattr(pieces.Cuts, "best", lambda self, lo, hi, reach: ((lo + hi) // 2, 3))
    assert pieces.level(t, [32, 46], 40) == "none"


def test_tiling():
    assert pairs.tiles("a b c x".split(), "a b c".split()) == [True, True, True, False]
    assert pairs.open_structure("a (b") == ")" and pairs.open_structure("a “b” (c)") is None and pairs.open_structure("```\nx") == "```"


def test_gram_keys_lose_no_pair():
    """All spellings within one edit share a key, whether their grams are common or not, and however long they are."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abst") for _ in range(rnd.randint(1, 9))) for _ in range(200)] + ["ab" * 60, "ab" * 60 + "s"]
    weight = {g: 5 for w in words[:40] for g in scans._grams(scans.fold(w))}
    import pyarrow as pa

    def keys(probe):
        run, _ = scans._gram_rows("x", weight, probe)
        out = {}
        for b in run([pa.RecordBatch.from_arrays([pa.array(words), pa.array([1] * len(words))], names=["w", "n"])]):
            for g, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.setdefault(w, set()).add(g)
        return out

    asks, has = keys(True), keys(False)
    near = [(a, b) for a in words for b in words if a != b and scans.close(scans.fold(a), scans.fold(b), 1)]
    assert near and all(asks[a] & has[b] for a, b in near)


def test_scan_parts():
    assert scans.fold("m0dern") == scans.fold("rnodern") and scans.fold("clay") == scans.fold("day")
    assert scans.page_value("— 12 —")[1] == 12 and scans.page_value("l7l")[1] == 171 and scans.page_value("40 mg")[0] == -1
    assert scans.close("abcd", "abxd", 1) and not scans.close("abcd", "wxyz", 2)
    assert scans.title_match("THE MEDlCAL HISTORY   12", scans.letters("The Medical History of X"), "") > 0.5
    assert scans.rebuild("one di-\nvided\n\n12\n\nword. New\n\nEnd", {3}, {0}, {"New": "Now"}) == "one divided word. Now\n\nEnd"
    assert scans.rebuild(None, set(), set(), {}) is None


def test_scans_end_to_end(spark):
    rnd = random.Random(7)
    stock = "the nurse saw every patient near river before discharge and kept a daily record of modern treatment in quiet ward under night shift".split()
    text = lambda: " ".join(" ".join(rnd.choice(stock) for _ in range(9)).capitalize() + "." for _ in range(8))
    clean = [(f"c{i}", 1, "web_page", text()) for i in range(80)]
    scan = "Handbook of Quiet Wards   12\n\nThe nurse saw the pati-\nent near the river before dischargc and kept\n— 13 —\na daily rec0rd of the ward."
    rows = [*clean, ("s", 1, "scan", scan), ("s", 1, "scan", scan), ("e", None, "scan", ""), ("n", 9, "scan", None)]
    chunks = spark.createDataFrame(rows, "id string, book_id bigint, origin string, text string").withColumn("kind", F.lit("clash"))
    books = spark.createDataFrame([(1, "Handbook of Quiet Wards", "ed. A. Bee", 300)], "book_id bigint, title string, author_line string, n_pages int")
    got = {tuple(r) for r in scans.noisy_lines(chunks, books).collect()}
    assert {("s", 0, "header"), ("s", 4, "page_number"), ("s", 2, "hyphen"), ("s", 3, "ocr"), ("s", 5, "ocr")} <= got and not {x for x in got if x[0] != "s"}
    fixed = {r.id: r.text for r in scans.repaired(chunks, books).collect()}["s"]
    assert fixed == "The nurse saw the patient near the river before discharge and kept a daily record of the ward."
    assert scans.noisy_lines(chunks.limit(0), books.limit(0)).count() == 0
