import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import cutoff, packing, scans, split


# ---- splitting


def test_pieces_keep_limits_and_text():
    r = random.Random(4)
    for _ in range(60):
        t = "".join(r.choice(["word ", "Some sentence. ", "x, y ", "\n", "\n\n", "longunbrokenstring" * r.randint(1, 40)]) for _ in range(r.randint(1, 600)))
        ps = split.pieces(t, 100, 10)
        text, pos = "", 0
        for s, e, _ in ps:
            assert 0 < e - s and (e - s) // 4 <= 100 and pos - s <= 43
            text, pos = text + t[max(s, pos) : e], e
        assert text == t and (len(ps) > 1) == (len(t) // 4 > 100)


def test_least_number_of_pieces_with_a_real_overlap():
    r = random.Random(9)
    for n in (4004, 7650, 7700, 7800, 7806, 7807, 11_609, 11_610, 40_000):
        words = " ".join(r.choice(["a", "word", "longer", "sentence.", "clause,", "line\n", "paragraph.\n\n"]) for _ in range(n))[:n]
        for t in ("x" * n, words):
            ps = split.pieces(t, 1000, 50)
            assert len(ps) == max(2, -(-(n - 200) // 3803))
            shared = [a[1] - b[0] for a, b in zip(ps, ps[1:])]
            assert all(20 <= x <= 200 for x in shared) and all(e - s <= 4003 for s, e, _ in ps)


def test_natural_boundary_wins():
    t = "A sentence here. " * 30
    assert {x for _, _, x in split.pieces(t, 50, 5)[:-1]} == {3}
    assert {x for _, _, x in split.pieces("x" * 900, 50, 5)[:-1]} == {0}


def test_split_frame(spark):
    big = "One two three. " * 400
    df = spark.createDataFrame([(1, big, 3, "old"), (1, big, 3, "old"), (2, None, 1, "o"), (3, "", 2, "o"), (4, "🙂" * 4004, 1, "o"), (5, "🙂" * 4003, 1, "o")], "id long, text string, page_number int, n_pieces string")
    got = split.split_oversized(df, "text").collect()
    n = {}
    for r in got:
        n.setdefault(r.id, []).append(r)
        assert r.token_count <= 1000 and r.token_count == len(r.text or "") // 4 and r.page_number == {1: 3, 2: 1, 3: 2, 4: 1, 5: 1}[r.id]
    assert [len(n[i]) for i in (1, 2, 3, 4, 5)] == [4, 1, 1, 2, 1]
    assert split.split_oversized(df.limit(0), "text").count() == 0


# ---- packing


def test_plan_uses_every_item_once_and_keeps_the_capacity():
    r = random.Random(1)
    for cap in (10, 100, 2048):
        counts = np.zeros(cap + 1, dtype=np.int64)
        for _ in range(1000):
            counts[r.randint(1, cap if r.random() < 0.2 else max(1, cap // 3))] += 1
        used = np.zeros_like(counts)
        bins = 0
        for need, times in packing.plan(counts, cap):
            assert sum(s * k for s, k in need.items()) <= cap and times > 0
            bins += times
            for s, k in need.items():
                used[s] += k * times
        assert (used == counts).all()
        assert bins <= 1.03 * -(-int((counts * np.arange(cap + 1)).sum()) // cap) + 2


def test_pack_frame(spark):
    r = random.Random(2)
    rows = [(i, r.choice([0, None, r.randint(1, 300), 100, 100, 100, r.randint(400, 1500)])) for i in range(600)] + [(600, 100), (600, 100)]
    df = spark.createDataFrame(rows, "k long, n long")
    got = packing.pack(df, "k", "n", 512, 40).collect()
    load, total = {}, {}
    for x in got:
        load[x.container_id] = load.get(x.container_id, 0) + x.n_tokens
        total[x.k] = total.get(x.k, 0) + x.n_tokens
    assert max(load.values()) <= 512 and len(total) == 601
    assert all(total[k] == (n or 0) for k, n in rows if k != 600) and total[600] == 200
    assert len(load) <= 1.02 * -(-sum(load.values()) // 512) + 1
    h = packing.harmonic(df.where("n between 1 and 512"), "k", "n", 512, 8, 2).groupBy("container").agg(F.sum("n").alias("s")).agg(F.max("s")).first()[0]
    assert h <= 512
    assert packing.pack(df.limit(0), "k", "n", 512).count() == 0


# ---- scanned pages


def page(i, body, head="Robust Survey Notebook"):
    return f"{head}\n{body}\n- {i} -"


def test_scan_noise(spark):
    body = "The survey panel confirms the seasonal pattern for the pilot\ngroup and the research desk reviews the weekly outlook of the\nregional sample before the final ranking of the second epoch."
    names = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet"]
    own = [body.replace("The", n.capitalize()).replace("group", n).replace("regional", n) for n in names]  # no line is on two pages
    rows = [(i, "d", i, f"c{i}", page(i, own[i], "Robust Survcy Notebook" if i == 3 else "Robust Survey Notebook"), "x") for i in range(1, 8)]
    rows += [(20, "d", 8, "c20", body.replace("seasonal pattern", "sea-\nsonal pattern"), "x"), (21, "d", 9, "c21", body.replace("weekly", "wcekly"), "x"), (22, "d", None, "c22", None, "x"), (23, None, 1, "c23", "", "x"), (24, "e", 2, "c24", "2015\n\nA page about the year.", "x")]
    rows += [(100 + i, "f", None, f"c{100 + i}", body.replace("\n", " "), "x") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, doc string, page int, chunk string, text string, clean string")
    got = {r.id: (set(r.kinds), r.clean) for r in scans.scan_noise(df, "id", "doc", "page", "chunk", "text").collect()}
    plain = body.replace("\n", " ")
    for i in range(1, 8):
        assert got[i] == ({"running_header", "page_number"}, own[i].replace("\n", " ")), i
    assert got[20] == ({"hyphen_break"}, plain) and got[21] == ({"misread"}, plain)
    assert got[22] == (set(), None) and got[23] == (set(), "") and got[24][0] == set() and got[100] == (set(), plain)
    assert len(got) == len(rows)


def test_headers_of_the_scanned_part_of_a_document_and_of_plain_pages(spark):
    body = "The survey panel confirms the seasonal pattern for the pilot\ngroup {0} and the research desk reviews the weekly outlook of the\nregional sample {0} before the final ranking of the second epoch."
    head = "A running header of more than a hundred characters, as some reports have them on top of every page they print"
    rows = [(i, "part", i, f"c{i}", f"{head}\n" + body.format(f"w{i}")) for i in range(1, 6)]
    rows += [(100 + i, "part", 100 + i, f"c{100 + i}", f"A whole page {i} in one line of text that goes on and on. " * 5 + ("\nA title" if i < 12 else "")) for i in range(60)]
    rows += [(300 + i, "plain", i, f"p{i}", f"Annual report\n\nA whole page {i} in one line of text that goes on and on. " * (1 if i < 9 else 0) + "Words.") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, doc string, page int, chunk string, text string")
    got = {r.id: set(r.kinds) for r in scans.scan_noise(df, "id", "doc", "page", "chunk", "text").collect()}
    assert all("running_header" in got[i] for i in range(1, 6)) and not any("running_header" in got[100 + i] for i in range(60))
    assert all("running_header" in got[300 + i] for i in range(9))


def test_long_words_and_long_page_lines():
    word = "modernisation" * 4
    words = scans.Words({scans.word_key(w): n for w, n in {word: 500, "x" * 300: 500, "model": 500}.items()}, 3, 20.0, 4)
    assert words.corrected(word.replace("m", "rn", 1)) == word and words.corrected("rnodel") == "model"
    assert words.corrected("b" * 5000) is None and words.corrected("q" + "x" * 299) is None
    assert scans.page_line("-" * 60 + " 12 " + "-" * 60) and not scans.page_line("x" * 60)


@pytest.mark.parametrize(("a", "b"), [("Robust basehne model", "Robust baseline model"), ("strati£ied sarnple", "stratified sample"), ("dccision 5urvey", "decision survey"), ("clecision", "decision"), ("voliime", "volume"), ("Week 3 | x", "Week 4 | x")])
def test_fold(a, b):
    assert scans.fold(a) == scans.fold(b)


@pytest.mark.parametrize(("line", "is_page"), [("3", 1), ("[7]", 1), ("– 4 –", 1), ("~ 2 ~", 1), ("p. 11", 1), ("Page 9 of 13", 1), ("3 / 90", 1), ("PAGE 40", 1), ("Pg 2", 1), ("from 2020.", 0), ("2.5", 0), ("Step 3", 0), ("10 %", 0)])
def test_page_lines(line, is_page):
    assert bool(scans.PAGE.fullmatch(line)) == bool(is_page)


# ---- cut texts


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        ("One sentence. Another one is cut in the mid", True), ("One sentence. Another one. Etc...", False), ("A full sentence. And the [truncated]", True),
        ("A sentence. The word is bro�", True), ("A sentence. Then an ent&nbs", True), ("A sentence. Then \\u00", True), ("A sentence. The quer…", True),
        ('{"a": [1, 2, {"b": "x"}]}', False), ('{"a": [1, 2, {"b": "x', True), ('{"a": [1, 2], "b": "}"', True), ("def f():\n    pass\n[\n {\n  \"a\": 1\n }\n]", False),
        ("Done.\n\n```\nx = 1\n```", False), ("Done.\n\n```\nx = 1", True), ("Done.\n\n| a | b | c |", False), ("Done.\n\n— Desk 7", False), ("Done.\n\nKeywords: one, two, three", False),
        ("Done.\n\nhttps://host.example/a/b", False), ("Done (see there", True), ("ok", False), ("", False), ("  \n", False), ("🙂", False), ('He said "yes."', False),
        ("An [open bracket here.", True), ("<div><p>Some text.", True), ("<div><p>Some text.</div>", False), ('He said "hello there.', True), ("(see the\nnext line.", True), ("He said “hello. There.", True),
        ("A (slip here.\n\nThe next paragraph is whole.", False), ("a) one, b) two.", False), ('A 5" disk and a 3.5" one.', False), ("„Ja“, sagte er.", False), ("»Ja«, sagte er.", False), ("« Oui », dit-il.", False), ("¿Qué hace el modelo.", True),
        ("¿Qué hace? Nada.", False), ("Sad :( but whole.", False), ("A List<String> is fine.", False), ("A <br/> line.", False), ("See <a href='" + "x" * 300, True), ("Is {open.", True), ("Whole." + ")" * 300, False), ("A broken end" + "�" * 400, True), ("See ```code``` there.", False),
    ],
)
def test_look(text, cut):
    assert bool(cutoff.look(text)[0]) == cut


def test_cut_frame(spark):
    rows = [(i, "a", f"This is text {i}. It ends well.") for i in range(20)] + [(30, "a", "This one ends well. That one ends in the mid"), (31, "a", None), (32, None, "This one ends well. That one too is cut in the mid")]
    rows += [(40 + i, "b", f"no terminator in this source {i} at all") for i in range(10)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, source string, text string, reasons string")
    got = {r.id: list(r.reasons) for r in cutoff.cut_texts(df, "id", "source", "text").collect()}
    assert {k for k, v in got.items() if v} == {30} and len(got) == len(rows)
    rates = {r.source: (r.n_texts, r.n_cut) for r in cutoff.truncation_rates(cutoff.cut_texts(df, "id", "source", "text"), "source").collect()}
    assert rates == {"a": (22, 1), None: (1, 0), "b": (10, 0)}
    assert cutoff.cut_texts(df.limit(0), "id", "source", "text").count() == 0


def test_a_source_that_cuts_most_of_its_texts_keeps_its_cuts(spark):
    words = "rates survey panel growth index model weekly outlook sample trend market signal desk note".split()
    rows = [(i, "limit", f"Text {i} starts well. Then the {words[i % 14]} of the {words[(i + 5) % 14]} goes on and on"[:44]) for i in range(20)]
    rows += [(100 + i, "limit", f"Text {i} is whole. It ends.") for i in range(5)]
    rows += [(200 + i, "single", (f"Only the {words[i % 14]} {words[(i * 3 + 1) % 14]} and {words[(i * 5 + 2) % 14]} of {i} go on without any stop")[:30]) for i in range(12)]
    rows += [(300 + i, "single", f"Short {words[i]} text {i}.") for i in range(4)]
    rows += [(400 + i, "plain", f"nobody stops here {i} " + "so " * i + "ever") for i in range(9)] + [(450, "plain", "One that stops.")]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    got = cutoff.cut_texts(df, "id", "source", "text")
    assert {r.id for r in got.collect() if r.reasons} == {*range(20), *range(200, 212)}
    assert {r.source: r.n_cut for r in cutoff.truncation_rates(got, "source").collect()} == {"limit": 20, "single": 12, "plain": 0}


def test_standing_lines_are_compared_in_small_tables_too(spark):
    items = "model, survey, index, panel".split(", ")
    rows = [(i, f"Done {i}.\n\nKeywords: {items[i % 4]}, {items[(i + 1) % 4]}, {items[(i + 2) % 4]}") for i in range(20)] + [(50, "Done.\n\nKeywords: model, survey, ind")]
    df = spark.createDataFrame([(i, "s", t) for i, t in rows], "id long, source string, text string")
    assert {r.id for r in cutoff.cut_texts(df, "id", "source", "text").collect() if r.reasons} == {50}


def test_harmonic_packs_every_item(spark):
    sizes = {1: 0, 2: None, 3: 1, 4: 512, 5: 513, 6: 1300, 7: 30, 8: 200}
    got = packing.harmonic(spark.createDataFrame(list(sizes.items()), "k long, n long"), "k", "n", 512, 8, 2).collect()
    load, total = {}, dict.fromkeys(sizes, 0)
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.n
        total[r.k] += r.n
    assert max(load.values()) <= 512 and total == {k: n or 0 for k, n in sizes.items()} and {r.k for r in got} == set(sizes)


def test_pieces_overlap_at_lines_and_paragraphs_too():
    t = "\n\n".join(f"Paragraph {i} has some words. It has a few sentences, and then it ends here." * 3 for i in range(40))
    ps = split.pieces(t, 100, 10)
    assert 5 in {w for _, _, w in ps[:-1]} and all(0 < e - s <= 40 for (_, e, _), (s, _, _) in zip(ps, ps[1:]))
