import numpy as np
import pytest

from tidemark.llm import endings, pairs
from tidemark.llm.refusals import Refusals

PLAIN = [
    f"The nightly job on Node{i} merges {i} rows and writes them to the {a} prompt. Every {d} the {a} team reads the report of Node{i}."
    for i in range(40) for a, d in (("stale", "Monday"), ("quiet", "Friday"))
] + [f"The {n} of Node{i} is stale." for i in range(9) for n in ("cluster", "prompt", "report")] + [f"why did Node{i} drop {i} rows from the {n}" for i in range(40) for n in ("cluster", "prompt", "report")]


@pytest.fixture(scope="module")
def model():
    return endings.EndModel(PLAIN)


@pytest.mark.parametrize("text,broken", [
    (None, False), ("", False), ("  ​", False), ("N/A", False), ("null", False),
    ("The nightly job on Node7 merges 5 rows and writes them to the stale prompt.", False),
    ("The nightly job on Node7 merges 5 rows and writes them to the", True),
    ("The nightly job on Node7 merges 5 rows and wri", True),
    ("The nightly job on Node7 merges 5 rows and wri…", True),
    ("The nightly job on Node7 merges 5 rows [truncated]", True), ("The nightly job on Node7 merges <cut>", True),
    ("All rows were merged. (ok)", False), ("All rows were merged. ✅", False), ("全部完成。（完）", False),
    ("why did Node3 drop 9 rows from the cluster", False), ("“why did Node3 drop 9 rows from the cluster”", False),
    ("Use this:\n```\na = 1\nb =", True), ("Use this:\n```\na = 1\n```", False), ("He said “stop", True), ("All done. :)", False), ("Done :)", True),
    ("Rows were merged.�", False), ("Rows were mer�", True),
])
def test_prose(model, text, broken):
    assert endings.broken_text(text, model) is broken


@pytest.mark.parametrize("text,broken", [
    (None, False), ("[]", False), ('[{"id": 1, "content": "All rows were merged."}]', False),
    ('[{"id": 1, "content": "The nightly job on Node7 mer', True), ('[{"id": 1, "layer": "x", ', True), ('[{"id": 1}, {"id"…', True),
    ('[{"id": 1, "content": "The nightly job on Node7 merges 5 rows and wri"}]', True), ("['id']", False), ('{"a": "]"', True),
])
def test_json(model, text, broken):
    assert endings.broken_json(text, model) is broken


def test_structure_ignores_stray_closers():
    assert endings.open_structure("1) a :( b) [x]") == "" and endings.open_structure("f(x[1)") == ""
    assert endings.open_structure("a (b [c] d") == "("
    for text, mark in (
        ('He said "stop. Now.', '"'), ('He said "stop".', ""), ("Use `a.b", "`"), ("Use `a.b`.", ""), ("A **bold. Word.", "**"), ("2 ** 3 is 8.", ""), ('A 5" disk.', ""),
        ("<b>All done.", "<b>"), ("<b>All</b> done.<br>", ""), ('<div class="x"><p>a</div>', ""), ("a <- b", ""), ("```\n(\n```", ""),
    ):
        assert endings.open_structure(text) == mark, text


def test_held_out_texts(model):
    import random

    rng, right, n = random.Random(1), 0, 0
    for i in range(100, 160):
        whole = f"The nightly job on Node{i} merges {i} rows and writes them to the quiet prompt. Every Friday the stale team reads the report of Node{i}."
        cut = whole[:rng.randrange(30, len(whole) - 4)]
        for text, broken in ((whole, False), (f"why did Node{i} drop {i} rows from the report", False), (cut, not cut.rstrip().endswith((".", "prompt")))):
            right, n = right + (endings.broken_text(text, model, 0.9) is broken), n + 1
    assert right >= 0.95 * n


@pytest.mark.parametrize("answer,empty", [(None, True), ("\xa0 ", True), ("<p></p>", True), ("(no response)", True), ("-", True), ("No.", False), ("Ja.", False), ("无", True)])
def test_empty_answers(answer, empty):
    assert endings.is_empty(answer) is empty


@pytest.fixture(scope="module")
def refusals():
    return Refusals(PLAIN + ["No.", "Yes.", "没有。", "Nein."] * 20 + ["Sorry for the wait, here is what I found. Rows merge."])


@pytest.mark.parametrize("answer,refusal", [
    ("I'm sorry, but I can't help with that request.", True), ("Unfortunately this falls outside what I may discuss. No comment on X, sorry.", True),
    ("抱歉，我无法回答关于X的问题。", True), ("Leider muss ich diese Anfrage ablehnen.", True), ("Lo siento, no puedo ayudar con eso.", True),
    ("I can't see the whole log, but this much is certain. Node merges rows.", False), ("Sorry for the wait, here is what I found. Rows merge.", False), ("No.", False),
    # wordings that no seed has
    ("I am afraid I cannot help you with that topic.", True), ("My rules prevent me from talking about this topic.", True), ("Je ne peux malheureusement pas répondre à cette demande.", True),
    ("对不起，我不能回答这个请求。", True), ("Darüber kann ich leider keine Auskunft geben.", True), ("No puedo hablar de este tema.", True),
    ("没有。", False), ("The nightly job on Node7 merges 5 rows and writes them to the stale prompt.", False), ("", False), ("!!", False), ("Sorry.", True),
])
def test_refusals(refusals, answer, refusal):
    assert refusals.is_refusal(answer) is refusal


def test_refusals_without_a_sample():
    assert Refusals([]).is_refusal("I must decline this request.") and not Refusals([]).is_refusal("Node7 merges")


@pytest.mark.parametrize("q,a,copy", [
    ("Who owns the plain terminal?", "You asked: Who owns the plain terminal?", True), ("Who owns the plain terminal?", "WHO OWNS THE PLAIN TERMINAL. Who owns the plain terminal", True),
    ("为什么节点要等66秒？", "您的问题是：为什么节点要等66秒？", True), ("Who owns the plain terminal?", "The plain terminal is owned by the storage team.", False),
    (None, "Who owns it and why?", False), ("Who?", "Who?", False),
])
def test_copies(q, a, copy):
    assert pairs.is_copy(q, a) is copy


def test_languages_of_whole_texts():
    texts = {"en": ["the team reads the report of the nightly job and writes it"] * 5, "de": ["das Team liest den Bericht der nächtlichen Aufgabe und schreibt ihn"] * 5}
    model = pairs.Languages(texts)
    s, n = model.scores(["the nightly report of the team", "", "der Bericht des Teams und der Aufgabe"])
    assert model.names[s[0].argmax()] == "en" and model.names[s[2].argmax()] == "de" and n[1] == 0


def test_pairs_of_one_language_or_of_two():
    likelihood = np.array([[-10.0, -30.0, -40.0], [-10.0, -11.0, -40.0], [-10.0, -30.0, -40.0]])
    answers = np.array([[-50.0, -20.0, -40.0], [-50.0, -20.0, -40.0], [-50.0, -20.0, -40.0]])
    assert pairs.differ(likelihood, answers, np.array([50, 50, 5]), np.array([50, 50, 50])).tolist() == [True, False, False]


@pytest.mark.parametrize("text", ["a b…", "done. ", "x" * 500 + " " * 300, "…" * 400, "cut [truncated] [truncated]", "", "a.b..", "� �", "x (cut) ..."])
def test_marks_of_breaks_are_found_from_the_end(text):
    assert text[:endings._body_end(text)] == endings.BREAK_MARKS.sub("", text)


ODD = ["a.b_c Node7 7.1.0 2024-05-16 12345-01-01", "ab\x1c\x1f\x85\tc\n_d_ é.x É', 中.文 x中y", "٣٤ ² 𝔸😀 İ ΟΔΟΣ ’s it's l’été", "(no response)" + "!" * 40, "null" + " " * 30 + "</b>", ""]


def test_fast_patterns_read_the_same():
    import re

    from tidemark.llm import refusals

    letter = r"[^\W\d_一-鿿]"
    token = re.compile(rf"{letter}+(?:[._]{letter}+)+|\d{{4}}-\d\d-\d\d|\d+(?:\.\d+)+|\d+|[一-鿿]|{letter}+|\n|[^\w\s]")
    word = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+(?:['’][^\W\d_]+)*|\d+")
    for text in [*ODD, *PLAIN, *map(chr, range(0x3000))]:
        assert endings.tokens_of(text) == token.findall(text)
        assert refusals._words(text) == [w.lower() for w in word.findall(text.replace("’", "'"))]
    assert [endings.is_empty(t) for t in ODD] == [False, False, False, True, True, True]


def test_features_of_many_sentences(refusals):
    rows = [refusals._masked(words) for words in ([], ["no"], ["sorry", "1", "xyzzy", "sorry", "1"], ["i", "must", "decline"] * 3)]
    found, sizes = refusals._numbers(rows)
    at = [0, *np.cumsum(sizes)]
    assert [set(found[a:b].tolist()) for a, b in zip(at, at[1:])] == [refusals._features(words) for words in rows] and len(found) == sum(map(len, map(refusals._features, rows)))


@pytest.mark.parametrize("a,copy", [
    ("a b c d e f g h Who owns the plain terminal?", True), ("a b c d e f g h i Who owns the plain terminal?", False),
    ("Who owns the plain terminal? a b c d e f g h", True), ("a b c d e f g h owns the plain terminal", True), ("a b c d e f g h owns the plain terminal x", False),
])
def test_copies_after_a_lead_in(a, copy):
    assert pairs.is_copy("Who owns the plain terminal?", a) is copy
