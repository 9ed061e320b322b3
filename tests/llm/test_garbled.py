import pytest

from tidemark.llm import garbled

SOUND = [
    "Der Nutzer möchte über die größere Schätzung nur 26 Zeilen und keine spätere Abhängigkeit.", "La préférence appelée Xanita a été remplacée au mois de février, à côté de la clé.",
    "Según la versión, cada petición íntegra cuesta 43 créditos más que antes. ¿Qué pasa?", "缓慢索引超过时，会清洗夜间适配并通知异步集群小组。归档频道的大小变成兆，远程管道不变。如果规则出错，先更新旧版关系，再记录编号。",
    "The “quiet” layer — the user’s café group — keeps a copy.", "A plain line of text without anything special.",
] * 30


@pytest.fixture(scope="module")
def model():
    return garbled.Model(SOUND)


@pytest.mark.parametrize("text", SOUND[:5])
@pytest.mark.parametrize("pair", [p for p in garbled.PAIRS if p[0] == "utf-8" and p[1] != "gb18030"])
def test_round_trip(model, text, pair):
    assert model.restore(garbled.garble(text, *pair)) == text


def test_twice_and_partly(model):
    text = SOUND[1]
    twice = garbled.garble(garbled.garble(text, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert model.restore(twice) == text
    head = "Der Nutzer möchte mehr. "
    assert model.restore(head + garbled.garble(text, "utf-8", "cp1252")) == head + text


def test_lost_and_sound(model):
    assert model.restore(garbled.garble(SOUND[0], "cp1252", "utf-8")) == ""
    assert all(model.restore(t) is None for t in SOUND[:6])
    assert model.restore("The export showed “Ã©” where the page has “é”, so nothing is wrong.") is None


def test_quoted_spans_of_a_garbled_document(model):
    text = "Der Nutzer möchte über die größere Schätzung (ä) nur 26 Zeilen und keine spätere Abhängigkeit 'ö' mehr."
    assert model.restore(garbled.garble(text, "utf-8", "cp1252")) == text


def test_gb_spans(model):
    text = "如果规则出错，先更新旧版关系，再记录编号"
    span = garbled.garble("夜间适配", "utf-8", "gb18030")
    assert garbled.LOST not in span and model.restore(f"{text}{span}Node") == f"{text}夜间适配Node"


def test_documents(spark):
    bad = garbled.garble(SOUND[0], "utf-8", "latin-1")
    rows = [(i, t, "x") for i, t in enumerate(SOUND)] + [(900, bad, "x"), (901, None, "x"), (902, "", "x"), (903, "a" * 200_000 + bad, "x")]
    got = {r.doc_id: r.restored_md5 for r in garbled.garbled_documents(spark.createDataFrame(rows, "doc_id long, text string, restored_text string")).collect()}
    assert got == {900: garbled.md5_of(SOUND[0]), 903: garbled.md5_of("a" * 200_000 + SOUND[0])}
    assert garbled.garbled_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_emissions_of_all_documents(spark):
    # Greek stands in five of 12,000 documents, none of them in the 4,000 once sampled
    last = {821, 9530, 4863, 8610, 8919}
    greek = "Η ομάδα διαβάζει την αναφορά κάθε Δευτέρα και κρατά ένα αντίγραφο για τον χρήστη."
    rows = [(i, greek if i in last else SOUND[i % 6]) for i in range(12_000)] + [(20_000, garbled.garble(greek[2:40], "utf-8", "cp1251"))]
    got = {r.doc_id: r.restored_md5 for r in garbled.garbled_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {20_000: garbled.md5_of(greek[2:40])}
