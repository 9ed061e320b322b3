from tidemark.llm import pairs, truncation


def log(spark, rows):
    return spark.createDataFrame(
        [(i, s, q, r, k, "clash") for i, s, q, r, k in rows],
        "id long, session_id string, user_query string, model_response string, knowledge_used string, client string",
    )


ROWS = [(i, f"cli-{i}", f"Which port does the report in Node{i} use since 7.1?", f"The report of Node{i} listens on port {i} and reads every journal.", "[]") for i in range(200)]
ODD = [
    (900, "web-1", "Which port does the report in", None, None), (901, None, None, "The report of Node3 listens on", '[{"id": 1'),
    (901, None, None, "The report of Node3 listens on", '[{"id": 1'), (902, "web-2", "", "", ""),
    (903, "web-3", "Which port does the report in Node3 use since 7.1?", "Which port does the report in Node3 use since 7.1", "[]"),
]


def test_broken_values_and_rates(spark):
    df = log(spark, ROWS + ODD)
    got = {tuple(r) for r in truncation.broken_values(df).collect()}
    assert got == {(900, "user_query"), (901, "model_response"), (901, "knowledge_used")}
    rates = {(r.client, r.field_name): (r.n_values, r.n_broken) for r in truncation.broken_rates(df).collect()}
    assert rates["none", "model_response"] == (1, 1) and rates["cli", "user_query"] == (200, 0)
    assert truncation.broken_values(log(spark, [])).count() == 0


def test_defects(spark):
    english = ["the report of the node listens on the port and reads every journal of the team"] * 6
    german = ["der Bericht des Knotens wurde vom Team geprüft und die Frist für die Anfrage geändert"] * 6
    labelled = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate([(t, "en") for t in english] + [(t, "de") for t in german] + [("x", None)])], "doc_id long, text string, lang string")
    rows = ROWS + ODD + [(904, "a-1", "Which port does the report of the team use and the journal?", "Der Bericht des Knotens wurde vom Team geprüft und die Frist geändert.", "[]"),
                         (905, "a-1", "Answer in German: which port does the report of the team use?", "Der Bericht des Knotens wurde vom Team geprüft und die Frist geändert.", "[]"),
                         (906, "a-1", "Which port?", "I must decline.", "[]")]
    got = {tuple(r) for r in pairs.defects(log(spark, rows), labelled).collect()}
    assert got == {(900, "empty"), (901, "truncated"), (902, "empty"), (903, "copy"), (904, "other_language"), (906, "refusal")}


def test_ends_are_counted_over_all_rows(spark):
    # six of 20,000 rows show that a sentence ends there; those that go on after its last word are many
    many = spark.range(20_000).selectExpr(
        "id", "concat('cli-', id) AS session_id", "'' AS user_query", "'[]' AS knowledge_used",
        "CASE WHEN id % 4000 < 2 AND id < 12000 THEN 'Every journal of the port reads report.'"
        " ELSE concat('The report of Node', id, ' listens on port ', id, ' and reads every journal of the team.') END AS model_response",
    )
    odd = log(spark, [(900_000, "cli-1", "", "Every journal of the port reads report", "[]"), (900_001, "cli-1", "", "The report of Node7 listens on port 7 and reads", "[]")])
    assert {tuple(r) for r in truncation.broken_values(many.unionByName(odd.select(*many.columns))).collect()} == {(900_001, "model_response")}


def test_languages_of_all_documents(spark):
    # the hundred most frequent languages and the first 4,000 characters are not all
    rows = [(f"x{i}", " ".join(chr(0x1200 + 3 * i + k) * 5 for k in range(3)) * 4) for i in range(100) for _ in range(4)]
    rows += [("de", "der Bericht des Knotens wurde vom Team geprüft und die Frist geändert")] * 3 + [("en", "." * 4_000 + " the report of the node listens on the port and reads")] * 4
    docs = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "doc_id long, lang string, text string")
    model = pairs.language_model(docs)
    s, _ = model.scores(["der Bericht wurde vom Team geprüft", "the node reads the report"])
    assert [model.names[i] for i in s.argmax(axis=1)] == ["de", "en"]


def test_refusals_of_all_answers(spark):
    # a table gives the same classifier as a list
    from tidemark.llm.refusals import Refusals, refusals_of

    answers = [f"The report of Node{i} listens on port {i}. I will not answer this, ask team {i % 7}." for i in range(3_000)] + ["N/A", "No."] * 20
    table, whole = refusals_of(spark.createDataFrame([(a,) for a in answers], "model_response string").repartition(5)), Refusals(answers)
    assert table.known == whole.known and abs(table.weights - whole.weights).max() < 1e-6 and (whole.weights != 0).sum() > 100


def test_defects_read_only_what_they_weigh(spark):
    # baselines of other fields decide nothing here, so their columns need not be there
    df = log(spark, ROWS + ODD)
    labelled = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert {tuple(r) for r in pairs.defects(df.drop("knowledge_used"), labelled).collect()} == {tuple(r) for r in pairs.defects(df, labelled).collect()}
