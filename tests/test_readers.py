"""Answers that give no candidates are told apart from empty lists."""

from docrecon.sources.readers import answer_faults, parse_candidates


def test_answer_faults(spark):
    answers = {
        1: '{"billCandidates": []}', 2: '{"billCandidates": [{"vat": {"value": 1.5}}]}', 3: None, 4: "  ",
        5: '{"billCandidates": [', 6: "Sorry, I cannot read this", 7: '{"other": 1}', 8: "[]",
        9: '{"billCandidates": null}', 10: '{"billCandidates": {"vat": 1}}', 11: "3",
    }
    # ``fault`` is also a column of the input here: the verdict takes its place.
    df = spark.createDataFrame([(k, a, "x") for k, a in answers.items()], "id long, answer string, fault string")
    got = {r.id: r.fault for r in answer_faults(df, "answer").collect()}
    assert got == {
        3: "no answer", 4: "no answer", 5: "not JSON", 6: "not JSON", 7: "no candidate list",
        8: "no candidate list", 9: "no candidate list", 10: "no candidate list", 11: "no candidate list",
    }
    assert parse_candidates(df.drop("fault"), "answer").select("id").distinct().count() == len(answers)
    assert answer_faults(df.limit(0), "answer").count() == 0
