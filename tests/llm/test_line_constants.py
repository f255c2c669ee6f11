"""The leaves' constant tokens give the same templates whether they are broadcast or shuffled."""

from partita.llm import line_template


def test_constants_by_shuffle_give_the_same_lines(spark, monkeypatch):
    rows = [(i, f"user {i} logged in from host{i} at noon\nown words of text {chr(97 + i)} {chr(98 + i)}") for i in range(8)]
    rows += [(8, "user 3 logged in from host5 at night\nelse"), (9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: (r.text, r.n_dropped) for r in line_template.dedup_lines(docs).collect()}
    assert want[0][1] == 0 and all(want[i][1] == 1 for i in range(1, 8))
    monkeypatch.setattr(line_template, "BROADCAST_TOKENS", -1)
    monkeypatch.setattr(line_template, "small", lambda df: df)
    assert {r.doc_id: (r.text, r.n_dropped) for r in line_template.dedup_lines(docs).collect()} == want
