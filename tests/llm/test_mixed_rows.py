from vellum.llm import mixing


def test_rows_that_differ_only_in_which_column_is_null_are_two(spark):
    rows = [(1, "some words here", "x", None), (1, "some words here", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {tuple(r) for r in mixing.mixed_documents(docs).collect()}
    taken = {r["key"]: r["copies"] for r in mixing.mix(mixing.sizes_of(docs.selectExpr("*", "int(source IS NULL) AS k"), "k")).collect()}
    assert got == {rows[k] for k, n in taken.items() if n}
    assert len(got) == 2


def test_the_mix_tells_rows_apart_when_one_hash_cannot(spark):
    rows = [(1, "some words here", None, {"a": 1, "b": 2}), (1, "some words here", None, {"b": 2, "a": 1}), (1, "some words here", "x", None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more map<string,int>")
    got = mixing.mixed_documents(docs).collect()
    assert {r["source"] for r in got} <= {None, "x"} and all(r["more"] in ({"a": 1, "b": 2}, None) for r in got)
