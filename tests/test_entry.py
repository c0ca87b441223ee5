import importlib
import subprocess
import sys

ROOT = __file__.rsplit("/tests/", 1)[0]


def test_every_oracle_has_its_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "word_buckets" in entry.queries()


def test_the_rest_stands_without_the_training_data_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path / "repo", capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")})
    n, ops, pipeline = said.stdout.split()[-3:]
    assert int(n) > 40 and (ops, pipeline) == ("False", "False")


def test_word_buckets_add_up(spark, tmp_path):
    rows = [(1, "one two\n\nthree"), (2, ""), (3, "w " * 150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    entry = importlib.import_module("__spark_entry__")
    got = {r["doc_id"]: r.asDict() for r in entry.queries()["word_buckets"](spark, str(tmp_path)).collect()}
    assert got[1] == {"doc_id": 1, "paragraphs": 3, "words": 3, "words_short": 3, "words_middle": 0, "words_long": 0}
    assert got[2]["words"] == 0 and got[3]["words_long"] == 150
