"""The commands over folders of packages."""

import io
import json

import builders as B
import pytest

from vellum import cli


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    now, then = tmp_path_factory.mktemp("now"), tmp_path_factory.mktemp("then")
    long = "An opening paragraph of a hundred characters or more, so that it counts as prose and not as a title at all."
    lines = [B.line("1 Start", style="Heading1"), B.line(long), B.line("It is said (Falk 1971). See Section 7."), B.line("Table 1. Boats by harbour"), B.grid(["a", "b"]), B.line("References"), B.line("Falk, A. 1971. On tides. Journal 3, 1–2.")]
    (now / "a.docx").write_bytes(B.archive(B.body(*lines, B.line("It said ", B.added("more")))))
    (then / "a.docx").write_bytes(B.archive(B.body(*lines, B.line("It said "))))
    return str(now), str(then)


def call(spark, *arguments):
    out = io.StringIO()
    code = cli.main([str(a) for a in arguments], spark, out)
    return code, [json.loads(x) for x in out.getvalue().splitlines()]


def test_commands_find_and_say(spark, folders):
    now, then = folders
    assert call(spark, "citations", now)[0] == 1
    code, rows = call(spark, "link", now)
    assert code == 0 and {r["kind"] for r in rows} == {"mention", "entry"}
    assert [r["finding"] for r in call(spark, "sections", now)[1]] == ["no-such-section"]
    assert call(spark, "lint", now) == (0, [])
    assert call(spark, "count", now)[1][0]["headings"] == 2
    assert {r["finding"] for r in call(spark, "fit", now)[1]} == {"caption-unbound", "row-may-split"}
    assert call(spark, "authors", now)[1][0]["author"] == "Ann"
    code, rows = call(spark, "compare", now, then)
    assert code == 1 and any(r["bucket"] == "text" for r in rows)
    assert [r["label"] for r in call(spark, "revision", "status", now, then)[1]] == ["proposal"]
    code, rows = call(spark, "revision", "validate", now, then)
    assert (code, rows[0]["ok"]) == (0, True)
    assert call(spark, "probe", now)[1][0]["sections"] == 1 and call(spark, "text", now, "--view", "original")[1][-1]["text"] == "It said "
    assert any(r["name"] == "audit_links" for r in call(spark, "api", ".", "citation")[1])


def test_what_needs_a_word_processor_says_so(spark):
    assert cli.main(["pdf", "x"], spark) == 2 and cli.main(["revision", "build", "x"], spark) == 2


def test_every_command_is_offered():
    offered = cli.build_parser().format_help()
    assert all(name.split()[0] in offered for name in cli.COMMANDS) and len(cli.COMMANDS) > 35


def test_a_project_of_rounds(spark, folders, tmp_path):
    from vellum.operators import rounds

    now, then = folders
    assert call(spark, "init", tmp_path, "tides")[0] == 0
    paper = rounds.load_paper(rounds.find_config(tmp_path / "build"))
    assert paper.name == "tides" and paper.batch.name == "batch.docx" and paper.unknown == ()
    assert rounds.register(tmp_path / "list", tmp_path / "paper.toml") and not rounds.register(tmp_path / "list", tmp_path / "paper.toml")
    assert rounds.registered(tmp_path / "list") == rounds.scan(tmp_path)
    code, rows = call(spark, "revision", "baseline", now, tmp_path / "truth")
    assert rows[0]["label"] == "proposal"  # refused: changes wait
    code, rows = call(spark, "revision", "baseline", then, tmp_path / "truth")
    assert rows[0]["doc"] == "a.docx" and len(rows[0]["sha256"]) == 64
    work = tmp_path / "work"
    call(spark, "revision", "baseline", then, work)
    call(spark, "revision", "promote", work, now, "--rescue", tmp_path / "build" / "rescue")
    assert call(spark, "revision", "ingest", work, tmp_path / "truth")[0] == 1
    assert len(call(spark, "revision", "rescues", tmp_path)[1]) == 1
    session = rounds.Session("x")
    session.mark("one")
    assert [n for n, _ in session.finish()] == ["one", "total"]
    rounds.record(spark, str(tmp_path / "ledger"), "promoted", {"n": 1})
    assert spark.read.json(str(tmp_path / "ledger")).first()["event"] == "promoted"
