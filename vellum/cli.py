"""Commands over a folder of packages: each reads what it needs, prints rows as JSON lines, and says by its exit code whether there is something to mend.

``python -m vellum.cli <command> <path> [...]``.  0: nothing found, 1: findings, 2: can't be done here, 4: stale.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Command = Callable[[SparkSession, argparse.Namespace], "DataFrame | None"]
COMMANDS: dict[str, tuple[Command, str, tuple[tuple, ...], bool]] = {}
#: Commands that need a word processor or a renderer.
ELSEWHERE = ("locate", "verify", "compare-probe", "pdf", "render-diff", "revision build", "revision ship")


def command(name: str, said: str, *options: tuple, finds: bool = False) -> Callable[[Command], Command]:
    """Register a command; with ``finds`` any row makes its exit code 1."""

    def put(function: Command) -> Command:
        COMMANDS[name] = (function, said, options, finds)
        return function

    return put


def read(spark: SparkSession, path: str) -> DataFrame:
    from vellum.sources.packages import read_parts

    return read_parts(spark, path).where("part IS NOT NULL")


def files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("doc"), "content")


def by_name(parts: DataFrame) -> DataFrame:
    """Documents by their file's name, so that two folders meet."""
    return parts.withColumn("doc", F.regexp_extract("doc", r"([^/]+)$", 1))


def write(parts: DataFrame, before: DataFrame, options: argparse.Namespace) -> DataFrame:
    """The report of a save where ``--write`` names a folder, else of what would be written."""
    from vellum.sources import containers

    numbered = parts.join(before.select(F.col("doc").alias("_d"), F.col("part").alias("_p"), "ord"), (F.col("doc") == F.col("_d")) & (F.col("part") == F.col("_p"))).drop("_d", "_p") if "ord" not in parts.columns else parts
    return containers.save(numbered, before, options.write) if options.write else containers.save_report(before, numbered)


OTHER = (("other",), {"help": "the folder to compare with"})
WRITE = (("--write",), {"help": "a folder to write the changed packages to; without it nothing is written"})


@command("compare", "differences of two folders of packages, layer by layer", OTHER, finds=True)
def compare_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import compare

    return compare.compare_packages(by_name(read(spark, o.path)), by_name(read(spark, o.other)))


@command("citations", "audit of citation links", (("--later",), {"action": "store_true"}), finds=True)
def citations_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import linkage

    return linkage.audit_links(read(spark, o.path), o.later)


@command("link", "link citations with their entries, and back", WRITE, (("--all",), {"action": "store_true"}))
def link_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import linkage

    parts = read(spark, o.path)
    return write(linkage.apply_plan(parts, linkage.link_plan(parts, o.all)), parts, o) if o.write else linkage.link_plan(parts, o.all)


@command("linkfix", "repairs of what the audit of links finds", finds=True)
def linkfix_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import linkage

    return linkage.repair_plan(linkage.audit_links(read(spark, o.path)))


@command("refstyle", "format of citations and entries", finds=True)
def refstyle_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import audits, linkage

    paras = linkage.paragraphs(read(spark, o.path))
    listed = linkage.entries(paras)
    moved = audits.entry_order(listed).select("doc", "pos", F.lit("order").alias("finding"), F.col("place").cast("string").alias("subject"))
    return audits.prose_style(paras).unionByName(audits.entry_style(listed)).unionByName(moved)


@command("crossrefs", "link exhibits with their first mention, and back", WRITE, (("--all",), {"action": "store_true"}), (("--audit",), {"action": "store_true"}))
def crossrefs_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import linkage

    parts = read(spark, o.path)
    if o.audit:
        return linkage.exhibit_audit(parts)
    plan = linkage.exhibit_plan(parts, o.all)
    return write(linkage.apply_plan(parts, plan), parts, o) if o.write else plan


@command("sections", "section numbers and every mention of them", finds=True)
def sections_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import numbering

    return numbering.section_audit(read(spark, o.path))


@command("inspect", "a summary of structure")
def inspect_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import gates

    parts = read(spark, o.path)
    return gates.structure_counts(parts).groupBy("doc").pivot("tag", list(gates.CARRIERS)).agg(F.first("n")).join(gates.package_counts(parts), "doc", "left")


@command("sites", "what stands where an edit is to be made", (("sign",), {}))
def sites_(spark, o):  # noqa: ANN001, ANN202
    from vellum.functions import locating
    from vellum.functions.text import visible_text
    from vellum.operators import documents

    return locating.site(documents.paragraphs_of(read(spark, o.path)).withColumn("text", visible_text(F.col("xml"))), F.lit(o.sign))


@command("snapshot", "a manuscript as numbered text")
def snapshot_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import documents, snapshots

    return snapshots.numbered(documents.blocks(read(spark, o.path)))


@command("anchors", "a protocol's anchors, each to be there once", (("spec",), {"help": "a file of anchors, one a line: scope, tab, text"}))
def anchors_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import documents, snapshots

    places = snapshots.numbered(documents.blocks(read(spark, o.path)))
    spec = snapshots.read_spec(spark, o.spec)
    return snapshots.resolve(places, places.select("doc").distinct().crossJoin(F.broadcast(spec))).where("verdict <> 'found'")


@command("api", "what there is, by subject", (("subject",), {"nargs": "?", "default": ""}))
def api_(spark, o):  # noqa: ANN001, ANN202
    import ast

    rows = []
    for file in sorted(Path(__file__).parent.rglob("*.py")):
        if "llm" in file.parts or "plans" in file.parts:
            continue
        for node in ast.parse(file.read_text(encoding="utf-8")).body:
            if isinstance(node, ast.FunctionDef) and not node.name.startswith("_"):
                first = (ast.get_docstring(node) or "").split("\n")[0]
                if o.subject.lower() in f"{node.name} {first}".lower():
                    rows.append((str(file.relative_to(Path(__file__).parent)), node.name, first))
    return spark.createDataFrame(rows, "module string, name string, said string")


@command("text", "the visible text, on one side of the changes", (("--view",), {"choices": ("final", "original"), "default": "final"}))
def text_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import documents

    return documents.blocks(read(spark, o.path), o.view).where("trim(text) <> ''").select("doc", "pos", "text")


@command("tasks", "remarks that aren't done", finds=True)
def tasks_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import apparatus

    return apparatus.threads(read(spark, o.path)).where("NOT done")


@command("count", "words by bucket", (("--exclude",), {"nargs": "*", "default": []}))
def count_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import documents

    parts = read(spark, o.path)
    found = documents.word_counts(documents.blocks(parts), documents.notes(parts))
    names = [c for c in found.columns if c != "doc" and c not in o.exclude]
    return found.withColumn("total", sum((F.col(n) for n in names), F.lit(0)))


@command("probe", "the shape of a manuscript")
def probe_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import rounds

    return rounds.probe(read(spark, o.path))


@command("lint", "structural faults", finds=True)
def lint_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import documents

    return documents.lint(read(spark, o.path))


@command("math", "equations that stand alone and what they say")
def math_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import documents

    return documents.blocks(read(spark, o.path)).where("maths <> ''").select("doc", "pos", "maths", "display")


@command("footnotes", "the size that notes agree on, and which don't", finds=True)
def footnotes_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import apparatus

    return apparatus.note_sizes(read(spark, o.path))


@command("figures", "figures and their descriptions", (("--check",), {"action": "store_true"}))
def figures_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import apparatus

    found = apparatus.alt_texts(read(spark, o.path))
    return found.where("missing") if o.check else found


@command("smarten", "straight quotes made curly where that is safe", WRITE)
def smarten_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import house

    parts = read(spark, o.path)
    return write(house.smarten_parts(parts), parts, o)


@command("house", "captions, notes and equations against the house's typography", finds=True)
def house_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import house

    return house.audit(read(spark, o.path))


@command("authors", "who is credited; --set credits another", (("--set",), {"dest": "name"}), (("--initials",), {"default": ""}), WRITE)
def authors_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import gates

    parts = read(spark, o.path)
    return write(gates.set_author(parts, o.name, o.initials), parts, o) if o.name else gates.read_authors(parts)


@command("pages", "printed page numbers that jump or start anew; needs a table of sheets", (("sheets",), {"help": "a table (doc, sheet, printed)"}), finds=True)
def pages_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import windows

    return windows.numbering_breaks(spark.read.parquet(o.sheets), "doc", "sheet", "printed")


@command("repack", "sheets mostly empty, and the exhibit behind; needs a table of sheets", (("sheets",), {"help": "a table (doc, sheet, chars, exhibit)"}), finds=True)
def repack_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import windows

    sheets = spark.read.parquet(o.sheets)
    return windows.blamed(windows.underfilled(sheets), sheets.where("exhibit").select("doc", F.col("sheet").alias("exhibit"), F.col("sheet").alias("first")))


@command("fit", "exhibits that a page break may part", finds=True)
def fit_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import numbering

    return numbering.fit_audit(read(spark, o.path))


TRUTH = (("truth",), {"help": "the folder of accepted packages"})


@command("revision status", "truth or proposal", TRUTH)
def status_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import rounds

    recorded = by_name(files(spark, o.truth)).select("doc", F.sha2("content", 256).alias("sha256"))
    return rounds.status(by_name(read(spark, o.path)), by_name(files(spark, o.path)), recorded)


@command("revision survey", "every paper at once, the worst first", TRUTH)
def survey_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import rounds

    return rounds.survey(status_(spark, o)).orderBy("rank", "doc")


@command("revision ingest", "what the author changed since the truth", TRUTH, finds=True)
def ingest_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import rounds

    return rounds.ingest(by_name(read(spark, o.truth)), by_name(read(spark, o.path)))


@command("revision validate", "the ladder of gates", TRUTH, (("--clean",), {"help": "the folder of clean copies"}))
def validate_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import rounds

    clean = by_name(read(spark, o.clean)) if o.clean else None
    return rounds.outcome(rounds.validate(by_name(read(spark, o.path)), by_name(read(spark, o.truth)), clean))


def _copy(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Packages copied, and stamped with what they hold."""
    from vellum.sources import containers

    target_path = Path(target)
    target_path.mkdir(parents=True, exist_ok=True)
    for row in files(spark, source).toLocalIterator():
        name = row["doc"].rsplit("/", 1)[-1]
        passing = target_path / f".{name}.part"
        passing.write_bytes(bytes(row["content"]))
        passing.replace(target_path / name)
    return containers.stamp(by_name(files(spark, target)))


@command("revision promote", "validated batches put in the manuscripts' place; what was there is kept as a rescue", (("batch",), {}), (("--rescue",), {"required": True}))
def promote_(spark, o):  # noqa: ANN001, ANN202
    _copy(spark, o.path, o.rescue)
    return _copy(spark, o.batch, o.path)


@command("revision withdraw", "manuscripts put back from their rescues where nobody changed them since", (("rescue",), {}), (("stamps",), {}))
def withdraw_(spark, o):  # noqa: ANN001, ANN202
    from vellum.sources import containers

    edited = containers.check_stamps(by_name(files(spark, o.path)), spark.read.json(o.stamps, containers.STAMP)).where("edited")
    return edited if not edited.isEmpty() else _copy(spark, o.rescue, o.path)


@command("revision restamp", "stamps that follow a tool's repair", (("stamps",), {}), (("why",), {}))
def restamp_(spark, o):  # noqa: ANN001, ANN202
    from vellum.sources import containers

    return containers.restamp(spark.read.json(o.stamps, containers.STAMP), by_name(files(spark, o.path)), o.why)


@command("revision baseline", "the manuscripts recorded as the new truth", (("truth",), {}))
def baseline_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import rounds

    pending = rounds.state(by_name(read(spark, o.path))).where("NOT is_truth")
    return pending if not pending.isEmpty() else _copy(spark, o.path, o.truth)


def _kept(spark: SparkSession, path: str, kind: str) -> DataFrame:
    from vellum.operators import rounds

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    return rounds.kept_files(found, kind)


@command("revision redlines", "the kept redlines, oldest first")
def redlines_(spark, o):  # noqa: ANN001, ANN202
    return _kept(spark, o.path, "redlines")


@command("revision rescues", "the kept rescues, oldest first")
def rescues_(spark, o):  # noqa: ANN001, ANN202
    return _kept(spark, o.path, "rescue")


@command("revision doctor", "lines of a project that name another manuscript", finds=True)
def doctor_(spark, o):  # noqa: ANN001, ANN202
    from vellum.operators import rounds

    config = rounds.find_config(Path(o.path))
    if config is None:
        raise SystemExit("no paper.toml here")
    paper = rounds.load_paper(config)
    said = spark.read.option("wholetext", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{py,toml,md,sh}").text(str(paper.root)).select(F.lit(paper.name).alias("project"), F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rounds.doctor(said, spark.createDataFrame([(paper.name, str(paper.manuscript))], "project string, manuscript string"))


@command("revision init", "the layout round a manuscript", (("name",), {}))
@command("init", "the layout round a manuscript", (("name",), {}))
def init_(spark, o):  # noqa: ANN001, ANN202
    root = Path(o.path)
    for folder in ("build/redlines", "build/rescue"):
        (root / folder).mkdir(parents=True, exist_ok=True)
    config = root / "paper.toml"
    if not config.exists():
        config.write_text(f'[paper]\nname = "{o.name}"\nmanuscript = "working.docx"\nprev = "prev.docx"\nbuild = "build"\n', encoding="utf-8")
    return None


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="vellum", description=__doc__)
    subs = parser.add_subparsers(dest="command", required=True)
    groups: dict[str, argparse._SubParsersAction] = {}
    for name, (_, said, options, _) in sorted(COMMANDS.items()):
        head, _, tail = name.partition(" ")
        if tail and head not in groups:
            groups[head] = subs.add_parser(head, help="the protocol of rounds").add_subparsers(dest="sub", required=True)
        own = groups[head].add_parser(tail, help=said) if tail else subs.add_parser(name, help=said)
        own.add_argument("path", help="a folder of packages")
        for flags, settings in options:
            own.add_argument(*flags, **settings)
        own.add_argument("--limit", type=int, default=1000, help="rows to print; all count")
    return parser


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:  # noqa: ANN001
    given = list(sys.argv[1:] if arguments is None else arguments)
    if given and (given[0] in ELSEWHERE or " ".join(given[:2]) in ELSEWHERE):
        print("this needs a word processor or a renderer, which there is none of here", file=sys.stderr)
        return 2
    options = build_parser().parse_args(given)
    name = f"{options.command} {options.sub}" if getattr(options, "sub", None) else options.command
    function, _, _, finds = COMMANDS[name]
    spark = spark or SparkSession.builder.getOrCreate()
    found = function(spark, options)
    if found is None:
        return 0
    out = sys.stdout if out is None else out
    rows = found.limit(options.limit).collect()
    for row in rows:
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str), file=out)
    if "exit_code" in found.columns:
        return max((r["exit_code"] for r in rows), default=0)
    return int(finds and bool(rows))


if __name__ == "__main__":
    sys.exit(main())
