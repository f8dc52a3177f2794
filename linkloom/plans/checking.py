"""The validator over files: header and encoding checks, then the rules as queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import validation
from linkloom.session import stage, unstage
from linkloom.sources import tsv

# The headers of the two files, and the names of the sources' files.
MATCHING = ["source1_entity_id", "matched_entity_ids"]
CANDIDATE = ["source1_entity_id", "candidate_entity_ids"]
SOURCE = "test_source{}.tsv"


@dataclass
class Report:
    """Errors and warnings as texts, findings as (file, rule, severity, n, examples), statistics by file."""

    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    findings: list[tuple[str, str, str, int, list[str]]] = field(default_factory=list)
    stats: dict[str, dict[str, int]] = field(default_factory=dict)

    @property
    def passed(self) -> bool:
        return not self.errors

    def add(self, name: str, found: DataFrame) -> None:
        for f in found.collect():  # one row for each rule at most
            self.findings.append((name, f["rule"], f["severity"], f["n"], f["examples"]))
            text = f"{name}: {f['rule']}: {validation.shown(f['n'], f['examples'])}"
            (self.errors if f["severity"] == "error" else self.warnings).append(text)


def _header_fault(first: list[str], want: list[str]) -> str | None:
    """What is wrong with the first lines of a file's parts."""
    for line in first:
        cols = [c.strip().lower() for c in line.split("\t")]
        if "\t" not in line and "," in line:
            return "comma_separated: the header has commas and no tab"
        if cols != want:
            return f"bad_header: {cols} instead of {want}"
    return None


def check_file(spark: SparkSession, path: str, header: list[str], need: DataFrame, valid: DataFrame | None, report: Report) -> DataFrame | None:
    """Add the findings of one file, or of a folder of parts with a header each, to ``report``.

    Returns its parsed rows, staged, or None if it is missing, empty, not UTF-8 or has another header.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if not tsv.present(spark, path):
        report.errors.append(f"{name}: missing_file: {path}")
        return None
    lines = stage(tsv.read_lines(spark, path), "lines")
    if lines.isEmpty():
        report.errors.append(f"{name}: empty_file")
        unstage(lines)
        return None
    if not lines.filter(~F.is_valid_utf8("value")).isEmpty():
        report.errors.append(f"{name}: not_utf8: the file isn't UTF-8 text")
        unstage(lines)
        return None
    whole = tsv.numbered(lines)
    fault = _header_fault([r[0] for r in whole.filter("line = 1").select("value").distinct().limit(100).collect()], header)
    if fault:
        report.errors.append(f"{name}: {fault}")
        unstage(lines)
        return None
    rows = stage(validation.parse_lines(whole.filter("line > 1")), "rows")
    unstage(lines)
    report.add(name, validation.validate_lists(rows, need, valid))
    report.stats[name] = validation.row_stats(rows).first().asDict()
    return rows


def validate(spark: SparkSession, matching: str, candidate: str | None, test_dir: str, check_ids: bool = False) -> Report:
    """All checks of a matching file, of a candidate file if there is one, and of both together."""
    report = Report()
    paths = [f"{test_dir}/{SOURCE.format(k)}" for k in (1, 2, 3)]
    if not tsv.present(spark, paths[0]):
        report.errors.append(f"missing_file: {paths[0]}")
        return report
    need = stage(tsv.read_ids(spark, paths[0]).withColumnRenamed("id", "s1"), "need")
    valid = None
    if not check_ids:
        report.warnings.append("ids_unchecked: whether ids exist isn't checked unless asked for")
    elif gone := next((p for p in paths[1:] if not tsv.present(spark, p)), None):
        report.warnings.append(f"ids_unchecked: {gone} is missing, so whether ids exist isn't checked")
    else:
        valid = stage(tsv.read_ids(spark, paths[1]).union(tsv.read_ids(spark, paths[2])).distinct(), "valid")
    rows = check_file(spark, matching, MATCHING, need, valid, report)
    cands = None
    if candidate and tsv.present(spark, candidate):
        cands = check_file(spark, candidate, CANDIDATE, need, valid, report)
    elif candidate:
        report.warnings.append(f"no_candidates: {candidate} is missing, so it isn't checked")
    if rows is not None and cands is not None:
        name = matching.rstrip("/").rsplit("/", 1)[-1]
        report.add(name, validation.validate_subset(validation.last_lists(rows), validation.last_lists(cands)))
    for done in (rows, cands, need, valid):
        if done is not None:
            unstage(done)
    return report
