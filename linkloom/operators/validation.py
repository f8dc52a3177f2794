"""Checks of id-list files: findings as rows, so they scale and can be queried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES = 5
FINDINGS = "rule string, severity string, n long, examples array<string>"


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line, value) file lines without the header, as (line, s1, ids, malformed).

    The first tab ends s1, which stays as it is; all after it is one list, cut at every comma,
    and blank ids stay ids. Only a list of blanks alone is empty. Lines without a tab are
    malformed, or skipped if blank.
    """
    cut = F.instr("value", "\t")
    rest = F.substring(F.col("value"), cut + 1, F.length("value"))
    none = F.array().cast("array<string>")
    return lines.filter((cut > 0) | F.col("value").rlike(r"(?U)\S")).select(
        "line",
        F.when(cut > 0, F.substring_index("value", "\t", 1)).otherwise(F.col("value")).alias("s1"),
        F.when((cut > 0) & rest.rlike(r"(?U)\S"), F.split(rest, ",", -1)).otherwise(none).alias("ids"),
        (cut == 0).alias("malformed"),
    )


def _finding(d: DataFrame, rule: str, what: Column, severity: str = "error") -> DataFrame:
    """One row for the distinct values of ``what``, or none; the least of them are examples."""
    per = d.select(what.alias("x")).filter("x is not null").distinct()
    top = per.orderBy("x").limit(EXAMPLES).agg(F.array_sort(F.collect_list("x")).cast("array<string>").alias("examples"))
    n = per.agg(F.count("*").alias("n")).filter("n > 0")
    return n.crossJoin(F.broadcast(top)).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "examples")  # one row each


def validate_lists(rows: DataFrame, required: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """Findings on parsed rows. ``required``: (s1); ``valid``: (id), checked if given.

    ``rows`` is read once for each rule, so it should be staged. Self-matches, wrong prefixes
    and unknown ids are reported by the offending id, the others by the row's s1 or line.
    """
    good = rows.filter("not malformed")
    seen = good.select("s1").distinct()
    ids = good.select(F.explode("ids").alias("id"))
    need = required.select(F.trim("s1").alias("s1")).distinct()
    out = [
        _finding(rows.filter("malformed"), "malformed", F.col("line")),
        _finding(good.groupBy("s1").count().filter("count > 1"), "duplicate_row", F.col("s1")),
        _finding(good.filter(F.size("ids") != F.size(F.array_distinct("ids"))), "duplicate_id", F.col("s1")),
        _finding(ids.filter(F.col("id").startswith("S1-")), "self_match", F.col("id")),
        _finding(ids.filter(~F.col("id").rlike("^S[123]-")), "bad_prefix", F.col("id")),
        _finding(need.join(seen, "s1", "left_anti"), "missing_row", F.col("s1")),
        _finding(seen.join(need, "s1", "left_anti"), "unexpected_row", F.col("s1")),
    ]
    if valid is not None:
        far = ids.filter(F.col("id").rlike("^S[23]-")).select("id").distinct()
        out.append(_finding(far.join(valid.select("id").distinct(), "id", "left_anti"), "unknown_id", F.col("id")))
    whole = out[0]
    for f in out[1:]:
        whole = whole.unionByName(f)
    return whole


def last_lists(rows: DataFrame) -> DataFrame:
    """(s1, ids): the list of each s1's last row."""
    return rows.filter("not malformed").groupBy("s1").agg(F.max_by("ids", "line").alias("ids"))


def validate_subset(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Warning for matches that aren't among a row's candidates; both are (s1, ids), one row an s1."""
    c = candidates.select("s1", F.col("ids").alias("cands"))
    j = matches.join(c, "s1", "left").filter(F.size(F.array_except("ids", F.coalesce("cands", F.array().cast("array<string>")))) > 0)
    return _finding(j, "not_candidate", F.col("s1"), "warning")


def row_stats(rows: DataFrame) -> DataFrame:
    good = rows.filter("not malformed")
    return good.agg(
        F.count("*").alias("total"), F.count_if(F.size("ids") == 0).alias("empty"), F.count_if(F.size("ids") > 0).alias("non_empty")
    )


def shown(n: int, examples: list[str]) -> str:
    """Examples as a reader sees them: all, or how many and the first."""
    text = ", ".join(examples)
    return text if n <= EXAMPLES else f"{n} total, e.g. {text}, ..."
