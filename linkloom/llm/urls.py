"""URL filters by fixed rules and a path-template tree, in DataFrame functions only.

Template tree: a path is split into all its segments. Segments of digits, of hexadecimal or of
digits with a file suffix are variable by form and become ``{n}``, ``{h}`` or ``{n}.suffix``.
From the root down, the children of one parent and host, however many, are each compared with
their siblings: a labelled child whose share of bad labels doesn't differ significantly from
the share of all its siblings together becomes ``*``; others keep their names. An unlabelled
child shows no likeness of its own; it becomes ``*`` only where ``QUORUM`` or more labelled
siblings did, as their segment is then shown to vary without effect. Paths below a parent with
one path or without labels stay as they are.

A template is rejected when its share of bad labels reaches ``REJECT``, both by itself and
smoothed towards the share of the whole table; one without labels is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_spread, stage, unstage

Z, PRIOR, REJECT, QUORUM = 2.0, 10.0, 0.5, 5
#: Up to so many rules are inlined as one expression; more are joined by host and path, with the same result.
INLINE = 500


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.when(at > 0, ascii_lower(rest)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _split_rule(rule: str) -> tuple[str, str]:
    h, slash, p = rule.partition("/")
    return h.lower(), slash + p


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest of ``rules`` that fits, else null.

    ``rules``: (verdict, host/path). A rule fits its host and all its subdomains when the path
    starts with the rule's. Longest counts the whole rule; at equal rules block goes first.
    """
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    best: list[Column] = []
    for verdict, rule in rules:
        h, p = _split_rule(rule)
        fits_host = (host == h) | host.endswith("." + h) if h else F.lit(True)
        value = F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        best.append(F.when(fits_host & path.startswith(p), value).otherwise(none))
    return F.array_max(F.array(*best)) if best else none


def with_rules(pages: DataFrame, rules: list[tuple[str, str]], inline: int = INLINE) -> DataFrame:
    """Adds ``fit``, what ``rule_of`` says, to rows with host and path; any number of rules.

    Beyond ``inline`` rules every different (host, path) looks up each of its host's suffixes
    with its path's prefixes of the lengths that rules have, so rules and pages meet by equality.
    """
    if len(rules) <= inline:
        return pages.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    rows = [(*_split_rule(r), len(r), r, v) for v, r in rules]
    listed = pages.sparkSession.createDataFrame(rows, "h_ string, p_ string, size int, rule string, verdict string")
    best = listed.groupBy("h_", "p_").agg(F.max(F.struct("size", "rule", "verdict")).alias("fit"))
    sizes = F.array(*(F.lit(n) for n in sorted({len(r[1]) for r in rows})))
    own = pages.groupBy("host", "path").agg(F.count("*").alias("n"))
    dots = F.split("host", r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(dots)), lambda i: F.array_join(F.slice(dots, i, F.size(dots)), "."))
    probe = own.select("host", "path", F.explode(F.array_distinct(F.concat(ends, F.array(F.lit(""))))).alias("h_"))
    fits = F.filter(sizes, lambda n: n <= F.length("path"))
    probe = probe.select("host", "path", "h_", F.explode(F.transform(fits, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("p_"))
    found = probe.join(best, ["h_", "p_"]).groupBy("host", "path").agg(F.max("fit").alias("fit"))
    return join_spread(pages, own.join(found, ["host", "path"]), ["host", "path"], ["fit"], pages.count(), ["page_id"])


def _segments(path: Column) -> Column:
    typed = lambda s: (
        F.when(s.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(s.rlike(r"^[0-9]+\.[A-Za-z]{1,5}$"), F.concat(F.lit("{n}."), F.regexp_extract(s, r"\.(.*)$", 1)))
        .when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("{h}"))
        .otherwise(s)
    )
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    return F.transform(parts, typed)


def _pools(t: DataFrame) -> DataFrame:
    """(host, prefix, n, lab_all, bad_all) of each parent: its rows and their labels."""
    return t.groupBy("host", "prefix").agg(F.count("*").alias("n"), F.sum("lab").alias("lab_all"), F.sum("bad").alias("bad_all"))


def _level(t: DataFrame, d: int, total: int) -> DataFrame:
    """Generalise segment ``d`` of templates with the columns host, prefix, segs, lab, bad and their parents' lab_all, bad_all."""
    t = t.withColumn("seg", F.coalesce(F.get("segs", F.lit(d)), F.lit("")))
    met = t.groupBy("host", "prefix", "seg").agg(
        F.count("*").alias("paths"), *(F.sum(c).alias(c) for c in ("lab", "bad")), *(F.first(c).alias(c) for c in ("lab_all", "bad_all"))
    )
    lab, bad = F.col("lab"), F.col("bad")
    rest, rest_bad = F.col("lab_all") - lab, F.col("bad_all") - bad
    pooled = (F.col("bad_all") + 0.5) / (F.col("lab_all") + 1)
    noise = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(lab, F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
    gap = F.abs(bad / F.greatest(lab, F.lit(1)) - rest_bad / F.greatest(rest, F.lit(1)))
    met = met.withColumn("ends", F.col("seg") == "").withColumn("alike", ~F.col("ends") & (lab > 0) & (rest > 0) & (gap <= Z * noise))
    quorum = met.groupBy("host", "prefix").agg(F.count("*").alias("n"), (F.count_if("alike") >= QUORUM).alias("varies"))
    named = join_spread(met, quorum, ["host", "prefix"], ["varies"], total, ["seg"])
    joins = F.col("alike") | (~F.col("ends") & (lab == 0) & F.col("varies"))
    named = named.select("host", "prefix", "seg", F.col("paths").alias("n"), F.when(joins, F.lit("*")).otherwise(F.col("seg")).alias("to"))
    out = join_spread(t, named, ["host", "prefix", "seg"], ["to"], total, ["path_"])
    return out.select("host", "path_", "segs", "lab", "bad", F.concat("prefix", F.lit("/"), "to").alias("prefix"))


def _settle(t: DataFrame, d: int, total: int) -> DataFrame:
    """Add ``done`` and, where it is true, the whole template; segments before ``d`` are generalised.

    Done are ended paths, and those below a parent of one path or without labels: there nothing
    can be compared, so the segments left keep their names.
    """
    seen = join_spread(t, _pools(t).withColumn("fan", F.col("n")), ["host", "prefix"], ["fan", "lab_all", "bad_all"], total, ["path_"])
    still = (F.col("fan") == 1) | (F.col("lab_all") == 0)
    ended = F.size("segs") < d
    left = F.concat(F.slice("segs", d + 1, F.greatest(F.size("segs"), F.lit(1))), F.array(F.lit("")))
    whole = F.concat("prefix", F.lit("/"), F.array_join(left, "/"))
    name = F.when(~ended & still, whole).otherwise(F.col("prefix"))
    return seen.select("host", "path_", "segs", "lab", "bad", "lab_all", "bad_all", name.alias("prefix"), (ended | still).alias("done"))


def templates(pages: DataFrame, total: int) -> DataFrame:
    """(host, path_, n, template, judged) for each (host, typed path) of ``pages``, n its pages.

    ``pages`` has host, segs (typed segments), path_ (those joined) and bad (1, 0 or null), and
    at most ``total`` rows. Empty segments at the end of a path don't count.
    """
    t = pages.groupBy("host", "path_").agg(
        F.first("segs").alias("segs"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("*").alias("pages")
    )
    trimmed = F.split(F.regexp_replace(F.array_join("segs", "/"), "/+$", ""), "/", -1)
    t = t.withColumn("segs", F.filter(trimmed, lambda x, i: (i > 0) | (x != "") | (F.size(trimmed) > 1)))
    whole = stage(t.withColumn("prefix", F.lit("")), "paths")  # each level reads the one before several times
    parts: list[DataFrame] = []
    t, d = whole.drop("pages"), 0
    while True:
        settled = stage(_settle(t, d, total), "settled")
        if d:
            unstage(last)
        parts.append(settled.filter("done").drop("done", "segs", "lab_all", "bad_all"))
        going = settled.filter("not done").drop("done")
        if going.isEmpty():
            break
        t, d = stage(_level(going, d, total), "level"), d + 1
        last = t
    t = parts[0]
    for x in parts[1:]:
        t = t.union(x)
    sums = t.groupBy("host", "prefix").agg(F.count("*").alias("n"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    base = t.agg((F.sum("bad") / F.greatest(F.sum("lab"), F.lit(1))).alias("base"))
    smooth = (F.col("bad") + PRIOR * F.coalesce("base", F.lit(0.0))) / (F.col("lab") + PRIOR)
    reject = (F.col("lab") > 0) & (F.col("bad") >= REJECT * F.col("lab")) & (smooth >= REJECT)
    judged = sums.crossJoin(F.broadcast(base)).select(  # one row
        "host", "prefix", "n", F.when(reject, F.lit("block")).otherwise(F.lit("allow")).alias("judged")
    )
    out = join_spread(t, judged, ["host", "prefix"], ["judged"], total, ["path_"])
    out = out.select("host", "path_", F.col("prefix").alias("template"), "judged")
    return out.join(whole.select("host", "path_", F.col("pages").alias("n")), ["host", "path_"])


def judge(pages: DataFrame, labels: DataFrame | None, rules: list[tuple[str, str]], inline: int = INLINE) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) for each row of ``pages``.

    ``labels``: (page_id, bad) with bad 1 or 0, or None; a page with several counts as bad by
    their largest. Pages that a rule decides are labelled by it. A null url, or one without
    ``://``, has an empty host and path. A null page_id has no label of its own; repeated rows
    stay repeated; other columns are ignored; an empty table gives no rows.
    """
    p = (
        pages.select("page_id", F.col("url").cast("string").alias("url"))
        .select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "page_id")
    )
    p = with_rules(p, rules, inline).withColumn("segs", _segments(F.col("path"))).withColumn("path_", F.array_join("segs", "/"))
    bad = F.when(F.col("fit")["verdict"] == "block", 1).when(F.col("fit").isNotNull(), 0)
    seen = p
    if labels is not None:
        known = labels.groupBy(F.col("page_id").alias("id_")).agg(F.max("bad").cast("int").alias("bad_"))
        seen, bad = p.join(known, p.page_id == known.id_, "left"), F.coalesce(bad, "bad_")
    total = pages.count()
    t = templates(seen.withColumn("bad", bad).select("host", "segs", "path_", "bad"), total)
    return join_spread(p, t, ["host", "path_"], ["template", "judged"], total, ["page_id"]).select(
        "page_id",
        "host",
        "path",
        F.col("fit")["rule"].alias("rule"),
        F.coalesce(F.col("fit")["verdict"], "judged").alias("verdict"),
        "template",
    )
