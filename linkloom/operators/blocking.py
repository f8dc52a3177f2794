"""Stage 2: capped blocking keys, probed by an equi-join and folded per record.

Posting lists are cut to their caps before the join, so no key, however common, meets more
than 20 targets; a record has at most 155 events, which one ``aggregate`` folds in the order
that early stopping needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.normalize import soundex, tokens

# Posting caps of the five rules, and the sizes below which rules 4 and 5 still add.
CAPS = {1: 20, 2: 15, 3: 10, 4: 5, 5: 5}
GATES = {4: 15, 5: 10}
LEAD = 4


def _words(d: DataFrame) -> Column:
    t = F.when(F.trim("name_tokens") != "", F.col("name_tokens")).otherwise(F.col("business_name_clean"))
    return tokens(t)


def _block(c: str = "country") -> Column:
    return F.upper(F.col(c))


def _target_keys(targets: DataFrame) -> DataFrame:
    """(block, rule, key, ord, pos, tid) for every index entry, from one pass over the targets."""
    kind = "struct<rule:int,pos:int,key:string>"
    entry = lambda rule, pos, key: F.struct(F.lit(rule).alias("rule"), pos.cast("int").alias("pos"), key.alias("key")).cast(kind)
    has = F.col("postal_code") != ""

    def of_word(w: Column, i: Column) -> Column:
        own = F.array(
            entry(1, i, F.when(has, F.concat_ws("_", "postal_code", w))),
            entry(2, i, w),
            entry(4, i, F.nullif(soundex(w), F.lit(""))),
            entry(5, i, F.substring(w, 1, 3)),
        )
        return F.when(F.length(w) >= 3, own).otherwise(F.array().cast(f"array<{kind}>"))

    by_word = F.flatten(F.transform(F.slice(_words(targets), 1, LEAD), of_word))
    by_postal = F.array(entry(3, F.lit(0), F.when(has, F.col("postal_code"))))
    keys = F.filter(F.concat(by_word, by_postal), lambda k: k["key"].isNotNull())
    return (
        targets.select("block", "ord", F.col("entity_id").alias("tid"), F.explode(keys).alias("k"))
        .select("block", "k.rule", "k.key", "ord", "k.pos", "tid")
    )


def postings(targets: DataFrame) -> DataFrame:
    """Index entries up to each rule's cap: (block, rule, key, rk, tid).

    ``targets``: normalised records with ``block`` and ``ord``, the file order.
    """
    w = Window.partitionBy("block", "rule", "key").orderBy("ord", "pos")
    cap = F.element_at(F.create_map(*(F.lit(x) for kv in CAPS.items() for x in kv)), F.col("rule"))
    # the literal bound lets Spark cut groups before the shuffle; each rule's own cap follows
    ranked = _target_keys(targets).withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= max(CAPS.values()))
    return ranked.filter(F.col("rk") <= cap).select("block", "rule", "key", "rk", "tid")


def _query_keys(s1: DataFrame) -> DataFrame:
    ws = _words(s1)
    many = lambda rule, xs, key: F.transform(
        xs, lambda x, i: F.struct(F.lit(rule).alias("rule"), i.alias("nth"), key(x).alias("key"))
    )
    has = F.col("postal_code") != ""
    none = F.array().cast("array<struct<rule:int,nth:int,key:string>>")
    long = lambda xs: F.transform(xs, lambda x: F.when(F.length(x) >= 3, x))
    keys = F.concat(
        F.when(has, many(1, F.slice("ws", 1, 4), lambda x: F.concat_ws("_", "postal_code", x))).otherwise(none),
        many(2, long(F.slice("ws", 1, 3)), lambda x: x),
        F.when(has, many(3, F.array("postal_code"), lambda x: x)).otherwise(none),
        many(4, F.slice("ws", 1, 2), soundex),
        many(5, long(F.slice("ws", 1, 2)), lambda x: F.substring(x, 1, 3)),
    )
    return (
        s1.withColumn("ws", ws)
        .select("entity_id", "ord", "block", F.explode(keys).alias("k"))
        .select("entity_id", "ord", "block", "k.*")
        .filter("key is not null")
    )


def fold(events: Column, top_k: int) -> Column:
    """Candidates of one record from its events, struct(rule, nth, rk, tid) in ascending order."""
    zero = F.struct(
        F.array().cast("array<string>").alias("c"),
        F.lit(0).alias("rule"),
        F.lit(-1).alias("nth"),
        F.lit(True).alias("go"),
        F.lit(True).alias("open"),
    )

    def step(a: Column, x: Column) -> Column:
        n = F.size(a["c"])
        gate = F.when(x["rule"] == 1, True)
        for rule in (2, 3, 4, 5):
            gate = gate.when(x["rule"] == rule, n < GATES.get(rule, top_k))
        go = F.when(x["rule"] != a["rule"], gate).otherwise(a["go"])
        fresh = (x["rule"] != a["rule"]) | (x["nth"] != a["nth"])
        open_ = F.when(fresh, True).otherwise(a["open"])
        c = F.when(go & open_, F.array_union(a["c"], F.array(x["tid"]))).otherwise(a["c"])
        full = (x["rule"] <= 3) & go & open_ & (F.size(c) >= top_k)
        return F.struct(
            c.alias("c"), x["rule"].alias("rule"), x["nth"].alias("nth"), go.alias("go"), (open_ & ~full).alias("open")
        )

    return F.aggregate(events, zero, step, lambda a: a["c"])


def generate_candidates(s1: DataFrame, targets: DataFrame, top_k: int = 30) -> DataFrame:
    """(source1_entity_id, candidates array) for every row of ``s1``.

    Both sides are normalised records with ``ord``. Records meet targets of their country; a
    country without targets meets all of them. Repeated ids share the last row's result. Both
    sides are read more than once, so they should be staged.
    """
    t = targets.withColumn("block", _block())
    q = s1.withColumn("block", _block())
    lands = t.select(F.col("block").alias("land")).distinct()  # as many rows as countries
    stray = q.select("block").distinct().join(lands, F.col("block") == F.col("land"), "left_anti")
    if not stray.isEmpty():
        q = q.join(lands, F.col("block") == F.col("land"), "left").withColumn("block", F.coalesce("land", F.lit("*"))).drop("land")
        t = t.withColumn("block", F.explode(F.array("block", F.lit("*"))))
    events = (
        _query_keys(q)
        .join(postings(t), ["block", "rule", "key"])
        .groupBy("entity_id", "ord")
        .agg(F.array_sort(F.collect_list(F.struct("rule", "nth", "rk", "tid"))).alias("ev"))
    )
    mine = F.filter(fold(F.col("ev"), top_k), lambda x: x.rlike("^S[23]-") & (x != F.col("entity_id")))
    found = events.select("entity_id", "ord", F.array_sort(mine).alias("candidates"))
    rows = s1.select("entity_id", "ord")
    last = (
        rows.join(found, ["entity_id", "ord"], "left")
        .groupBy("entity_id")
        .agg(F.max_by(F.coalesce("candidates", F.array().cast("array<string>")), "ord").alias("candidates"))
    )
    return rows.join(last, "entity_id").select(F.col("entity_id").alias("source1_entity_id"), "candidates")


def generate_candidate_pairs(s1: DataFrame, s2: DataFrame, s3: DataFrame, top_k: int = 30) -> DataFrame:
    """(source1_entity_id, candidate_entity_ids) as comma lists; targets go S2 before S3."""
    far = s2.select(F.lit(0).alias("src"), "*").unionByName(s3.select(F.lit(1).alias("src"), "*"))
    far = far.withColumn("ord", F.struct("src", "ord")).drop("src")
    own = generate_candidates(s1, far, top_k)
    return own.select("source1_entity_id", F.array_join("candidates", ",").alias("candidate_entity_ids"))


generate_candidates_by_country = generate_candidate_pairs


def evaluate_blocking_recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row, recall in percent: truth pairs that are among the candidates."""
    c = explode_pairs(candidates, "candidate_entity_ids").withColumn("hit", F.lit(1)).distinct()
    t = explode_pairs(truth, "matched_entity_ids").distinct()
    return t.join(c, ["s1", "cand"], "left").agg(
        (100.0 * F.count("hit") / F.greatest(F.count("*"), F.lit(1))).alias("recall")
    )


def explode_pairs(lists: DataFrame, column: str) -> DataFrame:
    """(s1, cand) pairs of comma lists; blanks are dropped."""
    return (
        lists.select(F.trim("source1_entity_id").alias("s1"), F.explode(F.split(F.coalesce(column, F.lit("")), ",")).alias("cand"))
        .select("s1", F.trim("cand").alias("cand"))
        .filter("cand <> '' and s1 <> ''")
    )
