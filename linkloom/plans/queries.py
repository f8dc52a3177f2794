"""Queries over the test tables, one or more for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.functions import similarity as S
from linkloom.operators import blocking, evaluation, features, training, validation
from linkloom.session import stage
from linkloom.sources import synthetic, tsv

from . import fixture, resolution, sqlgen

TOP_K = 30


def _norm(spark: SparkSession, d: str) -> DataFrame:
    """Normalised records, written and read back as the pipeline does between its steps."""
    return stage(fixture.entities(spark, d), "normalized")


def sanitize_text(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", N.sanitize_text(F.col("text")).alias("clean"))


def clean_business_name(spark: SparkSession, d: str) -> DataFrame:
    return _norm(spark, d).select("entity_id", "business_name_clean")


def clean_address(spark: SparkSession, d: str) -> DataFrame:
    return _norm(spark, d).select("entity_id", "business_address_clean")


def postal_code(spark: SparkSession, d: str) -> DataFrame:
    return _norm(spark, d).select("entity_id", "country", "postal_code")


def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _norm(spark, d).select("entity_id", "name_tokens")


def normalized_records(spark: SparkSession, d: str) -> DataFrame:
    return _norm(spark, d).drop("ord")


def latest_records(spark: SparkSession, d: str) -> DataFrame:
    """Keyed lookup over two loads of the records; the later record of an id wins."""
    e = _norm(spark, d)
    again = e.filter("ord % 7 = 0").withColumns({"postal_code": F.lit("00001"), "ord": F.col("ord") + 1_000_000_000})
    return features.latest(e.unionByName(again)).select("entity_id", "business_name_clean", "postal_code")


def soundex_codes(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    w = docs.select(F.explode(N.tokens(N.sanitize_text(F.col("text")))).alias("word")).distinct()
    return w.select("word", N.soundex(F.col("word")).alias("code"))


def blocking_postings(spark: SparkSession, d: str) -> DataFrame:
    t = _norm(spark, d).filter("entity_id not like 'S1-%'").withColumn("block", F.upper("country"))
    t = t.withColumn("ord", F.struct(F.substring("entity_id", 1, 2).alias("src"), "ord"))
    return blocking.postings(t)


def _lists(e: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Candidate lists of normalised records, staged as the pipeline does."""
    out = blocking.generate_candidate_pairs(*(fixture.source(e, k) for k in (1, 2, 3)), top_k=top_k)
    return stage(out, "candidates")


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _lists(_norm(spark, d))


def candidate_pairs_top5(spark: SparkSession, d: str) -> DataFrame:
    return _lists(_norm(spark, d), 5)


def candidates_other_country(spark: SparkSession, d: str) -> DataFrame:
    """Records of a country without targets meet all targets."""
    away = F.col("entity_id").startswith("S1-") & (F.col("country") == "France")
    e = _norm(spark, d).withColumn("country", F.when(away, "Atlantis").otherwise(F.col("country")))
    return blocking.generate_candidate_pairs(*(fixture.source(e, k) for k in (1, 2, 3)), top_k=TOP_K)


def candidate_pair_rows(spark: SparkSession, d: str) -> DataFrame:
    return blocking.explode_pairs(_lists(_norm(spark, d)), "candidate_entity_ids")


def _truth(e: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids, ord): same first words of name and same address."""
    key = lambda x: x.withColumn("k", F.concat_ws("|", "business_address_clean", "country"))
    far = key(e.filter("entity_id not like 'S1-%'")).groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("ids"))
    return key(fixture.source(e, 1)).join(far, "k", "left").select(
        F.col("entity_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"), "ord"
    )


def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    t = tsv.truth_lists(_truth(_norm(spark, d)))
    return t.select("s1", F.array_join(F.array_sort("ids"), ",").alias("ids"), F.size("ids").cast("long").alias("n"))


def blocking_recall(spark: SparkSession, d: str) -> DataFrame:
    e = _norm(spark, d)
    return blocking.evaluate_blocking_recall(_lists(e), _truth(e))


def _pairs(e: DataFrame) -> DataFrame:
    return blocking.explode_pairs(_lists(e), "candidate_entity_ids").distinct()


def pair_features(spark: SparkSession, d: str) -> DataFrame:
    e = _norm(spark, d)
    f = features.extract_features(_pairs(e), e)
    return f.select("s1", "cand", *(F.round(c, 6).alias(c) for c in features.FEATURES))


def pair_features_sql(spark: SparkSession, d: str) -> DataFrame:
    """Those features that SQL can express."""
    return pair_features(spark, d).select("s1", "cand", "name_levenshtein_ratio", "name_jaro_winkler", "address_levenshtein_ratio", "address_jaro_winkler", "exact_zip_match")


def pair_feature_map(spark: SparkSession, d: str) -> DataFrame:
    e = _norm(spark, d)
    return features.as_map(features.extract_features(_pairs(e), e)).select(
        "s1", "cand", F.size("features").cast("long").alias("n"), F.col("features")["exact_zip_match"].cast("double").alias("zip")
    )


def zip_fields(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    raw = F.concat(F.col("o_orderkey").cast("string"), F.get(F.array(*(F.lit(x) for x in (".0", "-001", " 12", ""))), (F.col("o_orderkey") % 4).cast("int")))
    return o.select("o_orderkey", S.zip_field(raw).alias("zip"))


def alias_fields(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 == 0, "N/A").when(F.col("c_custkey") % 3 == 1, " Nil ").otherwise(F.col("c_name")).alias("clean_name"), F.col("c_name").alias("name")
    )
    return c.select("c_custkey", S.field(c.columns, "name").alias("name"))


def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = _norm(spark, d)
    t = tsv.truth_lists(_truth(e)).select("s1", F.explode("ids").alias("cand"))
    return training.label_pairs(_pairs(e), t)


def negative_sample(spark: SparkSession, d: str) -> DataFrame:
    return training.sample_negatives(label_pairs(spark, d))


def capped_training_pairs(spark: SparkSession, d: str) -> DataFrame:
    return training.cap_pairs(training.sample_negatives(label_pairs(spark, d)), 500)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars")
    lab = spark.read.parquet(f"{d}/labels.parquet")
    p = ((F.col("n_chars") * 37) % 1000) / 1000.0 * 0.5 + F.col("quality") * 0.35
    return lab.join(docs, "doc_id").select(F.concat(F.lit("S1-"), (F.col("doc_id") % 50).cast("string")).alias("s1"), F.col("quality").alias("y"), p.alias("p"))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    s = evaluation.threshold_sweep(_scored(spark, d))
    return s.select("step", F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f05")))


def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.best_threshold(evaluation.threshold_sweep(_scored(spark, d))).select(F.round("threshold", 6).alias("threshold"), F.round("f05", 9).alias("f05"))


def top_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.top_thresholds(evaluation.threshold_sweep(_scored(spark, d))).select("step", F.round("f05", 9).alias("f05"))


def legacy_threshold(spark: SparkSession, d: str) -> DataFrame:
    s = evaluation.threshold_sweep(_scored(spark, d), evaluation.LEGACY_SWEEP)
    return evaluation.best_threshold(s).select(F.round("threshold", 6).alias("threshold"), F.round("f05", 9).alias("f05"))


def macro_threshold(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.macro_threshold(_scored(spark, d)).select(F.round("threshold", 6).alias("threshold"), F.round("f05", 9).alias("f05"))


def macro_f05(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    return evaluation.macro_f05(s).select(F.round("macro_f05", 9).alias("macro_f05"))


def _predicted(e: DataFrame, lists: DataFrame) -> DataFrame:
    """(s1, ids) by a fixed linear score of native features, which SQL can state as well."""
    pairs = blocking.explode_pairs(lists, "candidate_entity_ids").distinct()
    j = features.join_records(pairs, e)
    s = 0.6 * S.levenshtein_ratio(F.col("s1_name"), F.col("cand_name")) + 0.4 * S.levenshtein_ratio(F.col("s1_address"), F.col("cand_address"))
    return training.as_lists(j.withColumn("p", s).filter(F.col("p") >= 0.7).select("s1", "cand"))


def predict_matches(spark: SparkSession, d: str) -> DataFrame:
    e = _norm(spark, d)
    return _predicted(e, _lists(e)).select("s1", F.array_join("ids", ",").alias("ids"))


def matching_table(spark: SparkSession, d: str) -> DataFrame:
    e = _norm(spark, d)
    lists = _lists(e)
    return evaluation.assemble_matches(lists, _predicted(e, lists))


def matching_table_legacy(spark: SparkSession, d: str) -> DataFrame:
    """Without the rule on prefixes and own ids: lists that also hold the row's own id and one of source 1."""
    e = _norm(spark, d)
    own = F.concat_ws(",", "source1_entity_id", "candidate_entity_ids", F.lit("S1-0"))
    lists = _lists(e).withColumn("candidate_entity_ids", own)
    ids = F.filter(F.split("candidate_entity_ids", ","), lambda x: x != "")
    return evaluation.assemble_matches(lists, lists.select(F.col("source1_entity_id").alias("s1"), ids.alias("ids")), check_ids=False)


def matching_stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.match_stats(matching_table(spark, d))


def _scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    out = evaluation.evaluate_predictions(predicted, truth)
    return out.select(*(F.round(c, 9).alias(c) for c in ("macro_f05", "micro_precision", "micro_recall", "micro_f05")), "tp", "fp", "fn")


def evaluate_predictions(spark: SparkSession, d: str) -> DataFrame:
    e = _norm(spark, d)
    return _scores(_predicted(e, _lists(e)), tsv.truth_lists(_truth(e)))


def skipped_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose records are missing: of every seventh record only the candidate's side is known."""
    e = _norm(spark, d)
    return features.skipped_pairs(_pairs(e), e.filter("ord % 7 <> 0"))


def _resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, candidate lists and (s1, ids) by trees trained on the labelled pairs, at production settings."""
    e = _norm(spark, d)
    lists = _lists(e)
    truth = tsv.truth_lists(_truth(e))
    joined = features.join_records(blocking.explode_pairs(lists, "candidate_entity_ids").distinct(), e)
    every = stage(features.with_features(joined), "features")  # features of a pair serve training and prediction
    known = truth.select("s1", F.explode("ids").alias("cand"))
    rows = training.sample_negatives(training.label_pairs(every, known))
    trained = training.train_model(rows)
    return e, lists, training.as_lists(training.predict_pairs(every, trained))


def resolve(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: normalise, block, extract nine features, train the trees, predict all pairs and assemble."""
    _, lists, got = _resolved(spark, d)
    return evaluation.assemble_matches(lists, got)


def resolve_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the flagship's predictions against the truth."""
    e, _, got = _resolved(spark, d)
    return _scores(got, tsv.truth_lists(_truth(e)))


def training_set(spark: SparkSession, d: str) -> DataFrame:
    """Labelled pairs with their features, as the trees are trained on."""
    e = _norm(spark, d)
    rows = resolution.build_training_set(_lists(e), e, tsv.truth_lists(_truth(e)))
    return rows.select("s1", "cand", "label", *(F.round(c, 6).alias(c) for c in features.FEATURES))


def training_labels(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of the training set, their labels and what SQL can say of their features."""
    return training_set(spark, d).select("s1", "cand", "label", "name_levenshtein_ratio", "exact_zip_match")


def _faulty_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a list file with every fault, from the documents' ids."""
    i = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("i"))
    s = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    n = F.col("i")
    value = (
        F.when(n % 11 == 3, s("S1-", n))
        .when(n % 11 == 4, s("S1-", n, "\tS2-", n, ",S2-", n))
        .when(n % 11 == 5, s("S1-", n, "\tS1-", n, ",S3-", n))
        .when(n % 11 == 6, s("S1-", n, "\tX", n))
        .when(n % 11 == 7, s("S1-", n - n % 2, "\tS2-", n))
        .when(n % 11 == 8, s("S1-", n, "\t "))
        .when(n % 11 == 9, F.when(n % 2 == 0, F.lit("")).otherwise(s("S1-", n, "\tS2-", n, "\tS3-", n)))
        .when(n % 11 == 10, s("S1-", n, "\tS2-", n, ",,S3-", n))
        .otherwise(s("S1-", n, "\tS2-", n, ",S3-", n + 1))
    )
    return i.select((n + 2).alias("line"), value.alias("value"))


def validate_lists(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    need = docs.filter("doc_id % 10 <> 1").select(F.concat(F.lit("S1-"), F.col("doc_id").cast("string")).alias("s1"))
    valid = docs.filter("doc_id % 13 <> 2").select(F.explode(F.array(*(F.concat(F.lit(p), F.col("doc_id").cast("string")) for p in ("S2-", "S3-")))).alias("id"))
    f = validation.validate_lists(validation.parse_lines(_faulty_lines(spark, d)), need, valid)
    return f.select("rule", "severity", "n", F.array_join("examples", ",").alias("examples"))


def validate_subset(spark: SparkSession, d: str) -> DataFrame:
    rows = validation.last_lists(validation.parse_lines(_faulty_lines(spark, d)))
    cands = rows.select("s1", F.filter("ids", lambda x: x.startswith("S2-")).alias("ids"))
    f = validation.validate_subset(rows, cands)
    return f.select("rule", "severity", "n", F.array_join("examples", ",").alias("examples"))


def row_stats(spark: SparkSession, d: str) -> DataFrame:
    return validation.row_stats(validation.parse_lines(_faulty_lines(spark, d)))


def synthetic_entities(spark: SparkSession, d: str) -> DataFrame:
    return synthetic.entities(spark, 50).drop("ord")


def synthetic_candidates(spark: SparkSession, d: str) -> DataFrame:
    return synthetic.candidates(spark, 50).drop("ord")


def synthetic_training(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated trees on the synthetic features, at the settings of a run without a model."""
    t = resolution.train_synthetic(spark)
    return spark.createDataFrame([(t["threshold"], t["f05"], t["fold_mean"], t["fold_std"])], "threshold double, f05 double, fold_mean double, fold_std double")


_RAW = fixture.RAW_SQL
_NORM = f"WITH {_RAW}, {sqlgen.normalized()}"
_CANDS = f"""{_NORM}, s1 AS (SELECT * FROM norm WHERE entity_id LIKE 'S1-%'),
    tg AS (SELECT *, left(entity_id, 2) AS src FROM norm WHERE entity_id NOT LIKE 'S1-%'), {sqlgen.candidates('s1', 'tg', TOP_K, 'cc')},
    lists AS (SELECT source1_entity_id, array_to_string(candidates, ',') AS candidate_entity_ids FROM cc),
    pairs AS (SELECT DISTINCT source1_entity_id AS s1, unnest(candidates) AS cand FROM cc)"""
_TRUTH = """far AS (SELECT business_address_clean || '|' || country AS k, list_sort(list(DISTINCT entity_id)) AS ids FROM tg GROUP BY 1),
    truth AS (SELECT s1.entity_id AS s1, coalesce(ids, []::VARCHAR[]) AS ids FROM s1 LEFT JOIN far ON business_address_clean || '|' || country = k)"""
_JOINED = """j AS (SELECT p.s1, p.cand, a.business_name_clean AS n1, b.business_name_clean AS n2, a.business_address_clean AS a1, b.business_address_clean AS a2,
    a.postal_code AS z1, b.postal_code AS z2 FROM pairs p JOIN norm a ON a.entity_id = p.s1 JOIN norm b ON b.entity_id = p.cand)"""
_LEV = lambda a, b: f"CASE WHEN {a} <> '' AND {b} <> '' THEN 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) ELSE 0.0 END"
_JW = lambda a, b: f"CASE WHEN {a} <> '' AND {b} <> '' THEN jaro_winkler_similarity({a}, {b}) ELSE 0.0 END"
_SCORED = """sc AS (SELECT 'S1-' || (l.doc_id % 50) AS s1, quality AS y, ((n_chars * 37) % 1000) / 1000.0::DOUBLE * 0.5::DOUBLE + quality * 0.35::DOUBLE AS p
    FROM labels l JOIN documents d USING (doc_id))"""


def _f(tp: str, fp: str, fn: str) -> str:
    p, r = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp}::DOUBLE / ({tp} + {fp}) ELSE 0 END)", f"(CASE WHEN {tp} + {fn} > 0 THEN {tp}::DOUBLE / ({tp} + {fn}) ELSE 0 END)"
    return f"(CASE WHEN {p} + {r} > 0 THEN 1.25 * {p} * {r} / (0.25 * {p} + {r}) ELSE 0 END)"


def _sweep(start: str, step: str, n: int) -> str:
    return f"""{_SCORED}, g AS (SELECT i + 1 AS step, {start}::DOUBLE + i * {step}::DOUBLE AS threshold FROM range({n}) t(i)),
    sw AS (SELECT step, threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y <> 1 AND p >= threshold) AS fp,
        count(*) FILTER (y = 1 AND p < threshold) AS fn FROM g, sc GROUP BY ALL),
    sf AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall,
        {_f('tp', 'fp', 'fn')} AS f05 FROM sw)"""


_BEST = "SELECT round(threshold, 6) AS threshold, round(f05, 9) AS f05 FROM sf ORDER BY sf.f05 DESC, step LIMIT 1"
_PRED = f"""{_JOINED}, pr AS (SELECT s1, list_sort(list(DISTINCT cand)) AS ids FROM j WHERE 0.6 * ({_LEV('n1', 'n2')}) + 0.4 * ({_LEV('a1', 'a2')}) >= 0.7 GROUP BY s1)"""
_MATCH = """mt AS (SELECT source1_entity_id, array_to_string(coalesce(pr.ids, []::VARCHAR[]), ',') AS matched_entity_ids FROM lists LEFT JOIN pr ON s1 = source1_entity_id)"""
_LINES = """lines AS (SELECT doc_id + 2 AS line, CASE doc_id % 11 WHEN 3 THEN 'S1-' || doc_id WHEN 4 THEN 'S1-' || doc_id || chr(9) || 'S2-' || doc_id || ',S2-' || doc_id
    WHEN 5 THEN 'S1-' || doc_id || chr(9) || 'S1-' || doc_id || ',S3-' || doc_id WHEN 6 THEN 'S1-' || doc_id || chr(9) || 'X' || doc_id
    WHEN 7 THEN 'S1-' || (doc_id - doc_id % 2) || chr(9) || 'S2-' || doc_id WHEN 8 THEN 'S1-' || doc_id || chr(9) || ' '
    WHEN 9 THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'S1-' || doc_id || chr(9) || 'S2-' || doc_id || chr(9) || 'S3-' || doc_id END
    WHEN 10 THEN 'S1-' || doc_id || chr(9) || 'S2-' || doc_id || ',,S3-' || doc_id
    ELSE 'S1-' || doc_id || chr(9) || 'S2-' || doc_id || ',S3-' || (doc_id + 1) END AS value FROM documents),
    parts AS (SELECT line, value, strpos(value, chr(9)) AS tab FROM lines),
    ps AS (SELECT line, CASE tab WHEN 0 THEN value ELSE left(value, tab - 1) END AS s1, tab = 0 AS malformed,
        CASE WHEN tab = 0 OR trim(substr(value, tab + 1)) = '' THEN []::VARCHAR[] ELSE string_split(substr(value, tab + 1), ',') END AS ids
        FROM parts WHERE tab > 0 OR trim(value) <> ''),
    good AS (SELECT * FROM ps WHERE NOT malformed)"""
_FINDS = f"""WITH {_LINES}, ids AS (SELECT unnest(ids) AS id FROM good), need AS (SELECT 'S1-' || doc_id AS s1 FROM documents WHERE doc_id % 10 <> 1),
    valid AS (SELECT unnest(['S2-' || doc_id, 'S3-' || doc_id]) AS id FROM documents WHERE doc_id % 13 <> 2),
    fs AS (SELECT DISTINCT 'malformed' AS rule, line::VARCHAR AS x, line AS o FROM ps WHERE malformed
        UNION SELECT 'duplicate_row', s1, 0 FROM good GROUP BY s1 HAVING count(*) > 1
        UNION SELECT 'duplicate_id', s1, 0 FROM good WHERE len(ids) <> len(list_distinct(ids))
        UNION SELECT 'self_match', id, 0 FROM ids WHERE id LIKE 'S1-%'
        UNION SELECT 'bad_prefix', id, 0 FROM ids WHERE NOT (id LIKE 'S1-%' OR id LIKE 'S2-%' OR id LIKE 'S3-%')
        UNION SELECT 'missing_row', s1, 0 FROM need WHERE s1 NOT IN (SELECT s1 FROM good)
        UNION SELECT 'unexpected_row', s1, 0 FROM good WHERE s1 NOT IN (SELECT s1 FROM need)
        UNION SELECT 'unknown_id', id, 0 FROM ids WHERE (id LIKE 'S2-%' OR id LIKE 'S3-%') AND id NOT IN (SELECT id FROM valid))
    SELECT rule, 'error' AS severity, count(*) AS n, array_to_string(list(x ORDER BY o, x)[1:5], ',') AS examples FROM fs GROUP BY rule"""
_TEMPLATES = ", ".join(f"({k}, {sqlgen.quoted(a)}, {sqlgen.quoted(b)}, {sqlgen.quoted(c)})" for k, (a, b, c) in enumerate(synthetic.TEMPLATES))

ORACLES = {
    "sanitize_text": f"SELECT doc_id, {sqlgen.sanitize('text')} AS clean FROM documents",
    "clean_business_name": f"{_NORM} SELECT entity_id, business_name_clean FROM norm",
    "clean_address": f"{_NORM} SELECT entity_id, business_address_clean FROM norm",
    "postal_code": f"{_NORM} SELECT entity_id, country, postal_code FROM norm",
    "name_tokens": f"{_NORM} SELECT entity_id, name_tokens FROM norm",
    "normalized_records": f"{_NORM} SELECT * EXCLUDE ord FROM norm",
    "latest_records": f"{_NORM} SELECT entity_id, business_name_clean, CASE WHEN ord % 7 = 0 THEN '00001' ELSE postal_code END AS postal_code FROM norm",
    "soundex_codes": f"WITH w AS (SELECT DISTINCT unnest({sqlgen.words(sqlgen.sanitize('text'))}) AS word FROM documents) SELECT word, {sqlgen.soundex('word')} AS code FROM w",
    "blocking_postings": f"{_CANDS} SELECT block, rule, key, rk, tid FROM cc_p WHERE block <> '*'",
    "candidate_pairs": f"{_CANDS} SELECT * FROM lists",
    "candidate_pairs_top5": f"{_CANDS.replace(sqlgen.candidates('s1', 'tg', TOP_K, 'cc'), sqlgen.candidates('s1', 'tg', 5, 'cc'))} SELECT * FROM lists",
    "candidates_other_country": f"{_CANDS.replace('''s1 AS (SELECT * FROM norm''', '''s1 AS (SELECT * REPLACE (CASE country WHEN 'France' THEN 'Atlantis' ELSE country END AS country) FROM norm''')} SELECT * FROM lists",
    "candidate_pair_rows": f"{_CANDS} SELECT * FROM pairs",
    "ground_truth": f"{_CANDS}, {_TRUTH} SELECT s1, array_to_string(ids, ',') AS ids, len(ids) AS n FROM truth",
    "blocking_recall": f"{_CANDS}, {_TRUTH}, tp AS (SELECT s1, unnest(ids) AS cand FROM truth) SELECT 100.0::DOUBLE * count(p.s1) / greatest(count(*), 1) AS recall FROM tp LEFT JOIN pairs p USING (s1, cand)",
    "pair_features_sql": f"""{_CANDS}, {_JOINED} SELECT s1, cand, round({_LEV('n1', 'n2')}, 6) AS name_levenshtein_ratio, round({_JW('n1', 'n2')}, 6) AS name_jaro_winkler,
        round({_LEV('a1', 'a2')}, 6) AS address_levenshtein_ratio, round({_JW('a1', 'a2')}, 6) AS address_jaro_winkler, CASE WHEN z1 <> '' AND z1 = z2 THEN 1.0 ELSE 0.0 END::DOUBLE AS exact_zip_match FROM j""",
    "pair_feature_map": f"{_CANDS}, {_JOINED} SELECT s1, cand, 9::BIGINT AS n, CASE WHEN z1 <> '' AND z1 = z2 THEN 1.0 ELSE 0.0 END::DOUBLE AS zip FROM j",
    "zip_fields": """SELECT o_orderkey, CASE WHEN z IN ('0', '00000', '000000', 'unknown') THEN '' ELSE z END AS zip FROM (
        SELECT o_orderkey, regexp_replace(regexp_replace(o_orderkey || (['.0', '-001', ' 12', ''])[1 + o_orderkey % 4], '^(\\d+)\\.0$', '\\1'), '[ -]', '', 'g') AS z FROM orders)""",
    "alias_fields": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE lower(c_name) END AS name FROM customer",
    "label_pairs": f"{_CANDS}, {_TRUTH} SELECT p.s1, p.cand, CASE WHEN list_contains(t.ids, p.cand) THEN 1 ELSE 0 END AS label FROM pairs p JOIN truth t ON t.s1 = p.s1",
    "threshold_sweep": f"WITH {_sweep('0.30', '0.01', 66)} SELECT step, round(threshold, 6) AS threshold, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f05, 9) AS f05 FROM sf",
    "best_threshold": f"WITH {_sweep('0.30', '0.01', 66)} {_BEST}",
    "top_thresholds": f"WITH {_sweep('0.30', '0.01', 66)} SELECT step, round(f05, 9) AS f05 FROM sf ORDER BY sf.f05 DESC, step LIMIT 10",
    "legacy_threshold": f"WITH {_sweep('0.10', '0.05', 17)} {_BEST}",
    "macro_threshold": f"""WITH {_SCORED}, g AS (SELECT i + 1 AS step, 0.30::DOUBLE + i * 0.01::DOUBLE AS threshold FROM range(66) t(i)),
        e AS (SELECT step, threshold, s1, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y <> 1 AND p >= threshold) AS fp,
            count(*) FILTER (y = 1 AND p < threshold) AS fn FROM g, sc GROUP BY ALL),
        sf AS (SELECT step, threshold, avg({_f('tp', 'fp', 'fn')}) AS f05 FROM e GROUP BY ALL)
        SELECT round(threshold, 6) AS threshold, round(f05, 9) AS f05 FROM sf ORDER BY round(sf.f05, 12) DESC, step LIMIT 1""",
    "macro_f05": f"""WITH {_SCORED}, e AS (SELECT s1, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y <> 1 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn FROM sc GROUP BY s1)
        SELECT round(avg({_f('tp', 'fp', 'fn')}), 9) AS macro_f05 FROM e""",
    "predict_matches": f"{_CANDS}, {_PRED} SELECT s1, array_to_string(ids, ',') AS ids FROM pr",
    "matching_table": f"{_CANDS}, {_PRED}, {_MATCH} SELECT * FROM mt",
    "matching_table_legacy": f"{_CANDS} SELECT source1_entity_id, array_to_string(list_sort(list_distinct(list_concat([source1_entity_id, 'S1-0'], candidates))), ',') AS matched_entity_ids FROM cc",
    "skipped_pairs": f"""{_CANDS} SELECT count(*) AS pairs, count(*) FILTER (a.ord % 7 = 0) AS no_s1, count(*) FILTER (a.ord % 7 <> 0 AND b.ord % 7 = 0) AS no_cand
        FROM pairs p JOIN norm a ON a.entity_id = p.s1 JOIN norm b ON b.entity_id = p.cand""",
    "matching_stats": f"""{_CANDS}, {_PRED}, {_MATCH} SELECT count(*) AS n_rows, count(*) FILTER (matched_entity_ids <> '') AS with_match, count(*) FILTER (matched_entity_ids = '') AS singletons,
        sum(CASE WHEN matched_entity_ids = '' THEN 0 ELSE len(string_split(matched_entity_ids, ',')) END)::BIGINT AS pairs FROM mt""",
    "evaluate_predictions": f"""{_CANDS}, {_TRUTH}, {_PRED}, e AS (SELECT len(list_intersect(coalesce(pr.ids, []::VARCHAR[]), truth.ids)) AS tp, len(coalesce(pr.ids, []::VARCHAR[])) AS np, len(truth.ids) AS nt FROM truth LEFT JOIN pr USING (s1)),
        x AS (SELECT tp, np - tp AS fp, nt - tp AS fn FROM e), s AS (SELECT avg({_f('tp', 'fp', 'fn')}) AS m, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM x)
        SELECT round(m, 9) AS macro_f05, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 9) AS micro_precision,
            round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 9) AS micro_recall, round({_f('tp', 'fp', 'fn')}, 9) AS micro_f05, tp, fp, fn FROM s""",
    "validate_lists": _FINDS,
    "validate_subset": f"""WITH {_LINES}, r AS (SELECT s1, arg_max(ids, line) AS ids FROM good GROUP BY s1),
        x AS (SELECT s1 FROM r WHERE len(list_filter(ids, lambda x: x NOT LIKE 'S2-%')) > 0)
        SELECT 'not_candidate' AS rule, 'warning' AS severity, count(*) AS n, array_to_string(list(s1 ORDER BY s1)[1:5], ',') AS examples FROM x""",
    "row_stats": f"WITH {_LINES} SELECT count(*) AS total, count(*) FILTER (len(ids) = 0) AS empty, count(*) FILTER (len(ids) > 0) AS non_empty FROM good",
    "synthetic_entities": f"""WITH t(k, name, address, zip) AS (VALUES {_TEMPLATES}), r AS (
        SELECT 'S1' AS src, 0 AS base, '#' AS word, (i - 1) % 10 AS k, i FROM range(1, 51) x(i) UNION ALL SELECT 'S2', 10000, 'store ', (i - 1) % 10, i FROM range(1, 51) x(i)
        UNION ALL SELECT 'S3', 20000, 'branch ', i % 10, i FROM range(1, 51) x(i))
        SELECT src || '-' || lpad((base + i)::VARCHAR, 5, '0') AS entity_id, lower(name) || ' ' || word || i AS business_name_clean,
            CASE src WHEN 'S2' THEN replace(lower(address), 'st,', 'street,') ELSE lower(address) END AS business_address_clean, 'US' AS country, zip AS postal_code,
            lower(name) || ' ' || CASE src WHEN 'S1' THEN '' ELSE word END || i AS name_tokens FROM r JOIN t USING (k)""",
    "synthetic_candidates": """SELECT 'S1-' || lpad(i::VARCHAR, 5, '0') AS source1_entity_id, 'S2-' || (10000 + i) || ',S3-' || (20000 + i) AS candidate_entity_ids,
        'S2-' || (10000 + i) AS matched_entity_ids FROM range(1, 51) t(i)""",
}
_LABELLED = ORACLES["label_pairs"].replace("SELECT p.s1, p.cand, CASE", ", lp AS (SELECT p.s1, p.cand, CASE", 1) + ")"
_SAMPLED = f"""{_LABELLED}, sm AS (SELECT * EXCLUDE (rn, most) FROM (SELECT *, greatest(5 * sum(label) OVER (PARTITION BY s1), 1) AS most,
    row_number() OVER (PARTITION BY s1, label ORDER BY md5('42|' || s1 || '|' || cand), cand) AS rn FROM lp) WHERE label = 1 OR rn <= most)"""
ORACLES["negative_sample"] = f"{_SAMPLED} SELECT * FROM sm"
ORACLES["capped_training_pairs"] = f"""{_SAMPLED}, n AS (SELECT s1, count(*) AS n FROM sm GROUP BY s1), r AS (SELECT s1, n, sum(n) OVER (ORDER BY s1) AS run FROM n)
    SELECT sm.* FROM sm JOIN r USING (s1) WHERE run - n < 500"""

ORACLES["training_labels"] = f"""{_SAMPLED.replace('lp AS (', f'{_JOINED}, lp AS (', 1)} SELECT sm.s1, sm.cand, label, round({_LEV('n1', 'n2')}, 6) AS name_levenshtein_ratio,
    CASE WHEN z1 <> '' AND z1 = z2 THEN 1.0 ELSE 0.0 END::DOUBLE AS exact_zip_match FROM sm JOIN j USING (s1, cand)"""

QUERIES = {
    f.__name__: f
    for f in (
        resolve, sanitize_text, clean_business_name, clean_address, postal_code, name_tokens, normalized_records, latest_records,
        soundex_codes, blocking_postings, candidate_pairs, candidate_pairs_top5, candidates_other_country, candidate_pair_rows,
        ground_truth, blocking_recall, pair_features, pair_features_sql, pair_feature_map, zip_fields, alias_fields, label_pairs,
        negative_sample, capped_training_pairs, threshold_sweep, best_threshold, top_thresholds, legacy_threshold, macro_threshold,
        macro_f05, predict_matches, matching_table, matching_table_legacy, matching_stats, evaluate_predictions, skipped_pairs,
        training_set, training_labels, resolve_scores, validate_lists, validate_subset, row_stats,
        synthetic_entities, synthetic_candidates, synthetic_training,
    )
}
