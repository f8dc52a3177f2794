"""Scalar edge cases, invariants and file round trips of the resolution operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.functions import similarity as S
from linkloom.operators import blocking, boosting, evaluation, features, training, validation
from linkloom.plans import queries, resolution
from linkloom.session import stage
from linkloom.sources import synthetic, tsv
from linkloom.streaming.candidates import stream_candidate_pairs


def column(spark, fn, values):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, x string")
    return [r[0] for r in rows.orderBy("k").select(fn(F.col("x"))).collect()]


def test_sanitize(spark):
    assert column(spark, N.sanitize_text, ["Café & Co/X_Y-Z", "  NaN ", "undefined", " ", None, "½ Straße", "a@b"]) == [
        "cafe and co x y z", "", "", "", "", "12 strae", "a at b",
    ]


def test_every_rewrite_by_hand(spark):
    """Written out, not taken from the tables that the operators and their SQL share."""
    names = {
        "x pvt ltd": "x private limited", "x pvtltd": "x private limited", "x pty ltd": "x proprietary limited", "x ltd": "x limited",
        "x inc": "x incorporated", "x corp": "x corporation", "x llc": "x limited liability company", "x llp": "x limited liability partnership",
        "x plc": "x public limited company", "x co": "x company", "x enterprises": "x enterprise", "x enterprise": "x enterprise",
        "x services": "x service", "x service": "x service", "m s x": "x", "ms x": "x", "dr x": "x", "mr x": "x", "mrs x": "x", "shree x": "x",
        "shri x": "x", "prof x": "x", "x dr": "x dr", "corpus cost": "corpus cost", "the x x y": "the x y",
    }
    assert column(spark, N.clean_name, list(names)) == list(names.values())
    addresses = {
        "1 a rd": "1 a road", "1 a st": "1 a street", "1 a ave": "1 a avenue", "1 a blvd": "1 a boulevard", "1 a dr": "1 a drive", "1 a ln": "1 a lane",
        "1 a ct": "1 a court", "1 a pkwy": "1 a parkway", "1 a hwy": "1 a highway", "apt 4": "apartment 4", "ste 4": "suite 4", "fl 4": "floor 4",
        "flr 4": "floor 4", "bldg 4": "building 4", "hn 4": "house 4", "house no 4": "house 4", "houseno 4": "house 4", "flat no 4": "flat 4",
        "plot no 4": "plot 4", "opp park": "opposite park", "no 4": "number 4", "stand 4": "stand 4", "007 a": "7 a", "a 0": "a 0",
    }
    assert column(spark, N.clean_address, list(addresses)) == list(addresses.values())


def test_names_and_addresses(spark):
    assert column(spark, N.clean_name, ["M/s Shree Foods Pvt. Ltd.", "Dr", "Acme Acme Inc", None]) == [
        "shree foods private limited", "dr", "acme incorporated", "",
    ]
    assert column(spark, N.clean_address, ["0017560 Main Rd Road", "h.no 5", "House No 5", "00"]) == [
        "17560 main road", "h number 5", "house 5", "00",
    ]
    assert column(spark, N.name_tokens, ["global solutions limited liability company", "the a b"]) == [
        "global solutions limited liability company", "b",
    ]


def test_postal_codes(spark):
    rows = [("500 034", "India"), ("TX 72716-1234", "us "), ("75001 Paris", "FRANCE"), ("12345", "USA"), ("12345 Main St", "US"), ("Main Street 12345 x", "US"), (None, "US")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, a string, c string").orderBy("k")
    assert [r[0] for r in d.select(N.postal_code(F.col("a"), F.col("c"))).collect()] == ["500034", "72716", "75001", "", "", "12345", ""]


def test_soundex(spark):
    assert column(spark, N.soundex, ["ashcraft", "robert", "123", "3m", None]) == ["A226", "R163", "", "M000", ""]


def test_normalize_checks_columns(spark):
    with pytest.raises(ValueError):
        N.normalize(spark.createDataFrame([("a",)], "entity_id string"))


def test_similarities():
    assert S.jaro_winkler(["martha"], ["marhta"]) == pytest.approx(0.9611111)
    assert S.jaro_winkler(["abcdef"], ["abxyzw"]) == pytest.approx(0.5555556)
    assert S.common_subsequence(["abcbdab"], ["bdcaba"]) == [4]
    assert S.token_sort_ratio(["b a"], ["a b"]) == [1.0]
    assert S.token_set_ratio(["a b", ""], ["a b c", "a"]).tolist() == [1.0, 0.0]


def _plain_jaro_winkler(a, b):
    if not a or not b:
        return 0.0
    reach, taken, left = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, x in enumerate(a):
        j = next((j for j, y in enumerate(b) if y == x and abs(i - j) <= reach and j not in taken), None)
        if j is not None:
            taken.add(j)
            left.append(x)
    right = [b[j] for j in sorted(taken)]
    m = len(left)
    if not m:
        return 0.0
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right)) // 2) / m) / 3
    lead = next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)
    return jaro + lead * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _plain_indel(a, b):
    """1 - insertions and deletions / letters, by the whole table of distances."""
    if not a + b:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
        row = new
    return 1 - row[-1] / (len(a) + len(b))


def _plain_token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not one or not two):
        return 1.0
    p, q = (" ".join(filter(None, (both, s))) for s in (one, two))
    pairs = [(p, q)] + ([(both, p), (both, q)] if both else [])
    return max(_plain_indel(*s) for s in pairs)


def test_similarities_against_plain_loops():
    import random

    r = random.Random(4)
    text = lambda: " ".join("".join(r.choices("abcé☃", k=r.randrange(0, 7))) for _ in range(r.randrange(0, 9)))
    a = [text() for _ in range(700)]
    b = [text() if r.random() < 0.5 else x[: r.randrange(0, len(x) + 1)] + text() for x in a]
    a, b = [*a, "x" * 90 + "y", "", "a", "b c"], [*b, "x" * 70, "", "", "c b"]  # beyond one word of bits, empty, ties
    assert S.jaro_winkler(a, b) == pytest.approx([_plain_jaro_winkler(x, y) for x, y in zip(a, b)])
    order = lambda t: " ".join(sorted(t.split()))
    assert S.token_sort_ratio(a, b) == pytest.approx([_plain_indel(order(x), order(y)) if x and y else 0.0 for x, y in zip(a, b)])
    # the common words and these with a side's others differ only by what the side adds
    assert S.token_set_ratio(a, b) == pytest.approx([_plain_token_set(x, y) for x, y in zip(a, b)])


def test_zip_field(spark):
    assert column(spark, S.zip_field, ["72716.0", "560-001", "00000", None]) == ["72716", "560001", "", ""]


def test_feature_contract(spark):
    e = spark.createDataFrame(
        [("S1-1", "walmart supercenter store 100", "702 sw 8th street", "72716", 1), ("S2-1", "Wal-Mart Supercenter #100", None, "72716.0", 2), ("S3-1", None, None, None, 3)],
        "entity_id string, business_name string, address string, zip_code string, ord long",
    )
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-1", "S9-9")], "s1 string, cand string")
    got = {r["cand"]: r for r in features.extract_features(pairs, e).collect()}
    assert set(got) == {"S2-1", "S3-1"}
    assert got["S2-1"]["name_levenshtein_ratio"] > 0.6 and got["S2-1"]["exact_zip_match"] == 1.0
    assert got["S2-1"]["address_jaro_winkler"] == 0.0 and all(got["S3-1"][f] == 0.0 for f in features.FEATURES)


def _plain(s1, targets, top_k):
    """The rules as nested loops over lists."""
    index = {}
    for t in targets:
        for w in t["name_tokens"].split()[:4]:
            if len(w) >= 3:
                if t["postal_code"]:
                    index.setdefault((1, t["postal_code"] + "_" + w), []).append(t["entity_id"])
                index.setdefault((2, w), []).append(t["entity_id"])
                index.setdefault((5, w[:3]), []).append(t["entity_id"])
        if t["postal_code"]:
            index.setdefault((3, t["postal_code"]), []).append(t["entity_id"])
    c = []

    def add(rule, key, cap, stop):
        for t in index.get((rule, key), [])[:cap]:
            if t not in c:
                c.append(t)
            if stop and len(c) >= top_k:
                return

    w, z = s1["name_tokens"].split(), s1["postal_code"]
    for x in w[:4] if z else []:
        add(1, z + "_" + x, 20, True)
    if len(c) < top_k:
        for x in w[:3]:
            if len(x) >= 3:
                add(2, x, 15, True)
    if z and len(c) < top_k:
        add(3, z, 10, True)
    if len(c) < 10:
        for x in w[:2]:
            if len(x) >= 3:
                add(5, x[:3], 5, False)
    return ",".join(sorted(c))


@pytest.mark.parametrize("top_k", [1, 5, 12])
def test_blocking_against_loops(spark, top_k):
    import random

    rnd = random.Random(top_k)
    words = ["123", "456", "789", "1234", "77", "9999", "4567"]  # no letters: the phonetic rule stays out
    rec = lambda s, i: {"entity_id": f"{s}-{i}", "business_name_clean": "", "country": "US", "postal_code": rnd.choice(["", "1", "2"]), "name_tokens": " ".join(rnd.choices(words, k=rnd.randrange(1, 6))), "ord": i}
    s1, s2, s3 = ([rec(s, i) for i in range(n)] for s, n in (("S1", 30), ("S2", 60), ("S3", 40)))
    schema = "entity_id string, business_name_clean string, country string, postal_code string, name_tokens string, ord long"
    df = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = {r[0]: r[1] for r in blocking.generate_candidate_pairs(df(s1), df(s2), df(s3), top_k).collect()}
    assert got == {r["entity_id"]: _plain(r, s2 + s3, top_k) for r in s1}


def test_threshold_ties_and_empty(spark):
    d = spark.createDataFrame([(1, 0.99), (1, 0.99)], "y int, p double")
    assert evaluation.best_threshold(evaluation.threshold_sweep(d)).first()["threshold"] == pytest.approx(0.30)
    none = spark.createDataFrame([(0, 0.9)], "y int, p double")
    assert tuple(evaluation.best_threshold(evaluation.threshold_sweep(none)).first()) == (0.5, 0.0)
    assert len(evaluation.SWEEP) == 66 and len(evaluation.LEGACY_SWEEP) == 17


def test_empty_truth_scores_zero(spark):
    t = spark.createDataFrame([("S1-1", [])], "s1 string, ids array<string>")
    p = spark.createDataFrame([("S1-1", [])], "s1 string, ids array<string>")
    assert evaluation.evaluate_predictions(p, t).first()["macro_f05"] == 0.0


def test_validator(spark):
    lines = ["S1-1\tS2-1,S2-1", "S1-1\tS3-1", "S1-2", "", "S1-3\tS1-9,X1", "S1-8\t", "S1-5\tS3-1,,S1-9\tS2-7", " \tS3-1,", "  "]
    rows = validation.parse_lines(spark.createDataFrame([(i + 2, x) for i, x in enumerate(lines)], "line long, value string"))
    need = spark.createDataFrame([("S1-1",), ("S1-3",), ("S1-4",)], "s1 string")
    valid = spark.createDataFrame([("S3-1",)], "id string")
    got = {r["rule"]: (r["n"], r["examples"]) for r in validation.validate_lists(rows, need, valid).collect()}
    assert got == {
        "malformed": (1, ["4"]), "duplicate_row": (1, ["S1-1"]), "duplicate_id": (1, ["S1-1"]), "self_match": (2, ["S1-9", "S1-9\tS2-7"]), "bad_prefix": (2, ["", "X1"]),
        "missing_row": (1, ["S1-4"]), "unexpected_row": (3, [" ", "S1-5", "S1-8"]), "unknown_id": (1, ["S2-1"]),
    }
    assert tuple(validation.row_stats(rows).first()) == (6, 1, 5)
    cands = spark.createDataFrame([("S1-1", ["S3-1"]), ("S1-5", ["S3-1"])], "s1 string, ids array<string>")
    subset = validation.validate_subset(validation.last_lists(rows), cands).first()
    assert subset["examples"] == [" ", "S1-3", "S1-5"] and subset["severity"] == "warning"
    assert validation.shown(7, ["a", "b", "c", "d", "e"]) == "7 total, e.g. a, b, c, d, e, ..." and validation.shown(1, ["a"]) == "a"


def test_tsv_round_trip(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"a ""b""\nc"\tNA\tUS\n')
    r = tsv.read_tsv(spark, str(tmp_path / "x.tsv")).first()
    assert (r["business_name"], r["business_address"]) == ('a "b"\nc', None)
    out = spark.createDataFrame([("S1-1", "")], "source1_entity_id string, matched_entity_ids string")
    tsv.write_tsv(out, str(tmp_path / "o.tsv"))
    text = next((tmp_path / "o.tsv").glob("part-*")).read_text()
    assert text.splitlines() == ["source1_entity_id\tmatched_entity_ids", "S1-1\t"]


def test_order_survives_many_parts(spark, tmp_path):
    """Parts of very different sizes: Spark packs the largest first, places keep the written order."""
    rows = [(f"S1-{i % 40}", "x" * (200 if i > 300 else 1) + str(i)) for i in range(400)]
    d = spark.createDataFrame(rows, "source1_entity_id string, matched_entity_ids string").repartitionByRange(7, F.length("matched_entity_ids"))
    tsv.write_tsv(d, str(tmp_path / "o"))
    want = [r[1] for p in sorted((tmp_path / "o").glob("part-*")) for r in (x.split("\t") for x in p.read_text().splitlines()[1:])]
    back = tsv.read_tsv(spark, str(tmp_path / "o"))
    assert [r[1] for r in back.orderBy("ord").collect()] == want
    tsv.write_tsv(d, str(tmp_path / "one.tsv"), single_file=True)
    lines = (tmp_path / "one.tsv").read_text().splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and [x.split("\t")[1] for x in lines[1:]] == want
    tsv.write_tsv(d.limit(0), str(tmp_path / "none"))
    assert [p.read_text() for p in (tmp_path / "none").glob("part-*")] in ([], ["source1_entity_id\tmatched_entity_ids\n"])
    assert sum(tsv.write_tsv(d, str(tmp_path / "o"), skip_existing=True) for _ in range(2)) == 0


def _challenge(folder):
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    for k in (1, 2, 3):
        (folder / f"test_source{k}.tsv").write_text(head + "".join(f"S{k}-{i}\tAcme{i} Foods Ltd\t{i} Main St, TX 7271{i}\tUS\n" for i in range(6)))


def test_validator_over_files(spark, tmp_path, capsys):
    from linkloom import cli
    from linkloom.plans import checking

    _challenge(tmp_path)
    t = str(tmp_path)
    rows = [(f"S1-{i}", f"S2-{i},S3-{i}") for i in range(6)]
    schema = "source1_entity_id string, {}_entity_ids string"
    tsv.write_tsv(spark.createDataFrame(rows, schema.format("matched")).repartition(4), f"{t}/m")
    tsv.write_tsv(spark.createDataFrame(rows, schema.format("candidate")).repartition(3), f"{t}/c")
    r = checking.validate(spark, f"{t}/m", f"{t}/c", t, check_ids=True)  # several parts, a header each
    assert r.passed and not r.warnings and r.stats["m"] == {"total": 6, "empty": 0, "non_empty": 6}
    assert cli.main(["validate", "-m", f"{t}/m", "-c", f"{t}/none", "-t", t]) == 0
    text = capsys.readouterr().out
    assert "ids_unchecked" in text and "no_candidates" in text and "6 rows (0 empty, 6 non-empty)" in text and "PASS" in text

    def errors(data, candidate=None, **more):
        (tmp_path / "bad.tsv").write_bytes(data)
        return checking.validate(spark, f"{t}/bad.tsv", candidate, t, **more)

    head = b"source1_entity_id\tmatched_entity_ids\n"
    assert "empty_file" in errors(b"").errors[0]
    assert "comma_separated" in errors(b"source1_entity_id,matched_entity_ids\nS1-1,S2-1\n").errors[0]
    assert "bad_header" in errors(b"id\tmatched_entity_ids\n").errors[0]
    assert "not_utf8" in errors(head + b"S1-1\t\xff\n").errors[0]
    assert errors(b" Source1_Entity_ID\tMATCHED_entity_ids \n" + b"".join(b"S1-%d\t\n" % i for i in range(6))).passed
    found = {f[1]: (f[3], f[4]) for f in errors(head + b"S1-0\tS2-1\n\nS1-1\nS1-2\tS2-2,,S2-3\n   \nS1-3 S2-1\n", f"{t}/c", check_ids=True).findings if f[0] == "bad.tsv"}
    assert found == {"malformed": (2, ["4", "7"]), "bad_prefix": (1, [""]), "missing_row": (4, ["S1-1", "S1-3", "S1-4", "S1-5"]), "not_candidate": (2, ["S1-0", "S1-2"])}
    assert "missing_file" in checking.validate(spark, f"{t}/gone.tsv", None, t).errors[0]
    (tmp_path / "test_source3.tsv").unlink()
    r = checking.validate(spark, f"{t}/m", None, t, check_ids=True)
    assert r.passed and "test_source3.tsv is missing" in r.warnings[0]
    (tmp_path / "test_source1.tsv").unlink()
    assert cli.main(["validate", "-m", f"{t}/m", "-t", t]) == 1 and "missing_file" in capsys.readouterr().out


def test_line_numbers_over_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.txt").write_text("".join(f"{k} {i}\n" for i in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = tsv.numbered(stage(tsv.read_lines(spark, str(tmp_path)), "lines")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 9000 and all(r["value"].split()[1] == str(r["line"]) for r in rows)
    assert len({r["ord"]["start"] for r in rows}) > 3


def test_trees_learn_and_agree_with_a_walk():
    r = np.random.RandomState(3)
    x = r.rand(3000, 9).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 8] > 0.8).astype(int)
    t = boosting.fit(x[:2500], y[:2500], training.BACKENDS["lightgbm"])  # 500 trees, as stated
    assert t.feature.shape == (500, 255) and t.losses[-1] < 0.2 * t.losses[0]
    p = t.probabilities(x[2500:])
    assert np.mean((p >= 0.5) == (y[2500:] == 1)) > 0.93
    for row, want in zip(x[2500:2520], p):
        s = t.base
        for f, c, v in zip(t.feature, t.cut, t.value):
            at = 0
            while f[at] >= 0:
                at = 2 * at + (2 if row[f[at]] > c[at] else 1)
            s += v[at]
        assert 1 / (1 + math.exp(-s)) == pytest.approx(want)
    assert max((f >= 0).sum() for f in t.feature) <= 62 and boosting.Trees.from_dict(t.to_dict()).probabilities(x[:5]) == pytest.approx(t.probabilities(x[:5]))
    own = boosting.Settings(trees=3, rows=1.0, columns=1.0, least=1, l1=0.0, l2=0.0, depth=1, rate=1.0)
    one = boosting.fit(np.array([[0.0], [1.0], [2.0], [3.0]]), np.array([0, 0, 1, 1]), own)
    assert one.cut[0][0] == 1.5 and one.value[0][1:3] == pytest.approx([-2, 2])  # the Newton step of a half
    assert boosting.fit(np.zeros((0, 9)), np.zeros(0), own).probabilities(np.zeros((2, 9))) == pytest.approx([0.5, 0.5])
    assert boosting.fit(np.ones((5, 9)), np.ones(5), own).probabilities(np.ones((1, 9)))[0] > 0.9


@pytest.mark.parametrize("backend", ["lightgbm", "xgboost", "sklearn"])
def test_training_as_stated(spark, tmp_path, backend):
    """500 trees and five folds."""
    t = training.train_model(synthetic.feature_rows(spark, 800), backend)
    assert t["model"].feature.shape[0] == 500 and t["f05"] > 0.9 and 0.3 <= t["threshold"] <= 0.95 and t["fold_mean"] > 0.9 and t["fold_std"] < 0.2
    training.save_model(spark, t, str(tmp_path / "m"))
    back = training.load_model(spark, str(tmp_path / "m"))
    assert (back["threshold"], back["backend"]) == (t["threshold"], backend)
    e, c = synthetic.entities(spark, 20), synthetic.candidates(spark, 20)
    m = evaluation.assemble_matches(c, resolution.predict_matches(c, e, back)).collect()
    assert len(m) == 20 and all(set(filter(None, r[1].split(","))) <= {f"S2-{10000 + i}" for i in range(1, 21)} | {f"S3-{20000 + i}" for i in range(1, 21)} for r in m)


def test_folds_and_bounds(spark):
    d = synthetic.feature_rows(spark, 3000)
    per = training.with_folds(d, 5).groupBy("label", "fold").count().collect()
    assert len(per) == 10 and all(abs(r["count"] / (300 if r["label"] else 2700) - 0.2) < 0.07 for r in per)
    n = training.bounded(d, 1000).count()
    assert 850 < n < 1150 and training.bounded(d, 3000).count() == 3000
    assert training.get_model("unheard") == training.BACKENDS["sklearn"]
    with pytest.raises(ValueError):
        training.train_model(d.limit(0))


def test_training_set_drops_missing_records_before_the_cap(spark):
    e = synthetic.entities(spark, 12).filter("entity_id <> 'S1-00002' and entity_id <> 'S3-20003'")
    c = synthetic.candidates(spark, 12)
    t = resolution.build_training_set(c, e, tsv.truth_lists(c))
    got = {(r["s1"], r["cand"]): r["label"] for r in t.collect()}
    assert len(got) == 21 and got["S1-00001", "S2-10001"] == 1 and got["S1-00001", "S3-20001"] == 0
    assert not any(s == "S1-00002" for s, _ in got) and ("S1-00003", "S3-20003") not in got
    capped = {r["s1"] for r in resolution.build_training_set(c, e, tsv.truth_lists(c), max_pairs=3).collect()}
    assert capped == {"S1-00001", "S1-00003"}  # two pairs, then one: whole groups until three are reached
    assert tuple(features.skipped_pairs(blocking.explode_pairs(c, "candidate_entity_ids"), e).first()) == (24, 2, 1)
    mock = resolution.build_training_set(c, e, tsv.truth_lists(c), use_mock=True).collect()
    assert len(mock) == 21 and all(0 <= r[f] <= 1 for r in mock for f in features.FEATURES)


def test_resolve_agrees_with_single_pairs(spark):
    """The flagship's lists are what a walk through the trees gives for each pair by itself."""
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = {r[0]: r[1] for r in entry.queries()["resolve"](spark, sf).collect()}
    e, lists, _ = queries._resolved(spark, sf)
    every = features.extract_features(blocking.explode_pairs(lists, "candidate_entity_ids").distinct(), e)
    known = tsv.truth_lists(queries._truth(e)).select("s1", F.explode("ids").alias("cand"))
    t = training.train_model(training.sample_negatives(training.label_pairs(every, known)))
    want = {}
    for r in every.collect():
        if t["model"].probabilities(np.array([[r[f] for f in features.FEATURES]]))[0] >= t["threshold"]:
            want.setdefault(r["s1"], []).append(r["cand"])
    assert {k: v for k, v in got.items() if v} == {k: ",".join(sorted(v)) for k, v in want.items()} and len(got) == 67


def test_pipeline_writes_and_validates(spark, tmp_path, capsys):
    from linkloom import cli

    _challenge(tmp_path)
    out = resolution.run_pipeline(spark, str(tmp_path), str(tmp_path / "out"), trees=20)
    assert out["stats"]["n_rows"] == 6 and out["report"].passed and out["report"].findings == []
    m = str(tmp_path / "model")
    for _ in range(2):  # trains and saves, then loads
        assert cli.main(["run", "--data-dir", str(tmp_path), "--output-dir", str(tmp_path / "one"), "--model-path", m, "--trees", "5", "--single-file"]) == 0
        assert "PASS" in capsys.readouterr().out
    lines = (tmp_path / "one" / "candidate_pairs.tsv").read_text().splitlines()
    assert lines[0] == "source1_entity_id\tcandidate_entity_ids" and len(lines) == 7
    s = resolution.normalized_sources(spark, str(tmp_path))
    plan = blocking.generate_candidate_pairs(*s)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" not in plan  # sources are scanned and normalised before, once


def test_command_line(spark, tmp_path, capsys):
    from linkloom import cli

    _challenge(tmp_path)
    t, run = str(tmp_path), lambda *a: cli.main(list(a))
    assert run("preprocess", "--input-dir", t, "--output-dir", f"{t}/n") == 0
    assert sorted(p.name for p in (tmp_path / "n").iterdir() if p.suffix == ".tsv") == [f"normalized_source{k}.tsv" for k in (1, 2, 3)]
    assert run("preprocess", "--input-file", f"{t}/test_source1.tsv", "--output-file", f"{t}/s1.tsv") == 0
    assert tsv.read_tsv(spark, f"{t}/s1.tsv").count() == 6 and run("preprocess") == 0
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\tS2-{i}\n" for i in range(6)))
    assert run("block", "--normalized-dir", f"{t}/n", "--output", f"{t}/c.tsv", "--ground-truth", f"{t}/truth.tsv", "--use-gpu") == 0
    assert float(capsys.readouterr().out.split()[-1]) == 100.0
    own = ["--normalized-dir", f"{t}/n", "--candidate-file", f"{t}/c.tsv", "--ground-truth", f"{t}/truth.tsv", "--model-dir", f"{t}/models", "--trees", "5", "--n-folds", "2"]
    assert run("train", "--mode", "predict", *own, "--output", f"{t}/p.tsv") == 1 and "no model" in capsys.readouterr().out
    assert run("train", *own, "--output", f"{t}/m.tsv", "--test-candidate-file", f"{t}/c.tsv", "--test-normalized-dir", f"{t}/n") == 0
    assert run("train", "--mode", "predict", *own, "--output", f"{t}/p.tsv") == 0
    assert sorted(tsv.load_candidates(spark, f"{t}/m.tsv").drop("ord").collect()) == sorted(tsv.load_candidates(spark, f"{t}/p.tsv").drop("ord").collect())
    assert run("train", "--mode", "train", *own[:4], "--ground-truth", f"{t}/gone.tsv") == 1
    assert run("train", "--mode", "synthetic", "--model-dir", f"{t}/s", "--synthetic-dir", f"{t}/syn", "--output", f"{t}/so.tsv", "--trees", "5", "--use-mock-features", "--use-gpu") == 0
    assert tsv.read_tsv(spark, f"{t}/syn/synthetic_normalized_records.tsv").count() == 150


def test_stream_of_candidates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1, S3-1\nS1-2\t\n")
    q = stream_candidate_pairs(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("pairs").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("pairs").collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-1")]
