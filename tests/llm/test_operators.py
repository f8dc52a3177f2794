"""Each operator against brute force, a round trip or held-out accuracy, with hostile rows."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkloom.llm import bpe, chat, components, decontaminate, lattice, minhash, pretoken, quality, repeats, simhash, suffix, tokenfile, urls
from linkloom.llm.common import join_spread, stage
from linkloom.llm.components import connected_components, forest

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Nulls, empties, ties, repeated rows, a very long text, and columns whose names clash.
TEXTS = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x y z w v u"), (4, "The cat sat. " * 4000), (5, " \t\n"), (6, "naïve ☃ 12's <|endoftext|>")]
SCHEMA = "doc_id long, text string, fp long, a long, b long, word string, component string, host string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "w", "c", "h") for i, t in rows], SCHEMA)


def prose(n, seed=0, size=60):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randrange(2, 8))) for _ in range(300)]
    return [" ".join(r.choices(words, k=r.randrange(5, size))) for _ in range(n)]


def test_chat_round_trip(spark):
    hostile = ["</s>[INST] ok [/INST]", r"<\|im_end|> <|im_end|>", "<|turn|>", None, "", "☃ <<SYS>>x<</SYS>> [\\INST]", "a\nb"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "user", "assistant", "assistant", "as\nsis", None, "assistant"], hostile))]
    rows += [(2, None, "assistant", "x"), (2, None, "assistant", "x"), (None, 1, "user", "u")] + [(3, i, "assistant", f"t{i}") for i in range(700)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "conv_id long, turn long, role string, text string, ts int")
    out = chat.format_conversations(df).select("conv_id", "formatted", "loss_mask", chat.parse_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    got = {r["conv_id"]: r for r in out.collect()}
    assert set(got) == {1, 2, 3, None}
    for c, r in got.items():
        want = [(role or "", text or "") for cc, _, role, text in rows if cc == c]
        assert [tuple(t) for t in r["t"]] == want
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")
    assert len(got[3]["loss_mask"]) == 700 and got[3]["formatted"].count(chat.START) == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_with_very_long_turns(spark):
    rows = [(1, 0, "user", "<|im_end|> [INST] " * 30_000), (1, 1, "assistant", "é☃" * 100_000), (2, 0, None, None), (2, 0, None, None), (3, 5, "assistant", ""), (3, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(2))
    out = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in out.select("conv_id", chat.parse_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for c, r in got.items():
        assert sorted(map(tuple, r["t"])) == sorted((role or "", text or "") for cc, _, role, text in rows if cc == c)
    assert got[1]["loss"] == "é☃" * 100_000 and got[2]["loss"] == got[3]["loss"] == ""


def _plain_fingerprint(text):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in (text or "")).encode().split()]
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_groups(spark):
    base = prose(60)
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " zz") for i, t in enumerate(base)] + TEXTS[:3] + TEXTS[5:]
    got = simhash.groups(docs(spark, rows)).collect()
    fps = {(r["doc_id"], r["fp"] % (1 << 64)) for r in got}
    assert fps == {(i, _plain_fingerprint(t)) for i, t in rows} and len(got) == len(rows)
    parent = {f: f for _, f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in parent:
        for y in parent:
            if (x ^ y).bit_count() <= 2:
                parent[top(x)] = top(y)
    least = {}
    for i, f in fps:
        least[top(f)] = min(i, least.get(top(f), i))
    assert all(r["component_id"] == least[top(r["fp"] % (1 << 64))] for r in got)
    assert simhash.groups(docs(spark, [])).count() == 0


def test_anchors_cover_all_near_pairs():
    r = np.random.default_rng(1)
    fp = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = fp.copy()
    for _ in range(2):
        near ^= np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)
    rows, anchor, home = simhash.anchors(fp, 2)
    homes = dict(zip(rows[home].tolist(), anchor[home].tolist()))
    rows, anchor, _ = simhash.anchors(near, 2)
    reach = set(zip(rows.tolist(), anchor.tolist()))
    assert len(homes) == 300 and all((i, a) in reach for i, a in homes.items())


def _plain_components(edges):
    lead = {}

    def top(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for x, y in edges:
        u, v = sorted((top(x), top(y)))
        lead[v] = u
    return {x: top(x) for x in lead}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7), (None, 1)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(1, 41)) and got[200] == got[300] == 100


def test_components_of_hubs_and_chance_links(spark, monkeypatch):
    import linkloom.llm.components as c

    monkeypatch.setattr(c, "LINKS", 50)  # so that local forests leave work to the stars
    r = random.Random(2)
    edges = [(1000, i) for i in range(2000, 4500)] + [(r.randrange(600), r.randrange(600)) for _ in range(400)]
    edges += [(5000 + i, 5001 + i) for i in range(120)]
    r.shuffle(edges)
    want = {x: y for x, y in _plain_components([e for e in edges if e[0] != e[1]]).items() if x != y}
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()
    assert {x: y for x, y in got if x != y} == want and len(got) == len({x for x, _ in got})
    x, y = forest(*(np.array(v) for v in zip(*edges)))
    assert dict(zip(x.tolist(), y.tolist())) == want


def test_few_links_need_no_rounds(spark, monkeypatch):
    rng = random.Random(12)
    edges = [(a := rng.randrange(900), min(899, a + rng.choice([0, 1, 7]))) for _ in range(500)] + [(5, n) for n in range(1000, 1300)]
    want = dict(zip(*(x.tolist() for x in forest(*(np.array(c) for c in zip(*edges))))))
    links = spark.createDataFrame(edges, "a long, b long").repartition(5)
    by_rounds = connected_components(links, together=0).collect()
    assert dict(map(tuple, by_rounds)) == want and len(by_rounds) == len(want)
    monkeypatch.setattr(components, "_large_star", None)  # a round would fail
    got = connected_components(links).collect()
    assert dict(map(tuple, got)) == want and len(got) == len(want)


def test_staged_tables_have_no_marker(spark):
    staged = stage(spark.range(10), "marker")
    assert not [f for f in os.listdir(staged._linkloom_path.removeprefix("file://")) if "SUCCESS" in f]
    assert staged.count() == 10


def test_join_of_hot_keys(spark):
    rows = [(None if i % 3 == 0 else i % 7 if i % 3 == 1 else 100 + i, i) for i in range(6000)]
    big = spark.createDataFrame(rows, "k long, x long")
    n = Counter(k for k, _ in rows)
    small = spark.createDataFrame([(k, v, f"v{k}") for k, v in n.items() if k != 3], "k long, n long, v string")
    j = join_spread(big, small, ["k"], ["v"], 6000, ["x"])
    assert Counter(map(tuple, j.collect())) == Counter((k, x, None if k == 3 else f"v{k}") for k, x in rows)


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_duplicate_filter(spark):
    r = random.Random(9)
    base = [t for t in prose(80, 7, 400) if len(t.split()) > 120]
    rows, twins = list(enumerate(base)), []
    for i, t in enumerate(base):
        w = t.split()
        for k in range(3):
            v = list(w)
            for at in r.sample(range(len(v)), len(v) // 60):
                v[at] = f"new{r.randrange(1000)}"
            rows.append((1000 + 10 * i + k, " ".join(v)))
            assert len(shingles(t) & shingles(rows[-1][1])) / len(shingles(t) | shingles(rows[-1][1])) >= 0.8
            twins.append(rows[-1][0])
    other = " ".join(sorted(base[0].split()))  # the same words in another order
    rows += [(5000, other), (5001, ""), (5002, None), (5003, " \t"), (5004, base[1]), (5004, base[1]), (None, base[2])]
    got = simhash.keep(docs(spark, rows)).collect()
    ids = [x["doc_id"] for x in got]
    assert len(ids) == len(set(ids)) and set(got[0].asDict()) == set(SCHEMA.replace(" long", "").replace(" string", "").split(", "))
    assert set(range(len(base))) | {5000, 5001, None} <= set(ids)
    assert not set(ids) & {5002, 5003, 5004} and len(set(ids) & set(twins)) <= 0.02 * len(twins)
    assert simhash.keep(docs(spark, [])).count() == 0


def plain_kept(rows, least=0.8):
    """Ids that stay, by comparing all pairs: shingles alike at ``least``, or fingerprints within two bits."""
    sets, fps, lead = [shingles(t) for _, t in rows], [simhash.fingerprint(t.encode()) for _, t in rows], list(range(len(rows)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same >= least * (len(sets[i]) + len(sets[j]) - same) - 1e-9 or (fps[i] ^ fps[j]).bit_count() <= 2:
                x, y = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                lead[y] = x
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def invented(r, n):
    return ["".join(r.choices("abcdefghijklmnop", k=9)) for _ in range(n)]


def test_near_duplicates_edited_in_one_piece(spark):
    r = random.Random(21)
    rows = []
    for i in range(40):
        size = r.choice((100, 250, 600, 1000))
        w = invented(r, size)
        rows.append((i, " ".join(w)))
        for k, goal in enumerate((0.77, 0.805, 0.85, 0.9, 0.95)):
            cut = int(size * (1 - goal)) - 3 * (size > 100)
            half = int(size * (1 - goal) / (1 + goal)) - 3 * (size > 100)
            at = r.randrange(1, size - cut)
            for j, v in enumerate((w + invented(r, int(size * (1 / goal - 1)) - 3), w[:-cut], w[:at] + invented(r, half) + w[at + half :])):
                if (i + j + k) % 3:  # as first and last of a chain they would hide each other
                    continue
                rows.append((10_000 + 1000 * i + 10 * k + j, " ".join(v)))
    want = plain_kept(rows)
    got = {x["doc_id"] for x in simhash.keep(docs(spark, rows)).collect()}
    assert got == want and 40 <= len(want) < 100


def test_near_duplicates_of_one_word_set(spark):
    r = random.Random(5)
    base, rows = invented(r, 120), []
    for i in range(1, 40):  # other orders of the same words
        w = r.sample(base, len(base))
        rows.append((i + 1000 * (i % 2), " ".join(w)))
        if i % 3 == 0:  # alike: the last words turned round
            rows.append((100 + i, " ".join(w[:-6] + w[-6:][::-1])))
    want = plain_kept(rows)
    assert {x["doc_id"] for x in simhash.keep(docs(spark, rows)).collect()} == want and len(want) == 39


def test_near_duplicates_judged_by_whole_sets(spark):
    r = random.Random(8)
    rows = []
    for i in range(60):  # one replaced piece; likeness just above or below 0.8
        w = invented(r, 1500)
        k = int((1496 * 0.2 / 1.8)) - 4 + (1 if i % 2 else -1) * r.randrange(1, 8)
        rows += [(i, " ".join(w)), (1000 + i, " ".join(w[:700] + invented(r, k) + w[700 + k :]))]
    want = plain_kept(rows)
    assert {x["doc_id"] for x in simhash.keep(docs(spark, rows)).collect()} == want and 80 < len(want) < 100


def test_sketches_pass_all_alike_sets():
    r = np.random.default_rng(3)
    for size in (1, 5, 40, 64, 65, 70, 200, 4000):
        a, b, far = [], [], []
        for _ in range(400):
            k = max(1, int(size * 0.1))
            x = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
            y = np.unique(np.concatenate([x[r.permutation(len(x))[: len(x) - k]], r.integers(0, 1 << 63, max(0, k - 1), dtype=np.uint64)]))
            if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
                a.append(simhash.sketch(x).tobytes())
                b.append(simhash.sketch(y).tobytes())
            far.append(simhash.sketch(np.unique(np.concatenate([x[::20], r.integers(0, 1 << 63, size, dtype=np.uint64)]))).tobytes())
        if a:
            got = simhash.shared(a, b)
            assert (got >= simhash.SHARED).all() and got.mean() > 0.7
            want = [len(set(np.frombuffer(p, "u4")) & set(np.frombuffer(q, "u4"))) / max(len(p) // 4, len(q) // 4) for p, q in zip(a, b)]
            assert got == pytest.approx(want)
            if size >= 40:
                assert (simhash.shared(a, far[: len(a)]) < simhash.SHARED).mean() > 0.99


def test_minhash(spark):
    base = prose(40, 1, 200)
    rows = [(2 * i, t) for i, t in enumerate(base)] + [(900, None), (901, ""), (902, "é b"), (902, "é b"), (None, "first one here")]
    got = minhash.edited(docs(spark, rows)).collect()
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want = {}
    errors = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        want.setdefault((i, len(t), hashlib.sha256(e.encode()).hexdigest()), []).append((shingles(t), shingles(e)))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter({k: len(v) for k, v in want.items()})
    for r in got:
        a, b = want[r["doc_id"], r["n_chars"], r["edited_sha256"]][0]
        if len(a) > 30:
            errors.append(abs(r["near_edited"] - len(a & b) / len(a | b)))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == 256
    assert np.mean(errors) < 0.06
    same = {r["fingerprint"] for r in got if r["doc_id"] == 902}
    assert len(same) == 1 and minhash.edited(docs(spark, [])).count() == 0
    one = minhash.edited(docs(spark, [(7, "ab cd")])).first()
    assert one["near_next"] == 1.0


def _plain_minhash(text):
    """One-permutation MinHash by single steps: bins, least hashes, borrowing by each bin's own order."""
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    h64 = lambda b, seed: xxhash.xxh64_intdigest(b, seed)
    w = [h64(x, 42) for x in text.lower().encode().split()]
    many = [w[i : i + 5] for i in range(max(1, len(w) - 4))] if w else []
    bins = {}
    for s in many:
        h = 42
        for x in s:
            h = h64(x.to_bytes(8, "little"), h)
        k, v = h % 128, h >> 8
        bins[k] = min(v, bins.get(k, v))
    if not bins:
        return "00" * 128
    out = []
    for k in range(128):
        step, at = xxhash.xxh64_intdigest(str(k), 7) % 128 | 1, k
        while at not in bins:
            at = (at + step) % 128
        out.append(bins[at] & 255)
    assert sign(0) == 0
    return bytes(out).hex()


def test_minhash_against_single_steps(spark):
    rows = list(enumerate([*prose(25, 31, 300), "", " ", "one", "one two three four", "one two three four five", "One TWO three four five", "long words " * 30_000]))
    got = {r["doc_id"]: r for r in minhash.edited(docs(spark, rows)).collect()}
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edit = t[: len(t) - half] + n[:half]
        f, e, nf = (_plain_minhash(x) for x in (t, edit, n))
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (f, e)
        for name, y in (("near_edited", e), ("near_next", nf)):
            same = sum(f[k : k + 2] == y[k : k + 2] for k in range(0, 256, 2)) / 128
            words = [bool(x.strip()) for x in (t, edit if y is e else n)]
            want = 1.0 if not any(words) else 0.0 if not all(words) else max(0.0, (same - 1 / 256) / (1 - 1 / 256))
            assert got[i][name] == pytest.approx(want)


def test_suffix_sorting():
    r = random.Random(5)
    for _ in range(150):
        t = np.array([r.choice(b"ab\x00\xff"[: r.randrange(1, 5)]) for _ in range(r.randrange(0, 60))], np.uint8)
        b = t.tobytes()
        want = sorted(range(len(t)), key=lambda i: b[i:])
        assert suffix.sort_suffixes(t).tolist() == want
        if len(t) > 10:
            chosen = np.array(sorted(r.sample(range(len(t)), 5)))
            got = suffix.sort_suffixes(t, chosen, 8).tolist()
            keys = [(b + bytes(80))[i : i + 8] for i in got]
            assert keys == sorted(keys) and sorted(got) == chosen.tolist()


def _plain_repeats(rows):
    first = {}
    for i, t in sorted(rows):
        for s in range(len(t) - 49):
            first.setdefault(t[s : s + 50], i)
    out = []
    for i, t in rows:
        m = bytearray(len(t))
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < i:
                m[s : s + 50] = b"\x01" * 50
        kept = bytes(c for c, x in zip(t, m) if not x)
        spans = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out.append((i, len(t), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [1000, 0])
def test_repeats(spark, hot):
    r = random.Random(1)
    base = ["".join(r.choice("ab ") for _ in range(r.randrange(30, 400))) for _ in range(30)] + ["x" * 200, "ab" * 150]
    rows = []
    for i in range(100):
        t = r.choice(base)
        for _ in range(r.randrange(0, 4)):
            p = r.randrange(0, len(t))
            t = t[:p] + r.choice(["é", "zz", r.choice(base)[:120]]) + t[p + r.randrange(0, 9) :]
        rows.append((i, t))
    rows += [(5, rows[9][1]), (200, rows[3][1]), (200, rows[3][1]), (300, ""), (301, None)]
    got = repeats.remove_repeats(docs(spark, rows).repartition(5), hot)
    assert sorted(map(tuple, got.collect())) == _plain_repeats([(i, (t or "").encode()) for i, t in rows])
    assert repeats.remove_repeats(docs(spark, [])).count() == 0


def test_repeats_of_long_null_and_equal_rows(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    long = " ".join(word() for _ in range(60_000))
    rows = [(None, long[:5000]), (1, long), (2, "x" + long[100_000:100_400]), (3, None), (3, None), (4, ""), (None, long[:5000]), (5, "é" * 40 + long[:80])]
    got = sorted(map(tuple, repeats.remove_repeats(docs(spark, rows)).collect()), key=str)
    key = lambda i: -(1 << 63) if i is None else i
    want = _plain_repeats([(key(i), (t or "").encode()) for i, t in rows])
    assert got == sorted(((None if i == key(None) else i, *x) for i, *x in want), key=str)


def test_dedupe_keeps_columns(spark):
    long = "one passage of well over fifty bytes that two documents share, "
    d = docs(spark, [(1, long + "a"), (2, "b é " + long), (3, long + "a"), (4, None), (None, "c"), (None, "c")]).withColumn("n_chars", F.length("text"))
    names = ["_text", "_key", "_sha", "_s1", "_first", "_left", "key", "sha", "row", "first", "left", "lead", "n", "kept", "_j_h"]
    for k, n in enumerate(names):
        d = d.withColumn(n, F.lit(f"own {k}"))
    d = d.withColumn("with.dot", F.lit(True))
    rows = repeats.dedupe(d).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 6 and got[1]["text"] == long + "a" and got[2]["text"] == "b é " and got[2]["n_chars"] == 4 and got[3]["text"] == "" and got[4]["n_chars"] == 0
    assert got[4]["text"] is None and [r["text"] for r in rows if r["doc_id"] is None] == ["c", "c"]
    assert repeats.dedupe(d).schema == d.schema or repeats.dedupe(d).dtypes == d.dtypes
    assert all(r[n] == f"own {k}" for r in rows for k, n in enumerate(names)) and repeats.dedupe(d.limit(0)).count() == 0


def test_quality(spark):
    good = prose(120, 3)
    rows = [(i, t) for i, t in enumerate(good)] + [(1000 + i, " ".join(w.upper() + "!!" for w in t.split())) for i, t in enumerate(good)]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows] + [(5000, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows + TEXTS)
    got = {r["doc_id"]: r for r in quality.score(d, quality.fit(d, labels)).collect() if r["doc_id"] is not None}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == (i < 1000) for i in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = quality.score(docs(spark, TEXTS), quality.fit(d, labels.limit(0))).collect()
    assert len(none) == len(TEXTS) and {r["score"] for r in none} == {0.5}
    assert quality.keep(d, quality.fit(d, labels)).columns == d.columns


def test_votes_against_single_cosines(spark):
    texts = prose(60, 41, 90) + ["", "zz zz zz", "A\nA\nB " * 50]
    d = docs(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    m = quality.fit(d, labels)
    n = len(m["z"])
    assert n == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(50))
    got = {r["doc_id"]: r for r in quality.score(d, m).collect()}
    unit = lambda v: v / max(float(np.linalg.norm(v)), 1e-9)
    for i, t in enumerate(texts):
        z = unit((unit(unit(quality.features(t.encode())) * m["idf"]) - m["mean"]) @ m["axes"])
        near = sorted(range(n), key=lambda k: -float(z @ m["z"][k]))[: quality.K]
        w = [max(float(z @ m["z"][k]), 1e-3) ** quality.POWER * float(m["w"][k]) for k in near]
        want = sum(x * float(m["y"][k]) for x, k in zip(w, near)) / sum(w)
        assert got[i]["score"] == pytest.approx(want, abs=1e-4) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_leading_directions(monkeypatch):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((900, 300)) * 0.97 ** np.arange(300)).astype(np.float32)
    x = np.concatenate([x, np.zeros((900, quality.PAIRS + quality.EXTRA - 300), np.float32)], axis=1)
    want = np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1][:, : quality.DIMS]
    sizes, whole = [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda a: sizes.append(len(a)) or whole(a))
    packed = [r.tobytes() for r in np.abs(x).astype(np.float16)]
    model = quality._model(packed, np.arange(900) % 2, {0: 5, 1: 9})
    assert max(sizes) < 1000  # no decomposition of the whole matrix in the driver
    assert model["z"].shape == (900, quality.DIMS) and np.isfinite(model["z"]).all()
    got = quality.leading(x, quality.DIMS)
    assert np.linalg.svd(got.T @ want)[1].min() > 0.9999  # the same space
    assert np.isfinite(quality.leading(np.zeros((1, 300), np.float32), 4)).all()


def test_quality_sample_with_repeated_ids(spark):
    rows = [(7, f"text {k} of one id") for k in range(300)] + list(enumerate(prose(30, 2), 100))
    d = docs(spark, rows)
    m = quality.fit(d, spark.createDataFrame([(i, i % 2) for i in (7, *range(100, 130))], "doc_id long, quality int"))
    used = [i for i in (7, *range(100, 130)) if zlib.crc32(str(i).encode()) % 5 != 0]
    assert len(m["z"]) == len(used)  # a row for each label, however often its id occurs


def test_lattice_against_all_segmentations():
    lat, prior = lattice.vocabulary(PIECES)
    lp = np.log(np.maximum(prior, 1e-30))

    def brute(s):
        if not s:
            return 1.0
        total = 0.0
        for j in range(1, len(s) + 1):
            k = lat.ids.get(s[:j])
            if k is not None:
                total += math.exp(lp[k]) * brute(s[j:])
            elif j == 1:
                total += math.exp(lat.fallback(ord(s[0]), lp)) * brute(s[j:])
        return total

    words = ["the", "aé☃b", "x", "a.b,c", "ththe"]
    assert np.allclose(lat.forward(words, lp), [math.log(brute(lattice.MARK + w)) for w in words])
    long = "ab" * 100
    assert np.isfinite(lat.forward([long], lp)).all()
    e = lat.expected(["the", long], np.ones(2), lp)
    k = int(np.argmax(e))
    q = lp.copy()
    q[k] += 1e-6
    assert e[k] == pytest.approx((lat.forward(["the", long], q) - lat.forward(["the", long], lp)).sum() / 1e-6, rel=1e-3)


def _segmentations(lat, s, lp):
    """(pieces, log probability) of every way to cut ``s``; pieces outside the vocabulary by bytes."""
    if not s:
        return [((), 0.0)]
    out = []
    for j in range(1, len(s) + 1):
        k = lat.ids.get(s[:j])
        own = [k] if k is not None else [lat.byte_ids[x] for x in s[0].encode()] if j == 1 else None
        if own is not None:
            out += [((*own, *rest), sum(lp[x] for x in own) + p) for rest, p in _segmentations(lat, s[j:], lp)]
    return out


def test_lm_scores(spark):
    rows = [(i, t) for i, t in enumerate(prose(50, 4))] + TEXTS
    got = lattice.score(docs(spark, rows), PIECES).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c, ends = Counter(), 0
    for i, t in rows:
        if not out(i):
            c.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    # the model by single steps: every segmentation of every word, twice
    lat, prior = lattice.vocabulary(PIECES)
    lp = np.log(np.maximum(prior, 1e-30))
    for _ in range(lattice.ROUNDS):
        weight = lattice.PRIOR * prior
        for w, k in c.items():
            ways = _segmentations(lat, lattice.MARK + w.decode(), lp)
            total = sum(math.exp(p) for _, p in ways)
            for pieces, p in ways:
                for x in pieces:
                    weight[x] += k * math.exp(p) / total
        weight[-1] = ends
        lp = np.log(np.maximum(weight / weight.sum(), 1e-30))
    word = {}
    want = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        for x in w:
            if x not in word:
                word[x] = math.log10(sum(math.exp(p) for _, p in _segmentations(lat, lattice.MARK + x.decode(), lp)))
        score = sum(word[x] for x in w) + lp[-1] / math.log(10)
        want.setdefault((str(i), out(i), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n), []).append((base, score))
    assert Counter((str(r[0]), *r[1:5]) for r in got) == Counter({k: len(x) for k, x in want.items()})
    for r in got:
        assert any(r["base_score"] == pytest.approx(b, rel=1e-6) and r["score"] == pytest.approx(x, rel=1e-6) for b, x in want[(str(r[0]), *r[1:5])])
    assert lattice.score(docs(spark, []), PIECES).count() == 0


def test_decontamination(spark):
    items = [(k, t) for k, t in enumerate(prose(40, 7, 40))] + [(90, None), (91, ""), (92, "...")]
    clean = prose(60, 8, 400)
    rows = [(i, t) for i, t in enumerate(clean)]
    for k, t in items[:20]:
        w = clean[k].split()
        rows.append((500 + k, " ".join([*w[: len(w) // 2], t.upper(), *w[len(w) // 2 :]])))
    d, b = docs(spark, rows + TEXTS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()}
    assert {(500 + k, k) for k in range(20)} <= got and all(i >= 500 for i, _ in got)
    index = decontaminate.Index(items)
    for c in index.classes:  # block-max WAND finds what a full scan finds
        for t in clean[:20] + [t for _, t in items[:20]]:
            terms = list({index.vocab[w] for w in decontaminate.words(t) if w in index.vocab})
            full = {}
            for x in terms:
                for at, s in zip(*c["postings"].get(x, ([], []))):
                    full[c["own"][at]] = full.get(c["own"][at], 0) + s
            assert {k for k, _ in index.wand(c, terms)} == {k for k, s in full.items() if s >= decontaminate.THRESHOLD - 1e-9}
    assert decontaminate.keep(d, b).filter("doc_id >= 500").count() == 0 and decontaminate.keep(d, b).count() == len(clean) + len(TEXTS)
    assert decontaminate.leaks(d, b.limit(0)).count() == 0 and decontaminate.leaks(docs(spark, []), b).count() == 0


def test_decontamination_with_many_indexes(spark):
    """Statistics cover all items, so a score doesn't depend on how many items an index holds."""
    items = [(k, t) for k, t in enumerate(prose(60, 7, 40))] + [(61, "odd words only here"), (61, "odd words only here"), (62, None)]
    clean = prose(30, 8, 400)
    r = random.Random(3)
    rows = list(enumerate(clean))
    for k, t in items[:40]:  # parts of items as well, near the threshold
        w, x = clean[k % 30].split(), t.split()
        rows.append((500 + k, " ".join([*w[:40], *x[: r.randrange(len(x) * 3 // 4, len(x) + 1)], *w[40:]])))
    d, b = docs(spark, [*rows, (None, items[3][1]), (9, "")]), spark.createDataFrame(items, "item_id long, text string")
    shown = lambda x: sorted((str(r[0]), r[1], *(round(v, 9) for v in r[2:])) for r in x.collect())
    one, many = shown(decontaminate.leaks(d, b)), shown(decontaminate.leaks(d, b, shard=9))
    assert one == many and len(one) >= 10
    kept = lambda x: sorted(str(r["doc_id"]) for r in x.collect())
    assert kept(decontaminate.keep(d, b)) == kept(decontaminate.keep(d, b, shard=9))


def test_bounds_of_blocks():
    index = decontaminate.Index(list(enumerate(prose(100, 5, 50))))
    r = np.random.default_rng(1)
    for c in index.classes:
        half = np.sort(r.integers(0, 40, 600))
        pairs = np.unique(half * len(index.vocab) + r.integers(0, len(index.vocab), 600))
        half, term = pairs // len(index.vocab), pairs % len(index.vocab)
        dense = np.zeros((42, c["blocks"]))
        for h, t in zip(half, term):
            for block, x in c["bounds"].get(int(t), {}).items():
                dense[h, block] += x
        for cells in (1 << 22, c["blocks"] * 7):
            decontaminate.CELLS, was = cells, decontaminate.CELLS
            got = index.best_bounds(c, half, term, 41)
            decontaminate.CELLS = was
            assert np.allclose(got, (dense[:-1] + dense[1:]).max(1)[:41])


def test_tokenizers_agree():
    import tiktoken
    from tokenizers import Tokenizer

    r = random.Random(2)
    al = list("ab'strevelmd  \n\t12.,!éß\u00a0\u3000中á\x1c\x85½<|endoftext|>\x00")
    texts = ["".join(r.choices(al, k=r.randrange(0, 60))) for _ in range(1500)] + ["", "a" * 3000, " " * 500, "x'" * 300, "don't 're" * 40, "\x00", "a\x00", "ab" * 400_000 + " c"]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})
    assert [x.tolist() for x in bpe.coder(RANKS)(texts)] == [enc.encode_ordinary(t) for t in texts]
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    assert [x.tolist() for x in tokenfile.coder(JSON)(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_piece_coder_forgets():
    c = pretoken.PieceCoder(lambda ps: [[ord(x) for x in p] for p in ps], most=20)
    texts = prose(200, 9)
    assert all("".join(map(chr, ids)) == t for _ in range(2) for t, ids in zip(texts, (c([x])[0] for x in texts)))


def test_bpe_round_trip(spark):
    got = bpe.decode(bpe.encode(docs(spark, TEXTS), RANKS), RANKS).collect()
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((t or "").encode() for _, t in TEXTS)
    first = bpe.encode(docs(spark, [(1, "naïve café")]), RANKS).first()
    at, ids = np.frombuffer(first["offsets"], "<u4"), np.frombuffer(first["ids"], "<u4")
    assert [len(bpe.vocabulary(RANKS)[i]) for i in ids] == np.diff([*at, len("naïve café".encode())]).tolist()
    assert bpe.encode(docs(spark, []), RANKS).count() == 0


def test_bpe_decodes_by_offsets(spark):
    text = "naïve café ☃ 12's " * 50
    row = bpe.encode(docs(spark, [(1, text)]), RANKS).first()
    ids, at = np.frombuffer(row["ids"], "<u4").astype(np.int64), np.frombuffer(row["offsets"], "<u4")
    assert bpe.place_tokens(ids, at, RANKS) == text.encode()
    assert bpe.place_tokens(ids[7:30], at[7:30], RANKS) == text.encode()[at[7] : at[30]]  # a part by itself
    back = np.random.default_rng(0).permutation(len(ids))
    assert bpe.place_tokens(ids[back], at[back], RANKS) == text.encode()  # places count, not order
    rows = [(1, None, None), (2, row["ids"], None), (3, row["ids"], row["offsets"]), (3, row["ids"], row["offsets"]), (None, b"", b"")]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary, offsets binary"), RANKS).collect()
    assert [r["decoded"] and bytes(r["decoded"]) for r in sorted(got, key=lambda r: r["doc_id"] or 0)] == [b"", None, *[text.encode()] * 3]


def test_huffman():
    r = np.random.default_rng(0)
    counts = (r.pareto(1, 50_000) * 5).astype(np.int64)
    lens = tokenfile.code_lengths(counts)
    assert lens.max() <= tokenfile.MAX_BITS and (2.0 ** -lens[lens > 0].astype(float)).sum() == pytest.approx(1)
    ids = r.choice(np.flatnonzero(counts), 5000)
    keys, got = tokenfile.read_file(tokenfile.write_file(ids, [None, 3, 3, 9], np.array([0, 1, 2000, 2999], "<u8"), lens, tokenfile.canonical(lens)))
    assert keys == [None, 3, 3, 9] and [len(x) for x in got] == [0, 1, 2000, 2999] and (np.concatenate(got) == ids).all()
    assert tokenfile.code_lengths(np.array([0, 7])).tolist() == [0, 1]


def test_token_files(spark):
    rows = [(i, t) for i, t in enumerate(prose(200, 6), 10)] + [(1, ""), (2, None), (3, "one")]
    got = sorted(tokenfile.read_files(tokenfile.write_files(docs(spark, rows), JSON)).collect())
    at = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: x[0])):
        ids = np.append(tokenfile.coder(JSON)([t or ""])[0], 0).astype("<u4")
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenfile.read_files(tokenfile.write_files(docs(spark, []), JSON)).count() == 0


def test_token_files_of_null_equal_and_long_rows(spark):
    rows = [(None, "b"), (5, "x y " * 60_000), (5, "x"), (5, "x"), (7, None), (8, "a<|endoftext|>b"), (9, "")]
    got = tokenfile.read_files(tokenfile.write_files(docs(spark, rows).repartition(3), JSON)).collect()
    want = {}
    for i, t in rows:
        ids = np.append(tokenfile.coder(JSON)([t or ""])[0], 0).astype("<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert {i: sorted((r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] == i) for i in want} == {i: sorted(x) for i, x in want.items()}
    ends = sorted((r["start"], r["start"] + r["n_tokens"], r["doc_id"] or 0) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] and a[2] <= b[2] for a, b in zip(ends, ends[1:]))


def test_urls(spark):
    from linkloom.llm.queries import URL_RULES

    page = lambda i, u: (i, u, "h", "p")
    pages = [page(1, "https://a.EXAMPLE.com/en/76?x"), page(2, "http://example.com/en/8#t"), page(3, "http://x.net/de/1"), page(4, "http://example.net/de/80"), page(5, None), page(6, "no scheme"), page(7, "ftp://notorg/es/1"), page(8, "http://org/es/"), page(8, "http://org/es/"), page(9, "http://h://x/y")]
    pages += [page(None, "http://bad.site/spam/1.html"), page(None, "http://bad.site/spam/1.html"), page(10, "http://long.site/" + "a/" * 3000 + "é"), page(11, "")]
    pages += [page(100 + i, f"http://bad.site/spam/{i}.html") for i in range(60)] + [page(300 + i, f"http://bad.site/fine/{i}") for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, host string, template string")
    labels = spark.createDataFrame([(100 + i, 1) for i in range(40)] + [(300 + i, 0) for i in range(40)] + [(100, 0)], "page_id long, bad int")
    rows = urls.judge(df, labels, URL_RULES).collect()
    got = {r["page_id"]: tuple(r)[1:5] for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == ("a.example.com", "/en/76", "example.com/en/7", "allow") and got[2][2:] == ("com/en/", "block")
    assert got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block")
    assert got[5] == ("", "", None, "allow") and got[6][:2] == ("", "") and got[7] == ("notorg", "/es/1", None, "allow") and got[8][3] == "block"
    assert got[10][1] == "/" + "a/" * 3000 + "é" and got[11][:2] == ("", "") and got[None][3] == "block"
    assert all(got[100 + i][3] == "block" for i in range(60)) and all(got[300 + i][3] == "allow" for i in range(60))
    assert urls.judge(df, labels.limit(0), []).count() == len(pages) and urls.judge(df.limit(0), labels, URL_RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(df, None, []).collect()} == {"allow"}


def test_url_templates_at_any_fan_out_and_depth(spark):
    paths = [f"/s{chr(97 + k // 26)}{chr(97 + k % 26)}/p{i}x" for k in range(60) for i in range(20)]
    deep = [f"/a/b/c/{kind}/{i}/z" for kind in ("spam", "fine") for i in range(60)]
    pages = [(k, "http://wide.site" + p) for k, p in enumerate(paths)] + [(5000 + k, "http://deep.site" + p) for k, p in enumerate(deep)]
    pages += [(9000, "http://wide.site"), (9001, "http://wide.site/")]
    bad = lambda i, u: int("/sbh/" in u or "/spam/" in u)
    labels = spark.createDataFrame([(i, bad(i, u)) for i, u in pages if i < 9000 and i % 20 < 15], "page_id long, bad int")
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), labels, []).collect()}
    assert len(got) == len(pages) and all(got[i]["verdict"] == ("block" if bad(i, u) else "allow") for i, u in pages)
    # unlabelled pages go with labelled siblings that vary without effect; other names are kept
    assert got[0]["template"] == got[19]["template"] == "/*/*/" and got[5000]["template"] == "/a/b/c/spam/{n}/z/" and got[9000]["template"] == got[9001]["template"]


def _plain_templates(pages):
    """{(host, path): template} of (host, path, bad) pages, by single comparisons."""
    def kind(x):
        if x.isascii() and x.isdigit():
            return "{n}"
        stem, _, end = x.partition(".")
        return "{n}." + end if stem.isascii() and stem.isdigit() and end.isascii() and end.isalpha() and len(end) <= 5 else x

    known = {}
    for h, p, bad in pages:
        typed = "/".join(kind(x) for x in p.removeprefix("/").split("/"))
        x = known.setdefault((h, typed), [0, 0])
        if bad is not None:
            x[0], x[1] = x[0] + 1, x[1] + bad
    rows = [[h, p, [] if not p.rstrip("/") else p.rstrip("/").split("/"), *x, ""] for (h, p), x in known.items()]
    done, d = {}, 0
    while rows:
        parents = {}
        for r in rows:
            parents.setdefault((r[0], r[5]), []).append(r)
        rows = []
        for own in parents.values():
            lab, bad = sum(r[3] for r in own), sum(r[4] for r in own)
            children = {}
            for r in own:
                if len(r[2]) < d:
                    done[r[0], r[1]] = r[5]
                elif len(own) == 1 or not lab:
                    done[r[0], r[1]] = r[5] + "/" + "/".join([*r[2][d:], ""])
                else:
                    children.setdefault(r[2][d] if d < len(r[2]) else "", []).append(r)
            alike = set()
            for name, kids in children.items():
                n, b = sum(r[3] for r in kids), sum(r[4] for r in kids)
                share = (bad + 0.5) / (lab + 1)
                if name and n and lab - n and abs(b / n - (bad - b) / (lab - n)) <= urls.Z * math.sqrt(share * (1 - share) * (1 / n + 1 / (lab - n))):
                    alike.add(name)
            for name, kids in children.items():
                loose = name and not sum(r[3] for r in kids) and len(alike) >= urls.QUORUM
                for r in kids:
                    r[5] += "/" + ("*" if name in alike or loose else name)
                    rows.append(r)
        d += 1
    return done


def test_url_tree_against_single_comparisons(spark):
    r = random.Random(17)
    word = lambda n: r.choice("abcdefghijklm"[:n])
    pages = []
    for i in range(900):
        segs = [word(3), word(13), r.choice(["{}", "{}.html", "x{}", "y"]).format(r.randrange(40)), "end", ""][: r.randrange(0, 6)]
        pages.append((i, r.choice(["one.site", "two.site", "three.site"]), "".join("/" + s for s in segs)))
    tell = {i: None if r.random() < 0.4 else int(r.random() < (0.9 if p.startswith("/b") else 0.1)) for i, h, p in pages}
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, h, p in pages], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, b in tell.items() if b is not None], "page_id long, bad int")
    got = {x["page_id"]: x for x in urls.judge(df, labels, []).collect()}
    tree = _plain_templates([(h, p, tell[i]) for i, h, p in pages])
    kinds = {}
    for i, h, p in pages:
        typed = "/".join("{n}" if x.isdigit() else "{n}.html" if x.endswith(".html") else x for x in p.removeprefix("/").split("/"))
        kinds[i] = (h, tree[h, typed])
        assert got[i]["template"] == kinds[i][1]
    base = sum(b for b in tell.values() if b is not None) / sum(b is not None for b in tell.values())
    for i, k in kinds.items():
        own = [tell[j] for j in kinds if kinds[j] == k and tell[j] is not None]
        reject = bool(own) and sum(own) >= urls.REJECT * len(own) and (sum(own) + urls.PRIOR * base) / (len(own) + urls.PRIOR) >= urls.REJECT
        assert got[i]["verdict"] == ("block" if reject else "allow")
    assert len(set(kinds.values())) > 20 and {"block", "allow"} == {x["verdict"] for x in got.values()}


def test_any_number_of_rules(spark):
    r = random.Random(23)
    hosts = [f"{a}{b}.site" for a in ("", "x.", "y.x.") for b in "abcde"] + ["site", ""]
    rules = [(r.choice(["block", "allow"]), r.choice(hosts) + r.choice(["", "/", f"/{r.randrange(90)}", f"/{r.randrange(9)}/{r.randrange(90)}"])) for _ in range(3000)]
    pages = [(i, f"http://{r.choice(['', 'www.'])}{r.choice(hosts[:-1])}/{r.randrange(99)}/{r.randrange(99)}") for i in range(300)] + [(900, None), (901, "http:///x")]
    df = spark.createDataFrame([*pages, pages[0]], "page_id long, url string")
    got = Counter(tuple(x)[:5] for x in urls.judge(df, None, rules).collect())

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, slash, path = rest.partition("/")
        fit = [(len(x), x, v) for v, x in rules for h, s, p in [x.partition("/")] if (not h or host == h or host.endswith("." + h)) and (slash + path).startswith(s + p)]
        return (host, slash + path, *(max(fit)[1:] if fit else (None, "allow")))

    want = Counter((i, *plain(u)) for i, u in [*pages, pages[0]])
    assert {k: v for k, v in got.items() if k[3]} == {k: v for k, v in want.items() if k[3]} and {k[:4] for k in got} == {k[:4] for k in want}
    few = rules[:100]
    shown = lambda n: sorted(map(str, urls.judge(df, None, few, inline=n).collect()))
    assert shown(100) == shown(0)  # both routes say the same


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    good = prose(80, 11, 120)
    leak = prose(1, 12, 60)[0]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [(200, good[0], "en", "s", 1), (201, good[1] + " " + leak, "en", "s", 1)]
    rows += [(300 + i, " ".join(w.upper() + "!!" for w in t.split()), "en", "s", 1) for i, t in enumerate(good)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 300), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for k, (_, fn) in enumerate(corpus_pipeline.STAGES):
        fn(spark, d, sf).write.parquet(f"{sf}/out{k}")
        d = spark.read.parquet(f"{sf}/out{k}")
        kept.append({r["doc_id"] for r in d.collect()})
        if k < 4:
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not any(i >= 300 for i in kept[0]) and len(kept[0] & set(range(80))) >= 78
    assert 200 in kept[0] and 200 not in kept[1] and 201 in kept[2] and 201 not in kept[3] and kept[4] == kept[3]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == kept[4]


def test_pipeline_stages_with_hostile_rows(spark, tmp_path):
    """Nulls, empties, ties, repeated rows, a very long text, clashing names, and empty tables."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    good = prose(40, 51, 120)
    passage = " ".join(prose(1, 52, 60) * 3)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [(None, None, None, None, None), (None, good[0], None, None, 3), (50, None, "en", "s", 0), (51, "", "en", "s", 0), (52, " \n", "", "", 2), (52, " \n", "", "", 2)]
    rows += [(60, "very long " + " ".join(prose(1, 53, 60) * 900), "en", "s", 1), (61, good[1], "en", "s", 1), (61, good[1], "en", "s", 1), (62, good[2] + " " + passage, "en", "s", 1), (63, good[3] + " " + passage, "en", "s", 1)]
    extra = ["fp", "n", "key", "sha", "row", "first", "left", "component_id", "ids", "_text", "score"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in extra)
    d = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, good[5]), (1, good[5]), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, empty in (("all", False), ("none", True)):
        x = d.limit(0) if empty else d
        sizes = []
        for k, (_, fn) in enumerate(corpus_pipeline.STAGES):
            fn(spark, x, sf).write.parquet(f"{sf}/{name}{k}")
            x = spark.read.parquet(f"{sf}/{name}{k}")
            sizes.append(x.count())
            if k < 4:
                assert x.columns == d.columns
                assert x.filter("fp <> 'fp' or n <> 'n' or _text <> '_text' or row <> 'row'").count() == 0
            got = {r["doc_id"]: r for r in x.collect()}
            if empty:
                assert not got
            elif k == 0:
                assert sizes[0] == len(rows)  # all labels are good, so nothing goes
            elif k == 1:
                assert 61 not in got and 52 not in got and {None, 50, 60, 62, 63} <= set(got) and len([1 for r in x.collect() if r["doc_id"] is None]) == 2
            elif k == 2:
                assert passage in got[62]["text"] and passage[20:] not in got[63]["text"] and got[50]["text"] is None
            elif k == 3:
                assert 5 not in got and 60 in got
            else:
                assert got[50]["n_tokens"] == 0 and got[60]["n_tokens"] > 10_000
