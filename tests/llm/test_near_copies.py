"""Near copies by five-word shingles, against all pairs."""

import numpy as np

import corpus_pipeline
from plumbline.llm import near_copies

from .helpers import SCHEMA, empty, prose


def grams(text):
    parts = (text or "").lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def brute_stay(rows):
    """Positions of rows that stay by all pairs."""
    sets = [grams(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    best = {}
    for i, (d, t, *_) in enumerate(rows):
        best.setdefault(find(i), []).append((d is None, d or 0, i))
    return sorted(min(x)[2] for x in best.values())


def varied():
    """Texts of 150 words with 0 to 6 words changed, apart from each other, and a hundred near copies of one."""
    rng = np.random.default_rng(4)
    rows = []
    for base in range(60):
        words = [f"w{x}" for x in rng.integers(0, 3000, 150)]
        for _ in range(100 if base == 0 else 3):
            mine = list(words)
            for at in rng.integers(0, 150, rng.integers(0, 3 if base == 0 else 7)):
                mine[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(mine), "en", "s", 1))
    return rows


def test_near_copies_by_brute_force(spark):
    rows = varied() + [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "two words", "en", "s", 1), (903, "Two  words", "en", "s", 1)]
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    want = [rows[i][0] for i in brute_stay(rows)]
    assert got == want and len(want) < 200
    assert corpus_pipeline.drop_near_copies(spark, empty(spark), "").count() == 0


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_all_near_pairs_beside_hubs(spark):
    """Whatever the hub and the components: every near pair across components of which one isn't near the hub, and no other."""
    rng = np.random.default_rng(11)
    base = list(range(60))
    sets = {}
    for n in range(150):
        mine = set(base)
        for _ in range(rng.integers(0, 9)):
            mine.discard(int(rng.choice(base)))
        for _ in range(rng.integers(0, 9)):
            mine.add(1000 + int(rng.integers(0, 40 if n % 2 else 4000)))
        if n % 10 == 0:
            mine = {x + 500 for x in mine}
        sets[n] = mine
    sets[150] = set(range(2000, 2030))
    for hubs, roots in (([0], {n: n for n in sets}), ([3, 150], {n: n // 3 for n in sets}), ([20, 1], {n: min(n, 60) for n in sets})):
        made = spark.createDataFrame([(n, sorted(s)) for n, s in sets.items()], "node long, grams array<long>")
        open_ = spark.createDataFrame([(n, h) for h in hubs for n in sets if n != h], "node long, hub long")
        deltas = near_copies._deltas(open_, made)
        found = near_copies._beside_hubs(deltas, spark.createDataFrame(list(roots.items()), "node long, root long"))
        got = {tuple(sorted((r["a"], r["b"]))) for r in found.collect()}
        want = {
            (a, b) for b in sets for a in range(b) if roots[a] != roots[b] and near(sets[a], sets[b])
            and any(h not in (a, b) and not (near(sets[a], sets[h]) and near(sets[b], sets[h])) for h in hubs)
        }
        assert got == want and want
        at_hub = {(r["hub"], r["node"]) for r in deltas.where(near_copies._NEAR_HUB).collect()}
        assert at_hub == {(h, n) for h in hubs for n in sets if n != h and near(sets[h], sets[n])}


def test_a_hot_group_makes_few_pairs(spark):
    """Of 400 near copies of one text, some too far from most, no number of pairs that grows with the group's square."""
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 3000, 200)]
    rows = []
    for n in range(400):
        words = list(base)
        for at in rng.integers(0, 200, 6 if n % 8 == 0 else 2):
            words[at] = f"x{rng.integers(0, 10**9)}"
        rows.append((n, " ".join(words), "en", "s", 1))
    sets = {n: {hash(g) % 2**62 for g in grams(t)} for n, t, *_ in rows}
    made = spark.createDataFrame([(n, sorted(s)) for n, s in sets.items()], "node long, grams array<long>")
    deltas = near_copies._deltas(spark.createDataFrame([(n, 1) for n in sets if n != 1], "node long, hub long"), made)
    out = deltas.where(f"not ({near_copies._NEAR_HUB})").count()
    assert 20 < out < 100
    made_pairs = []
    real = near_copies.durable
    near_copies.durable = lambda df, label: (made_pairs.append((label, real(df, label).count())), real(df, label))[1]
    try:
        near_copies._beside_hubs(deltas, spark.createDataFrame([(n, n) for n in sets], "node long, root long")).count()
    finally:
        near_copies.durable = real
    assert dict(made_pairs)["near-beside"] < 400 * 4
    got = sorted(r["doc_id"] for r in near_copies.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [rows[i][0] for i in brute_stay(rows)]


def test_unsettled_groups_have_a_hub(spark):
    dealt = spark.createDataFrame([(1, n) for n in range(20)] + [(2, n) for n in range(100, 120)] + [(3, n) for n in range(3)], "key long, node long")
    roots = spark.createDataFrame([(n, 0) for n in range(19)] + [(n, 100) for n in range(100, 120)], "node long, root long")
    assert {(r["node"], r["hub"]) for r in near_copies._around_hubs(dealt, roots).collect()} == {(n, 0) for n in range(1, 20)}


def test_rows_that_share_a_doc_id_are_decided_one_by_one(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (2, a + " more", "en", "s", 1), (2, b, "en", "s", 1), (3, c, "en", "s", 1), (3, c, "en", "s", 1), (None, b, "en", "s", 1), (None, "alone here", "en", "s", 1)]
    got = near_copies.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, a), (2, b), (3, c), (0, "alone here")])


def test_language_and_toxicity_decide_by_row(spark, tmp_path):
    rows = [(i, prose(i % 6, 30), "en", "s", 1) for i in range(40)] + [(3, "12 34 !!", "en", "s", 1), (None, "56 78 !!", "en", "s", 1), (None, prose(2, 30), "en", "s", 1)]
    got = corpus_pipeline.drop_unknown_language(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted((d or 0, t) for d, t, *_ in rows if "!!" not in t)
    bad = "vile wretched filth " * 12
    rows = [(i, bad + f"v{i}" if i % 2 else prose(i % 6, 30), "en", "s", 1) for i in range(80)] + [(2, bad, "en", "s", 1), (None, bad, "en", "s", 1), (None, prose(2, 30), "en", "s", 1)]
    spark.createDataFrame([(i, i % 2) for i in range(80) if i != 2], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.drop_toxic(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted((d or 0, t) for d, t, *_ in rows if "vile" not in t)


def test_part_fingerprints_are_simhashes():
    """Each bit by the weight of the shingles that have it set, in plain arithmetic."""
    rng = np.random.default_rng(3)
    for scheme in (near_copies.WIDE, near_copies.DEEP):
        a, b, c, d = ([int(x) for x in row[:, 0]] for row in scheme.drawn())
        for n in (1, 2, 7, 40):
            found = np.sort(rng.integers(0, 2**64, n, dtype="u8"))
            want = []
            for part in range(scheme.parts):
                value = 0
                for piece in range(scheme.pieces):
                    k = part * scheme.pieces + piece
                    made = [int(g) for g in found]
                    weights = [(-np.log(((((g ^ a[k]) * (b[k] | 1)) % 2**64 >> 11) + 0.5) / 2**53)) ** -3 for g in made]
                    hashes = [(((g ^ c[k]) * (d[k] | 1)) % 2**64) >> 40 for g in made]
                    for bit in range(scheme.bits):
                        ones = sum(w for w, h in zip(weights, hashes, strict=True) if h >> (23 - bit) & 1)
                        value |= int(2 * ones > sum(weights)) << (piece * scheme.bits + bit)
                want.append(value)
            assert near_copies.part_fingerprints(found, scheme) == want
    assert near_copies.part_fingerprints(found[:0]) == []


def test_sets_at_the_threshold_meet():
    """Of sets of similarity 0.8 and little more, next to all are within the radius in one part."""
    rng = np.random.default_rng(5)
    for scheme, width, meets in ((near_copies.WIDE, 32, 1), (near_copies.DEEP, 39, near_copies.DEEP_MEETS)):
        met = []
        for n in (5, 9, 60, 200) * 100:
            drawn = rng.integers(0, 2**64, n + n // 9, dtype="u8")
            x, y = (drawn[: n - n // 5], drawn[:n]) if n < 9 else (drawn[:n], drawn[n // 9 :])
            assert near(set(x.tolist()), set(y.tolist()))
            both = [scheme.used(np.array(near_copies.part_fingerprints(np.sort(z), scheme), "u8"), width) for z in (x, y)]
            met.append((np.bitwise_count(both[0] ^ both[1]) <= near_copies.RADIUS).sum() >= meets)
        assert np.mean(met) >= 0.995


def test_all_within_the_radius_meet(spark):
    """What the balls find is what all pairs find; nodes under a crowded variant are named with it."""
    rng = np.random.default_rng(8)
    scheme = near_copies.WIDE._replace(parts=2)
    base = rng.integers(0, 2**16, (300, 2, 2))
    base[100:] = base[rng.integers(0, 100, 200)]
    for i in range(100, 300):
        base[i, 0, rng.integers(0, 2)] ^= (1 << int(rng.integers(0, 16))) | (1 << int(rng.integers(0, 16)))
        base[i, 1] = rng.integers(0, 2**16, 2)
    base[:30, 1] = base[0, 1]
    prints = [[int(p[0] | p[1] << scheme.bits) for p in x] for x in base]
    nodes = spark.createDataFrame([(n - 150, p) for n, p in enumerate(prints)], "node long, parts array<long>")
    met = near_copies._met(nodes, scheme, settle=False).collect()
    apart = np.bitwise_count(np.array(prints)[:, None] ^ np.array(prints)[None])
    want = {(i - 150, j - 150) for i, j in zip(*np.nonzero(np.triu((apart <= near_copies.RADIUS).any(2), 1)), strict=True)}
    crowd = {n - 150 for n in range(30)}
    assert {r["b"] for r in met if r["key"] is not None} == crowd
    got = {(r["a"], r["b"]) for r in met if r["a"] < r["b"]}
    assert got <= want and {x for x in want if not set(x) <= crowd} <= got and len(want) > 500
    settled = near_copies._met(nodes, scheme, settle=True).where("key is not null").select("a", "b").distinct().collect()
    assert {r["b"] for r in settled} == crowd and {r["a"] for r in settled} == {-150}


def test_hub_grams_are_made_once_and_only_for_open_hubs(spark):
    """A hub whose nodes are one component makes no rows, and the rows of another are made once."""
    sets = {n: [*range(20, 60), *range(1000 * n, 1000 * n + 20)] for n in range(1, 30)} | {0: list(range(60)), 100: list(range(60))}
    made = spark.createDataFrame([(n, sorted(x)) for n, x in sets.items()], "node long, grams array<long>")
    open_ = spark.createDataFrame([(n, 0) for n in range(1, 15)] + [(n, 100) for n in range(15, 30)], "node long, hub long")
    roots = spark.createDataFrame([(n, 0 if n < 15 else n) for n in sets], "node long, root long")
    tables, real = {}, near_copies.durable
    near_copies.durable = lambda df, label: tables.setdefault(label, real(df, label))
    try:
        found = near_copies._beside_hubs(near_copies._deltas(open_, made), roots)
    finally:
        near_copies.durable = real
    assert found.count() == 0
    assert {r["node"] for r in tables["near-each"].select("node").distinct().collect()} == set(range(15, 30))
    assert tables["near-each"].count() == 15 * 40
    assert "Generate" not in tables["near-times"]._jdf.queryExecution().toString()


def shuffled(spark):
    """Bytes that this session has shuffled so far."""
    each = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))


def test_variants_are_made_where_they_meet(spark, monkeypatch):
    """With many buckets all within the radius still meet, and a node shuffles far less than its 297 variants of 12 bytes."""
    monkeypatch.setattr(near_copies, "BUCKET_ROWS", 4000)
    rng = np.random.default_rng(9)
    prints = rng.integers(0, 2**40, (2000, near_copies.WIDE.parts)) & ~np.int64(0xFF0000)  # two pieces of 16 bits
    for i in range(1000, 2000):
        prints[i, i % 9] = prints[i - 1000, i % 9]
        for flip in rng.choice([*range(16), *range(24, 40)], i % 4):
            prints[i, i % 9] ^= 1 << int(flip)
    plain = rng.integers(-(2**63), 2**63, (1000, 2))
    rows = [(n - 900, prints[n].tolist(), plain[n % 1000].tolist()) for n in range(2000)]
    nodes = spark.createDataFrame(rows, "node long, parts array<long>, plain array<long>")
    before = shuffled(spark)
    met = near_copies._met(nodes, near_copies.WIDE, settle=False).collect()
    assert shuffled(spark) - before < 2000 * 297 * 12 / 1.5
    apart = [np.bitwise_count(prints[n] ^ prints[n + 1000]).min() for n in range(1000)]
    want = {(n - 900, n + 100) for n in range(1000) if apart[n] <= near_copies.RADIUS}
    assert {(r["a"], r["b"]) for r in met} == want and len(want) > 600


def test_unlike_nodes_under_a_variant_are_not_compared(spark):
    """A part fingerprint that unlike nodes share makes neither a crowd nor pairs but those that are alike."""
    rng = np.random.default_rng(10)
    plain = rng.integers(-(2**63), 2**63, (300, 2))
    plain[200:210] = plain[:10] ^ 0b10101
    nodes = spark.createDataFrame([(n, [7] * 9, p) for n, p in enumerate(plain.tolist())], "node long, parts array<long>, plain array<long>")
    met = near_copies._met(nodes, near_copies.WIDE, settle=False).collect()
    assert {(r["a"], r["b"]) for r in met if np.bitwise_count((plain[r["a"]] ^ plain[r["b"]]).view("u8")).sum() <= 6} == {(n, 200 + n) for n in range(10)}
    assert all(r["key"] is None for r in met) and len(met) < 9 * 60


def test_near_sets_are_alike_by_plain_fingerprints():
    rng = np.random.default_rng(12)
    apart, others = [], []
    for n in (4, 5, 9, 10, 60, 200) * 200:
        drawn = rng.integers(0, 2**64, n + n // 4, dtype="u8")
        x, y = drawn[:n], drawn
        assert near(set(x.tolist()), set(y.tolist()))
        x, y, z = (np.array(near_copies.plain_fingerprint(np.sort(s)), "i8").view("u8") for s in (x, y, rng.integers(0, 2**64, n, dtype="u8")))
        apart.append(np.bitwise_count(x ^ y).sum())
        others.append(np.bitwise_count(x ^ z).sum())
    assert max(apart) <= near_copies.PLAIN and np.mean(np.array(others) <= near_copies.PLAIN) < 0.01


def test_a_crowd_makes_rows_in_proportion_to_its_nodes(spark, monkeypatch):
    """fingerprints around one make a few rows each, not a row a pair or a variant, and all within the radius are paired or under one key."""
    rng = np.random.default_rng(13)
    scheme, used = near_copies.WIDE._replace(parts=2), [*range(16), *range(24, 40)]
    for n, rows, each in ((400, 250_000, 4), (800, 250_000, 4), (800, 4000, 12)):  # the last in four times as many buckets
        monkeypatch.setattr(near_copies, "BUCKET_ROWS", rows)
        prints = np.full((n, 2), 0x5A5A005A5A)
        for x in prints:
            for part in (0, 1):
                for flip in rng.choice(used, rng.integers(0, 3), replace=False):
                    x[part] ^= 1 << int(flip)
        nodes = spark.createDataFrame([(i - 150, x.tolist()) for i, x in enumerate(prints)], "node long, parts array<long>")
        for settle in (False, True):
            met = near_copies._met(nodes, scheme, settle).collect()
            assert len(met) <= each * n
            assert all(r["a"] <= r["b"] for r in met) and {r["part"] for r in met if r["key"] is None} <= {0, 1}
            pairs, keys = {(r["a"], r["b"]) for r in met if r["key"] is None}, {}
            for r in met:
                if r["key"] is not None:
                    keys.setdefault(r["b"], set()).add(r["key"])
            apart = np.bitwise_count(prints[:, None] ^ prints[None])
            want = [(int(i) - 150, int(j) - 150) for i, j in zip(*np.nonzero(np.triu((apart <= near_copies.RADIUS).any(2), 1)), strict=True)]
            assert len(want) > 30 * n
            assert all((i, j) in pairs or keys.get(i, set()) & keys.get(j, set()) for i, j in want)


def test_joined_places():
    rng = np.random.default_rng(14)
    for n, m in ((1, 0), (50, 20), (500, 400), (500, 2000)):
        x, y = rng.integers(0, n, (2, m))
        want = np.arange(n)
        for _ in range(n):
            for i, j in zip(x, y, strict=True):
                want[i] = want[j] = min(want[i], want[j])
            if (want[x] == want[y]).all():
                break
        assert (near_copies.joined(n, x, y) == want).all()
    path = rng.permutation(3000)
    assert (near_copies.joined(3000, path[1:], path[:-1]) == 0).all()


def test_near_nodes_share_a_hub_of_about_their_size(spark):
    """each two near nodes of a group have a hub in common, or one is the other's, and no hub is of quite another size."""
    sets = {n: list(range(n)) for n in range(1, 140)} | {200 + n: list(range(1000, 1000 + n)) for n in range(20, 40)}
    grams = spark.createDataFrame(list(sets.items()), "node long, grams array<long>")
    groups = {5: [n for n in sets if n < 200], 210: [n for n in sets if n > 60]}
    open_ = spark.createDataFrame([(n, h) for h, its in groups.items() for n in its if n != h], "node long, hub long")
    links = spark.createDataFrame([(90, 91), (90, 92), (30, 31)], "a long, b long")
    got = {(r["node"], r["hub"]) for r in near_copies._centred(open_, grams, links).collect()}
    hubs = {n: {h for m, h in got if m == n} | {n for _, h in got if h == n} for n in sets}
    for its in groups.values():
        assert all(hubs[a] & hubs[b] for a in its for b in its if a < b and near(set(sets[a]), set(sets[b])))
    assert all(1 / 1.6 < len(sets[n]) / len(sets[h]) < 1.6 for n, h in got)
    assert {h for n, h in got if n == 89} == {90} and (31, 30) in got | {(b, a) for a, b in got}
