"""BPE, exact dedup, sharding, licence scan, packing."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import bpe, exact_dedup, license_scan, packing, sharding

from .helpers import clashing, empty, odd, odd_rows

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LETTERS = st.text(st.sampled_from("abcdefgstTIÉß'’İΣ́ \t\n\x1c\x85\xa0​12½漢字🙂!?.,-_<|>"), max_size=60)


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


# --- BPE -----------------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=8))
def test_bpe_is_the_library(texts):
    mine, lib = bpe.coder(WORD), Tokenizer.from_file(WORD) if not hasattr(test_bpe_is_the_library, "lib") else test_bpe_is_the_library.lib
    test_bpe_is_the_library.lib = lib
    ids, decoded = mine.encode(texts)
    for text, i, d in zip(texts, ids, decoded, strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(i, "<i4").tolist() == want and d == lib.decode(want, skip_special_tokens=False)


def test_trie_handles_long_words_and_prefixes(library):
    words = ["a" * 20_000, "ab", "abc", "abcd", "abcdabcdabcd", "z"]
    found = bpe.TrieBpe(WORD).encode_words(words)
    assert all(found[w] == library[WORD].encode(w, add_special_tokens=False).ids for w in words)


def test_op1(spark, library):
    rows = bpe.digests(bpe.encode_decode(clashing(odd(spark), "ids", "decoded"), WORD)).collect()
    want = Counter()
    for doc, text, *_ in odd_rows():
        ids = library[WORD].encode(text or "", add_special_tokens=False).ids
        decoded = library[WORD].decode(ids, skip_special_tokens=False)
        want[doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert bpe.encode_decode(empty(spark), WORD).count() == 0


# --- exact dedup ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("bits", "cell_rows"), [(exact_dedup.MAX_FILTER_BITS, 10**6), (exact_dedup.MAX_FILTER_BITS, 9), (8, 10**6)])
def test_exact_dedup_by_brute_force(spark, bits, cell_rows):
    """With a filter, with one that several cells make, and with none, as every row is held possibly repeated."""
    assert (exact_dedup.filter_blocks(50, bits) == 0) == (bits == 8)
    rows = exact_dedup.exact_dedup(clashing(odd(spark), "keep_id", "row", "text_sha256", "group_size", "kept", "block", "spots", "words"), max_filter_bits=bits, cell_rows=cell_rows).collect()
    groups = defaultdict(list)
    for doc, text, *_ in odd_rows():
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(doc)
    want = Counter((d, min(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == want
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def shuffled_bytes(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    java = spark.sparkContext._jvm.java.util
    stages = store.stageList(java.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), java.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("cells", [1, 3])
def test_only_possible_copies_shuffle(spark, cells):
    """Of 200,000 rows 100 have an equal.  The filter passes few others, and its making moves a few bytes a row."""
    df = spark.range(0, 200_000, 1, 4).selectExpr("id as row", "sha2(cast(id % 199950 as string), 256) as text_sha256")
    blocks = exact_dedup.filter_blocks(200_000)
    spotted = exact_dedup.placed(df, blocks)
    before = shuffled_bytes(spark)
    words = exact_dedup.repeated_spots(spotted.select("row", "block", "spots"), blocks, cells).collect()
    moved = shuffled_bytes(spark) - before
    assert moved < (8 if cells == 1 else 20) * 200_000, moved  # a row of a position or digest takes 25 bytes and more
    table = {r["block"]: r["words"] for r in words}
    assert len(table) == blocks and all(len(w) == 1024 for w in table.values())
    hit = lambda b, s: table[b][s >> 6] >> (s & 63) & 1
    maybe = {r["row"] for r in spotted.collect() if hit(r["block"], r["spots"] & 65535) and hit(r["block"], (r["spots"] >> 16) & 65535)}
    assert {*range(50), *range(199_950, 200_000)} <= maybe and len(maybe) < 8000


def test_rows_without_a_doc_id(spark, library):
    df = spark.createDataFrame([(None, "one two"), (None, None), (3, "one two"), (3, "other")], "doc_id long, text string")
    coded = bpe.encode_decode(df, WORD).collect()
    assert Counter((r["doc_id"], len(r["ids"])) for r in coded) == Counter([(None, 2), (None, 0), (3, 2), (3, 1)])
    found = {(r["doc_id"], r["group_size"], r["keep_id"]): r["kept"] for r in exact_dedup.exact_dedup(df).collect()}
    assert found == {(None, 2, None): True, (3, 2, None): False, (None, 1, None): True, (3, 1, 3): True}
    for tasks in (1, 4):  # with a task of its own "one two" may be cut, so lengths are added up
        ids = Counter()
        for r in packing.pack_documents(df.repartition(tasks), BYTE).collect():
            ids[r["doc_id"]] += r["length"]
        assert ids == {None: 4, 3: 5}
    assert license_scan.scan_licenses(df).where("doc_id is null").count() == 2


# --- sharding ------------------------------------------------------------------------------------------------------


def test_sharding_law(spark):
    df = spark.range(1003).selectExpr("id * 17 as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    rows = sharding.assign(clashing(df, "arc", "spot", "rank", "at", "shard"), shards=7).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(map(len, by.values())) == [143] * 5 + [144] * 2 and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows}
    assert sizes[17] == (17, zlib.crc32(b"x"))
    assert rows == sharding.assign(df.repartition(5), shards=7).collect() or Counter(map(tuple, rows)) == Counter(map(tuple, sharding.assign(df.repartition(5), shards=7).collect()))


def plain_ring(rows, shards, virtual_nodes=64):
    """Row by row: each arc's rows into its own shard while there is room, then those left over clockwise."""
    points = sorted((xxhash.xxh64_intdigest(f"{s}/{v}", 42) - (1 << 63), s) for s in range(shards) for v in range(virtual_nodes))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    by_arc = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        by_arc[next((i for i, (p, _) in enumerate(points) if p >= row[1]), 0)].append(row[0])
    found, left = {}, []
    for arc in sorted(by_arc):
        shard = points[arc][1]
        for doc in by_arc[arc]:
            if room[shard]:
                room[shard] -= 1
                found[doc] = shard
            else:
                left.append((arc, doc))
    for arc, doc in left:
        step = 1
        while not room[points[(arc + step) % len(points)][1]]:
            step += 1
        found[doc] = points[(arc + step) % len(points)][1]
        room[found[doc]] -= 1
    return found


def test_sharding_by_a_plain_ring(spark):
    df = spark.range(2000).selectExpr("id * 13 as doc_id", "cast(id as string) as text")
    spots = [(r[0], r[1]) for r in df.selectExpr("doc_id", "xxhash64(cast(doc_id as string))").collect()]
    got = {r["doc_id"]: r["shard"] for r in sharding.assign(df, shards=7).collect()}
    assert got == plain_ring(spots, 7)


def test_one_more_shard_moves_few_rows(spark):
    df = spark.range(50_000).selectExpr("id as doc_id", "'x' as text")
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.assign(df, shards=n).collect()} for n in (40, 41))
    moved = [d for d in a if a[d] != b[d]]
    assert len(moved) <= 0.06 * len(a) and sum(b[d] == 40 for d in moved) >= 50_000 // 41  # 2.4 % is the least


def test_sharding_of_hot_keys(spark):
    """A doc_id, a text and both a third of all rows each, and cells of a few rows: the same laws."""
    df = spark.range(900).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 5 else id end as doc_id", "case when id % 3 = 1 then 'same' else cast(id as string) end as text")
    for cell_rows in (1_000_000, 3):
        rows = sharding.assign(df, shards=4, cell_rows=cell_rows, chunk_rows=7).collect()
        by = defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
        assert sorted(map(len, by.values())) == [225] * 4 and all(sorted(v) == list(range(225)) for v in by.values())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, 16 + len(t), zlib.crc32(t.encode())) for d, t in ((r[0], r[1]) for r in df.collect()))


def test_sharding_odd_rows(spark):
    rows = sharding.assign(odd(spark), shards=40).collect()
    assert len(rows) == len(odd_rows()) and max(Counter(r["shard"] for r in rows).values()) <= 2
    assert next(r for r in rows if r["doc_id"] == 0)["size"] == 16
    assert sharding.assign(empty(spark)).count() == 0
    assert sharding.assign(odd(spark).limit(3), shards=40).count() == 3


def test_overflow_goes_clockwise_and_nothing_else_moves():
    owners = [0, 1, 2, 0, 1, 2]
    plan = sharding.runs({0: 10, 1: 1, 4: 1}, owners, 3)
    assert [(a, s) for a, k, s, _ in plan if k == 0] == [(0, 0), (1, 1), (4, 1)]  # each arc starts in its own shard
    assert [p[2] for p in plan if p[0] == 0] == [0, 1, 2]
    filled = Counter()
    counts = {0: 10, 1: 1, 4: 1}
    for (a, k, s, slot), nxt in zip(plan, [*plan[1:], (None, None, None, None)], strict=True):
        rows = (nxt[1] if nxt[0] == a else counts[a]) - k
        filled[s] += rows
    assert filled == {0: 4, 1: 4, 2: 4}


# --- licences ------------------------------------------------------------------------------------------------------


def test_licences(spark):
    mit = dict(license_scan.KNOWN[:3])["MIT"]
    varied = mit.upper().replace("LICENSE", "LICENCE").replace('"', "“").replace("<YEAR> <HOLDER>", "2019 Somebody Else").replace("\n", "\n\n  ")
    rows = [(1, mit), (2, varied), (3, mit + " and more"), (4, "x\nLicensed under CC BY-NC 4.0!\nreleased under the mit licence"), (5, None), (6, ""), (7, "All rights reserved."), (7, "All rights reserved.")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "digest", "license", "hits")
    found = license_scan.scan_licenses(df).collect()
    assert sorted((r["doc_id"], r["license"], r["notices"], r["notice_lines"]) for r in found if r["license"]) == [(1, "MIT", "", 0), (2, "MIT", "", 0), (7, "all-rights-reserved", "all-rights-reserved", 1), (7, "all-rights-reserved", "all-rights-reserved", 1)]
    assert {r["doc_id"]: (r["notices"], r["notice_lines"]) for r in found if not r["license"]} == {3: ("", 0), 4: ("CC-BY-NC-4.0,MIT", 2), 5: ("", 0), 6: ("", 0)}
    assert license_scan.scan_licenses(empty(spark)).count() == 0 and license_scan.scan_licenses(df, known=[]).count() == 8


# --- packing -------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=8))
def test_word_ids_are_the_library(texts):
    mine = packing.word_ids(BYTE)
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == mine.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 99), st.integers(0, 99)), min_size=1, max_size=60), st.booleans(), st.integers(1, 6), st.integers(1, 120))
def test_limits_hold_and_nothing_is_lost(sizes, cut, segments, loss_limit):
    array = np.array([(t, min(t, loss_t, loss_limit)) for t, loss_t in sizes], "int64")
    bins = packing.pack(array, (100, segments, loss_limit), cut)
    seen = defaultdict(list)
    for held in bins:
        assert sum(s for _, _, s in held) <= 100 and len(held) <= segments and held
        loss = sum(max(0, at + s - max(at, array[i, 0] - array[i, 1])) for i, at, s in held)
        assert loss <= loss_limit
        for i, at, s in held:
            seen[i].append((at, s))
    for i, (total, _) in enumerate(array):
        pieces = sorted(seen[i])
        assert [a for a, _ in pieces] == list(np.cumsum([0, *[s for _, s in pieces]])[:-1]) and sum(s for _, s in pieces) == total
        assert cut or len(pieces) == 1


def _check_packed(rows, docs, library, length=2048):
    ids = {}
    for r in rows:
        ids.setdefault(r["doc_id"], {})[r["start"]] = np.frombuffer(r["ids"], "<u4").tolist()
    for doc, text in docs.items():
        whole = [i for s in sorted(ids[doc]) for i in ids[doc][s]]
        assert whole == [*library.encode(text or "", add_special_tokens=False).ids, 1]
    fill = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]])[:-1]) and sum(n for _, n in parts) <= length
    return {s: sum(n for _, n in p) for s, p in fill.items()}


def test_packing_round_trip(spark, library):
    rows = packing.pack_documents(clashing(odd(spark).dropDuplicates(["doc_id"]), "prompt", "ids", "start"), BYTE).collect()
    used = _check_packed(rows, {d: t for d, t, *_ in odd_rows()}, library[BYTE])
    assert all(n == 2048 or n & (n - 1) == 0 for n in used.values())
    assert packing.pack_documents(empty(spark), BYTE).count() == 0
    assert packing.pack_documents(odd(spark), BYTE).where("doc_id = 5").count() >= 2
    one = packing.digests(packing.pack_documents(odd(spark), BYTE)).where("doc_id = 1").first()
    assert one["ids_crc32"] == zlib.crc32(np.array([1], "<u4").tobytes()) and one["doc_tokens"] == 1


def test_packing_with_prompts(spark, library):
    df = spark.createDataFrame([(i, "question " * (i % 9), "answer " * (5 + i % 23)) for i in range(200)], "doc_id long, ask string, text string")
    rows = packing.pack_documents(df, BYTE, length=128, segments=3, loss_tokens=64, cut=False, prompt="ask").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    assert len(rows) == 200 and all(len(p) <= 3 and sum(r["loss"] for r in p) <= 64 and sum(r["length"] for r in p) <= 128 for p in by.values())
