"""Line dedup where the alignment decides."""

import random
import time

from pyspark.sql import functions as F

from plumbline.llm import line_dedup
from plumbline.llm.common import with_maybe

from .helpers import clashing, empty, odd, prose
from .test_similar import line_docs


def split(text):
    return [(i, " ".join(x.split())) for i, x in enumerate((text or "").split("\n")) if x.split()]


def brute_pair(later, earlier, least=10):
    """Indices of `later` (lists of lines) in runs that one order-keeping alignment with `earlier` holds: longest chains of
    lines that stand once in each, then repeated lines beside a chain's lines, then stretches of repeated lines."""
    left = [i for i, x in enumerate(later) if later.count(x) == 1 and earlier.count(x) == 1]
    chains = []
    while left:
        best, rank = {}, lambda c: (len(c), -earlier.index(later[c[-1]]))  # of equally long chains the one that ends first
        for n, i in enumerate(left):
            longest = max((best[j] for j in left[:n] if earlier.index(later[j]) < earlier.index(later[i])), key=rank, default=[])
            best[i] = [*longest, i]
        longest = max(best.values(), key=rank)
        chains.append({i: earlier.index(later[i]) for i in longest})
        left = [i for i in left if i not in longest]
    placed = lambda i: any(i in c for c in chains)
    spots = lambda i, low, high: [e for e, x in enumerate(earlier) if x == later[i] and low < e < high]
    for step in (1, -1):
        for i in range(len(later))[::step]:
            beside = [c for c in chains if i - step in c]
            if beside and not placed(i):
                c = beside[0]
                low, high = max((e for j, e in c.items() if j < i), default=-1), min((e for j, e in c.items() if j > i), default=len(earlier))
                if found := spots(i, low, high):
                    c[i] = found[0 if step == 1 else -1]
    own = None
    for i in range(len(later)):
        if placed(i) or later[i] not in earlier:
            own = None
            continue
        found = spots(i, own[i - 1], len(earlier)) if own and i - 1 in own else []
        if not found:
            own = {}
            chains.append(own)
            found = spots(i, -1, len(earlier))
        own[i] = found[0]
    gone = set()
    for c in chains:
        run = []
        for i in [*sorted(c), None]:
            if run and (i is None or i != run[-1] + 1 or c[i] <= c[run[-1]]):
                gone |= set(run) if sum(len(later[j].split()) for j in run) >= least else set()
                run = []
            run = [*run, i] if i is not None else run
    return gone


def brute_aligned(rows, least=10):
    """Each document against its partners: the earliest holder of each line, and of each stretch of lines with `least` words."""
    texts = [(d, t, split(t)) for d, t in rows]
    first = {}
    for d, _, lines in sorted(texts, key=lambda x: x[0]):
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                part = tuple(x for _, x in lines[i : j + 1])
                first.setdefault(part, d)
                if sum(len(x.split()) for x in part) >= least:
                    break
            for j in range(i, -1, -1):
                part = tuple(x for _, x in lines[j : i + 1])
                first.setdefault(part, d)
                if sum(len(x.split()) for x in part) >= least:
                    break
    words = lambda part: sum(len(x.split()) for x in part)
    by_id = {d: [x for _, x in lines] for d, _, lines in texts}
    out = {}
    for d, t, lines in texts:
        mine = [x for _, x in lines]
        parts = [tuple(mine[i : j + 1]) for i in range(len(mine)) for j in range(i, min(len(mine), i + least))]
        partners = {first[p] for p in parts if p in first and (len(p) == 1 or (words(p) >= least and (words(p[1:]) < least or words(p[:-1]) < least)))}
        gone = {lines[i][0] for e in partners if e < d for i in brute_pair(mine, by_id[e], least)}
        out[d] = t if not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


def cleaned_texts(df):
    return {r["row"]["doc_id"]: r["row"]["text"] for r in line_dedup.drop_repeated_lines(df, aligned=True).collect()}


def test_aligned_by_brute_force(spark):
    docs = line_docs()
    got = cleaned_texts(clashing(spark.createDataFrame(docs, "doc_id long, text string"), "source", "hash", "lines", "key", "place"))
    want = brute_aligned(docs)
    assert {d for d in want if got[d] != want[d]} == set()
    assert got[500] == "" and got[501] == "" and got[502] is None


def test_lines_of_several_documents_are_no_run(spark):
    a, b, c = "one two three four five six", "red green blue black white grey", "ten lines of verse stand here"
    rows = [(0, f"{a}\nfirst alone"), (1, f"{b}\nsecond alone"), (2, f"{c}\n{a}\nthird alone"), (3, f"{a}\n{b}"), (4, f"{a}\n{c}"), (5, f"{c}\n{a}"), (6, f"{a}\n{b}\nthe end")]
    got = cleaned_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    # 3: two sources, no run of ten words; 4: the other order; 5: a run of 2; 6: holds all of 3, whose lines stood elsewhere first
    assert got[3] == rows[3][1] and got[4] == rows[4][1] and got[5] == "" and got[6] == "the end"


def test_what_crosses_often_keeps_its_passages():
    pairs = sorted((2 * k + i, 2 * (20 - k) + i) for k in range(20) for i in range(2))
    chains = line_dedup.align(pairs)
    assert all(len(c) == 2 for c in chains) and sorted(p for c in chains for p in c) == pairs


def plain_chains(pairs):
    """Longest chain after longest chain, by trying every end; of equally long ones the one that ends first."""
    left, out = sorted(pairs), []
    while left:
        best = {}
        for n, p in enumerate(left):
            longest = max((best[x] for x in left[:n] if x[1] < p[1]), key=lambda c: (len(c), -c[-1][1]), default=[])
            best[p] = [*longest, p]
        chain = max(best.values(), key=lambda c: (len(c), -c[-1][1]))
        out.append(chain)
        left = [p for p in left if p not in chain]
    return out


def moved_blocks(rng, blocks, most):
    """Blocks of unequal lengths in another order, with gaps between some."""
    sizes = [rng.randint(1, most) for _ in range(blocks)]
    starts, at = [], 0
    for size in sizes:
        starts.append(at)
        at += size + rng.randint(0, 1)
    order = list(range(blocks))
    rng.shuffle(order)
    pairs, later = [], 0
    for k in order:
        pairs += [(later + i, starts[k] + i) for i in range(sizes[k])]
        later += sizes[k] + rng.randint(0, 1)
    return pairs


def test_chains_to_the_end():
    """Many more chains than eight, of blocks of unequal lengths, as longest chains one after another have them."""
    rng = random.Random(2)
    for blocks in [3, 12, 30] * 15:
        pairs = moved_blocks(rng, blocks, 6)
        assert line_dedup.align(pairs) == plain_chains(pairs)
    assert len(plain_chains([(2 * k, 2 * (40 - k)) for k in range(40)])) == 40


def test_many_crossing_lines_take_little_time():
    began = time.process_time()
    assert len(line_dedup.align([(2 * k, 2 * (20_000 - k)) for k in range(20_000)])) == 20_000
    line_dedup.align(moved_blocks(random.Random(3), 1500, 4))
    assert time.process_time() - began < 20


def test_crossing_documents_by_brute_force(spark):
    """Documents made of another's passages in another order, by more chains than eight."""
    rng = random.Random(5)
    words = lambda k: f"{'bcdfghjk'[k % 8]}{k} l{k * 7 % 83} m{k % 11} n{k}"
    rows = []
    for d in range(12):
        lines = [words(100 * d + i) for i in range(50)]
        rows.append((2 * d, "\n".join(lines)))
        pairs = moved_blocks(rng, 14, 5)
        placed = {at: lines[e] for at, e in pairs if e < 50}
        rows.append((2 * d + 1, "\n".join(placed.get(i, f"own line {d} {i}") for i in range(max(placed) + 1))))
    got = cleaned_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_aligned(rows) and sum(got[d] != t for d, t in rows) == 12


def test_rows_grow_with_lines_and_not_with_partners_times_lines(spark, monkeypatch):
    """A document of 300 lines that each stand in another document, and a line that all have."""
    line = lambda k: f"line {k} of the long document has ten words in it"
    rows = [(k, f"{line(k)}\nalone {k} in this one\ncommon line") for k in range(300)] + [(900, "\n".join(line(k) for k in range(300)) + "\ncommon line"), (901, "\n".join(line(k) for k in range(0, 300, 2)))]
    written, real = {}, line_dedup.durable
    monkeypatch.setattr(line_dedup, "durable", lambda df, label: written.setdefault(label, real(df, label)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = cleaned_texts(df)
    assert got == brute_aligned(rows) and got[900] == got[901] == "" and got[7] == rows[7][1]
    sizes = {k: v.count() for k, v in written.items()}
    assert sizes["pairs"] > 450 and max(sizes.values()) < 4 * (300 * 3 + 451), sizes


def test_aligned_odd_rows(spark):
    assert line_dedup.summary(empty(spark), aligned=True).count() == 0
    rows = line_dedup.summary(odd(spark), aligned=True).collect()
    assert len(rows) == odd(spark).count() and {r["deleted_lines"] for r in rows if r["doc_id"] == 10} == {0}
    assert [r["deleted_lines"] > 0 and r["first_source"] == 6 for r in rows if r["doc_id"] == 7] == [True]
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(prose(1, 15) + "\n"), F.lit("unlike "), F.col("id").cast("string")).alias("text"))
    assert line_dedup.summary(hot, aligned=True).where("deleted_lines = 1 and first_source = 0").count() == 2999


def test_only_texts_that_lose_lines_shuffle(spark):
    """Of 2000 long texts 20 hold a passage of the first: what the last join moves is theirs."""
    body = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(400)), lambda i: F.hex(F.xxhash64("id", i))))
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, F.concat(F.lit(prose(1, 30) + "\n"), body)).otherwise(body).alias("text"))
    out = line_dedup.drop_repeated_lines(df, aligned=True)
    assert out.where(F.col("blocks").isNotNull()).count() == 19 and out.count() == 2000
    flagged = with_maybe(spark.range(20_000), F.xxhash64("id"), spark.range(1000).select(F.xxhash64("id").alias("key")))
    got = flagged.select("id", F.col("_maybe").alias("m")).groupBy((F.col("id") < 1000).alias("is")).agg(F.avg(F.col("m").cast("int")).alias("share")).collect()
    assert with_maybe(spark.range(5), F.col("id"), spark.range(0).select(F.col("id").alias("key"))).where("_maybe").count() == 0
    assert {r["is"]: r["share"] == 1.0 if r["is"] else r["share"] < 0.1 for r in got} == {True: True, False: True}


def test_the_alignment_decides(spark, monkeypatch):
    """Without chains, runs would cross from one place of the earlier document to another."""
    a, b, c = "one two three four five six", "red green blue black white grey", "ten lines of verse stand here"
    rows = [(0, f"{a}\n{b}\n{c}"), (1, f"{c}\n{a}\nmiddle\n{b}\n{a}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert cleaned_texts(df)[1] == rows[1][1]
    monkeypatch.setattr(line_dedup, "aligned_places", lambda lines: {x["at"]: (0, x["at"]) for x in lines})
    assert [r["words"] for r in line_dedup.aligned_runs([{"source": 0, "source_body": 0, "at": i, "place": i, "words": 6, "hash": i, "ats": [2 - i]} for i in range(2)], 10)] == [12]
