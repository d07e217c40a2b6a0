"""Line dedup by pairwise alignment.

A document's partners are the earliest document that holds each of its lines, and the earliest that holds each stretch of
lines just long enough to be deleted: a line that a million documents share names a million pairs, not their square, and
a whole copy meets its original even if every line stood elsewhere before.  For each pair all shared lines are aligned by
patience diff: lines that are rare (once in each document of the pair) anchor the longest chain that keeps the order of
both, the longest chains of what crosses follow until none is left, and repeated lines are hung on the chains beside them.  A run of
lines that follow each other in the later document, of one pair and one chain and rising in the earlier document, is
deleted if it holds enough words; what moves between documents are line hashes and positions, never texts.

repeated_blocks() and what is called without `aligned` follow the older rule: a run's lines may come from any documents in
any order.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shipping import ship_package
from plumbline.llm.common import durable, hold_nothing, text_or_empty, with_maybe

#: A run of aligned lines with fewer words stays: chance and short formulas repeat too.
MIN_BLOCK_WORDS = 10


def blocks_of(places: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Places (later, earlier), sorted, in blocks that go on by one in both.  A longest chain has a block whole or not at all."""
    out: list[list[tuple[int, int]]] = []
    for at, earlier in places:
        if out and out[-1][-1] == (at - 1, earlier - 1):
            out[-1].append((at, earlier))
        else:
            out.append([(at, earlier)])
    return out


def heaviest_chain(blocks: list[list[tuple[int, int]]]) -> list[int]:
    """Which blocks, sorted by their later places, make the longest chain that rises in both; of chains of one length the one
    that ends first.  By a tree of the best chains up to each place of the earlier document."""
    rank = {k: r + 1 for r, k in enumerate(sorted(range(len(blocks)), key=lambda k: blocks[k][0][1]))}
    best = [(0, 0, -1)] * (len(blocks) + 1)
    back = []
    for k, block in enumerate(blocks):
        r, found = rank[k] - 1, (0, 0, -1)
        while r:
            found = max(found, best[r])
            r -= r & -r
        back.append(found[2])
        mine, r = (found[0] + len(block), -block[-1][1], k), rank[k]
        while r <= len(blocks):
            best[r] = max(best[r], mine)
            r += r & -r
    out, r, found = [], len(blocks), (0, 0, -1)
    while r:
        found = max(found, best[r])
        r -= r & -r
    k = found[2]
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience_chain(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of (later, earlier) places that rises in both; places come sorted by the first."""
    blocks = blocks_of(places)
    return [p for k in heaviest_chain(blocks) for p in blocks[k]]


def align(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Chains that hold each of a pair's (later line, earlier line) once: rare lines' chains first, the longest of what is left
    each time, repeated lines last.  What falls throughout is as many chains as blocks, and needs no search."""
    times = Counter(e for _, e in pairs)
    rare = sorted(p for p in pairs if times[p[1]] == 1)
    chains = []
    while rare:
        blocks = blocks_of(rare)
        if all(a[0][1] > b[0][1] for a, b in zip(blocks, blocks[1:], strict=False)):
            chains += sorted(blocks, key=lambda b: (-len(b), b[-1][1]))
            break
        chains.append(patience_chain(rare))
        taken = set(chains[-1])
        rare = [p for p in rare if p not in taken]
    return chains + [[p] for p in sorted(pairs) if times[p[1]] > 1]


def repeated_runs(lines: list[dict], min_words: int) -> list[dict]:
    """Runs to delete from one document.  lines: its lines that an earlier document holds (at, place, words, source, source_at)."""
    by_source = defaultdict(list)
    for line in lines:
        by_source[line["source"]].append((line["at"], line["source_at"]))
    chain_of = {}
    for source, pairs in by_source.items():
        for number, chain in enumerate(align(pairs)):
            for at, earlier in chain:
                chain_of[at] = (source, earlier, number)
    runs: list[dict] = []
    for line in sorted(lines, key=lambda x: x["at"]):
        source, earlier, _ = chain_of[line["at"]]
        if runs and runs[-1]["end"] + 1 == line["at"]:
            run = runs[-1]
            run["end"], run["words"] = line["at"], run["words"] + line["words"]
            run["places"].append(line["place"])
        else:
            runs.append({"end": line["at"], "words": line["words"], "places": [line["place"]], "source": source, "source_at": earlier})
    return [r for r in runs if r["words"] >= min_words]


def aligned_places(lines: list[dict]) -> dict[int, tuple[int, int]]:
    """{at: (chain, earlier line)} for one pair.  lines: the later document's shared lines by `at` (at, hash, ats: the
    line's places in the earlier document, rising)."""
    times = Counter(x["hash"] for x in lines)
    found, members = {}, []
    for number, chain in enumerate(align([(x["at"], x["ats"][0]) for x in lines if times[x["hash"]] == 1 and len(x["ats"]) == 1])):
        members.append(chain)
        found |= {at: (number, earlier) for at, earlier in chain}
    for x in lines:  # repeated lines after a line of a chain, before the chain's next
        if x["at"] not in found and x["at"] - 1 in found:
            chain, earlier = found[x["at"] - 1]
            spot, after = bisect_right(x["ats"], earlier), bisect_right(members[chain], (x["at"], -1))
            if spot < len(x["ats"]) and (after == len(members[chain]) or x["ats"][spot] < members[chain][after][1]):
                found[x["at"]] = chain, x["ats"][spot]
                members[chain].insert(after, (x["at"], x["ats"][spot]))
    for x in reversed(lines):  # and before one, after the chain's last
        if x["at"] not in found and x["at"] + 1 in found:
            chain, earlier = found[x["at"] + 1]
            spot, after = bisect_left(x["ats"], earlier) - 1, bisect_left(members[chain], (x["at"], -1))
            if spot >= 0 and (after == 0 or x["ats"][spot] > members[chain][after - 1][1]):
                found[x["at"]] = chain, x["ats"][spot]
                members[chain].insert(after, (x["at"], x["ats"][spot]))
    first, number = len(members), len(members)
    for x in lines:  # the others: stretches of their own, each line at its first place that rises
        if x["at"] not in found:
            chain, earlier = found.get(x["at"] - 1, (-1, -1))
            spot = bisect_right(x["ats"], earlier) if chain >= first else len(x["ats"])
            if spot < len(x["ats"]):
                found[x["at"]] = chain, x["ats"][spot]
            else:
                found[x["at"]] = number, x["ats"][0]
                number += 1
    return found


def aligned_runs(lines: list[dict], min_words: int) -> list[dict]:
    """Runs to delete from one document, none of whose lines is in two.  lines: (source, source_body, at, place, words,
    hash, ats) for each line that it shares with each of its partners."""
    by_source = defaultdict(list)
    for line in lines:
        by_source[line["source"], line["source_body"]].append(line)
    runs = []
    for (source, body), shared in by_source.items():
        shared.sort(key=lambda x: x["at"])
        found = aligned_places(shared)
        run, last = [], (-1, -1, -1)
        for line in shared:
            chain, earlier = found[line["at"]]
            if not (last[0] + 1 == line["at"] and last[1] == chain and last[2] < earlier):
                run = []
                runs.append((source, body, earlier, run))
            run.append(line)
            last = line["at"], chain, earlier
    runs = [r for r in runs if sum(x["words"] for x in r[3]) >= min_words]
    out, gone = [], set()
    for source, _, earlier, run in sorted(runs, key=lambda r: (r[3][0]["at"], -len(r[3]), r[0], r[1])):
        rest = [x for x in run if x["at"] not in gone]
        gone |= {x["at"] for x in rest}
        if rest:
            out.append({"places": [x["place"] for x in rest], "words": sum(x["words"] for x in rest), "source": source, "source_at": earlier})
    return out


def stretches(lines: list[dict], min_words: int) -> set[tuple[int, ...]]:
    """Hashes of two lines or more that follow each other (at, hash, words), hold min_words and wouldn't without the last,
    or without the first.  A run of enough words is made of such stretches and of lines long enough alone."""
    lines = sorted(lines, key=lambda x: x["at"])
    out = set()
    for step in (1, -1):
        row = lines[::step]
        for i in range(len(row)):
            words, j = row[i]["words"], i
            while words < min_words and j + 1 < len(row) and row[j + 1]["at"] == row[j]["at"] + step:
                j += 1
                words += row[j]["words"]
            if j > i and words >= min_words:
                out.add(tuple(x["hash"] for x in row[i : j + 1][::step]))
    return out


def line_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, body, at, place, hash, words) of each line with words; body: the text's hash; at: its number among such
    lines; place: among all.  White space within a line doesn't count."""
    trimmed = F.transform(
        F.split(F.col("t"), "\n"), lambda line, i: F.struct(i.alias("place"), F.trim(F.regexp_replace(line, r"\s+", " ")).alias("line"))
    )
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("t"))
    rows = rows.select("doc_id", F.xxhash64("t").alias("body"), F.posexplode(F.filter(trimmed, lambda x: x["line"] != "")).alias("at", "x"))
    return rows.select("doc_id", "body", "at", "x.place", F.xxhash64("x.line").alias("hash"), F.size(F.split("x.line", " ")).alias("words"))


def repeated_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(doc_id, body, blocks array<struct<places array<int>, words, source, source_at>>) of documents that lose lines.

    source: the earlier document of the run's first line.  source_at: that line's number among its lines with words.
    """
    ship_package(docs.sparkSession)
    lines = durable(line_table(docs, doc_id, text), "lines")
    kind = lines.schema["doc_id"].dataType.simpleString()
    shared = lines.groupBy("hash", "words").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("last"))
    shared = shared.where(F.col("first.doc_id") < F.col("last")).select("hash", "words", F.col("first.doc_id").alias("source"), F.col("first.at").alias("source_at"))
    shared = durable(shared, "shared-lines")  # a shuffle of its own, so that the join can split a hot line's rows
    met = lines.join(shared, ["hash", "words"]).where("doc_id > source")
    own = met.groupBy("doc_id", "body").agg(F.collect_set(F.struct("at", "place", "words", "source", "source_at")).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                blocks = [
                    [{"places": r["places"], "words": r["words"], "source": r["source"], "source_at": r["source_at"]} for r in repeated_runs(x, min_words)]
                    for x in part.column("lines").to_pylist()
                ]
                source = part.schema.field("doc_id").type
                shape = pa.list_(pa.struct([("places", pa.list_(pa.int32())), ("words", pa.int32()), ("source", source), ("source_at", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), pa.array(blocks, shape)], ["doc_id", "body", "blocks"])

    out = own.mapInArrow(run, f"doc_id {kind}, body long, blocks array<struct<places: array<int>, words: int, source: {kind}, source_at: int>>")
    return out.where(F.size("blocks") > 0)


def partners_lines(met: DataFrame, pairs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, body, source, source_body, at, place, hash, words, ats): the lines that each pair shares.

    A line that fewer documents hold than its document has partners is taken to all its holders, of which the partners stay;
    another one is taken to the partners, of which the holders stay.  So a line makes the lesser number of rows, and neither
    a line that many hold nor a document with many partners multiplies with the other.
    """
    pair = ["doc_id", "body", "source", "source_body"]
    partners = durable(pairs.groupBy("doc_id", "body").agg(F.count(F.lit(1)).alias("partners")), "partners")
    counted = durable(met.join(partners, ["doc_id", "body"]), "counted-lines")
    few = counted.where("holders <= partners").join(places, ["hash", "words"]).where("doc_id > source")
    few = durable(few, "line-holders").join(pairs, pair, "left_semi")
    many = durable(counted.where("holders > partners").join(pairs, ["doc_id", "body"]), "pair-lines").join(places, ["source", "source_body", "hash", "words"])
    out = [*pair, "at", "place", "hash", "words", "ats"]
    return few.select(*out).unionByName(many.select(*out))


def aligned_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """What repeated_blocks() returns, of runs that one alignment with one earlier document holds."""
    ship_package(docs.sparkSession)
    lines = durable(line_table(docs, doc_id, text), "lines")
    kind = lines.schema["doc_id"].dataType.simpleString()
    shared = lines.groupBy("hash", "words").agg(F.min(F.struct("doc_id", "body")).alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("holders"))
    shared = shared.where(F.col("first.doc_id") < F.col("last")).select("hash", "words", F.col("first.doc_id").alias("source"), F.col("first.body").alias("source_body"), "holders")
    shared = durable(shared, "shared-lines")  # a shuffle of its own, so that the join can split a hot line's rows
    met = durable(lines.join(shared, ["hash", "words"]), "met-lines")
    own = met.groupBy("doc_id", "body").agg(F.collect_set(F.struct("at", "hash", "words")).alias("lines"))

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_nothing()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows, keys = [], []
                for i, x in enumerate(part.column("lines").to_pylist()):
                    for held in stretches(x, min_words):
                        rows.append(i)
                        keys.append(xxhash.xxh64_intdigest(b"".join(h.to_bytes(8, "little", signed=True) for h in held)) - 2**63)
                picked = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), picked.column("doc_id"), picked.column("body")], ["key", "doc_id", "body"])

    long = durable(own.where(F.size("lines") > 1).mapInArrow(stretch, f"key long, doc_id {kind}, body long"), "stretches")
    held = long.groupBy("key").agg(F.min(F.struct("doc_id", "body")).alias("first"), F.max("doc_id").alias("last")).where(F.col("first.doc_id") < F.col("last"))
    held = durable(held.select("key", F.col("first.doc_id").alias("source"), F.col("first.body").alias("source_body")), "held-stretches")
    pair = ["doc_id", "body", "source", "source_body"]
    pairs = met.where("doc_id > source").select(*pair).union(long.join(held, "key").where("doc_id > source").select(*pair))
    pairs = durable(pairs.distinct(), "pairs")
    places = met.groupBy(F.col("doc_id").alias("source"), F.col("body").alias("source_body"), "hash", "words").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    places = durable(places, "places")
    both = partners_lines(met.drop("source", "source_body"), pairs, places)
    both = both.groupBy("doc_id", "body").agg(F.collect_set(F.struct("source", "source_body", "at", "place", "words", "hash", "ats")).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                source = part.schema.field("doc_id").type
                shape = pa.list_(pa.struct([("places", pa.list_(pa.int32())), ("words", pa.int32()), ("source", source), ("source_at", pa.int32())]))
                blocks = pa.array([aligned_runs(x, min_words) for x in part.column("lines").to_pylist()], shape)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), blocks], ["doc_id", "body", "blocks"])

    out = both.mapInArrow(run, f"doc_id {kind}, body long, blocks array<struct<places: array<int>, words: int, source: {kind}, source_at: int>>")
    return out.where(F.size("blocks") > 0)


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_BLOCK_WORDS, aligned: bool = False) -> DataFrame:
    """(row struct of docs' columns with its text cleaned, blocks): every row of docs.

    A null text and a text without shared lines stay as they are; a null doc_id is neither earlier nor later than another
    and its row stays as it is.  Lines repeated within one document stay.  Rows that repeat a doc_id are one document's
    and don't delete each other's lines.  Extra columns are kept in the struct, so their names can't clash.  An empty
    table gives an empty result.
    """
    ship_package(docs.sparkSession)
    found = durable((aligned_blocks if aligned else repeated_blocks)(docs, doc_id, text, min_words), "blocks")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = whole.withColumns({"id": F.col(f"row.`{doc_id}`"), "body": F.xxhash64(F.coalesce(F.col(f"row.`{text}`"), F.lit("")))})
    # only texts that lose lines shuffle, and a few others; the rest pass straight through
    whole = with_maybe(whole, F.xxhash64("id", "body"), found.select(F.xxhash64("doc_id", "body").alias("key")))
    kind = found.schema["blocks"].dataType
    alone = whole.where(~F.col("_maybe")).select("row", F.lit(None).cast(kind).alias("blocks"))
    joined = alone.unionByName(whole.where("_maybe").join(found.withColumnRenamed("doc_id", "id"), ["id", "body"], "left").select("row", "blocks"))

    gone = F.array_sort(F.flatten(F.col("blocks.places")))
    lines = F.split(F.col(f"row.`{text}`"), "\n")
    # what stays lies between one deleted line and the next
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    spans = F.arrays_zip(F.slice(edges, 1, F.size(edges) - 1).alias("a"), F.slice(edges, 2, F.size(edges) - 1).alias("b"))
    kept = F.flatten(F.transform(spans, lambda s: F.slice(lines, s["a"] + 2, s["b"] - s["a"] - 1)))
    cleaned = F.when(F.col("blocks").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(f"row.`{text}`"))
    return joined.select(F.col("row").withField(f"`{text}`", cleaned).alias("row"), "blocks")


def summary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", aligned: bool = False) -> DataFrame:
    """Per row: doc_id, deleted_lines, deleted_words, first_source (of its first deleted block, or null), text_sha256 of what stays."""
    out = drop_repeated_lines(docs, doc_id, text, aligned=aligned)
    return out.select(
        F.col(f"row.`{doc_id}`").alias("doc_id"),
        F.coalesce(F.size(F.flatten("blocks.places")), F.lit(0)).cast("long").alias("deleted_lines"),
        F.coalesce(F.aggregate("blocks.words", F.lit(0), lambda a, w: a + w), F.lit(0)).cast("long").alias("deleted_words"),
        F.col("blocks")[0]["source"].alias("first_source"),
        F.sha2(F.coalesce(F.col(f"row.`{text}`"), F.lit("")), 256).alias("text_sha256"),
    )


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", aligned: bool = False) -> DataFrame:
    """docs with texts cleaned, without documents that lost every word."""
    out = drop_repeated_lines(docs, doc_id, text, aligned=aligned)
    return out.where(F.col("blocks").isNull() | (F.trim(F.regexp_replace(F.col(f"row.`{text}`"), r"\s+", " ")) != "")).select("row.*")
