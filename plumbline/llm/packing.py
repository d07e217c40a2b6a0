"""Packing examples into training sequences: vector bin packing with a dot-product heuristic.

Each example has three sizes: tokens, segments and loss-bearing tokens.  Each sequence has a limit on each.  An open
sequence takes, among the examples that fit, the one whose sizes have the largest dot product with the room that is
left, all in shares of the limits; when none fits it closes.  Examples longer than a sequence give full sequences first
and compete with what is left of them.  With `cut`, a sequence that nothing fits takes the front of the example that
scores highest, so that it closes full.

Every task packs its own rows, `pool` examples at a time: no shuffle, bounded memory, and a lost task packs again alike.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shipping import ship_package
from plumbline.llm.codes import BYTE_LETTERS, Codes
from plumbline.llm.common import held_by_worker, text_or_empty

#: Parts of texts that a worker keeps before they become the old ones.
KEPT_WORDS = 150_000
_GAP = re.compile(r"(?<=\S) (?=\S)")
#: Signs of white space that isn't a single space or line feed between two other characters.
_WIDE = ["  ", "\n\n", " \n", "\n ", *[c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]]
_SPACE = re.compile(r"\s")
#: Printable characters below U+0100 and line feeds: their classes are the same in every Unicode version.
_PLAIN_TEXT = re.compile("[\n -~\u00a1-\u00ff]*")
#: Fixed value: how byte-level files of this kind split texts.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _wide(text: str) -> bool:
    return not text or text[0] in " \n" or text[-1] in " \n" or any(sign in text for sign in _WIDE)


def by_ranks(path: str, library) -> tiktoken.Encoding | None:
    """The same vocabulary for the tiktoken library, which joins two parts if what they make is a token, by that token's
    rank, and not by a list of pairs.

    This is the same if every token's own letters encode to it alone: what lies between two borders that hold until a
    merge's turn has been merged as if it stood alone, so parts that make a token are the two of its pair.  None if some
    token doesn't.
    """
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    special = {t.content for t in library.get_added_tokens_decoder().values()}
    byte = {c: b for b, c in enumerate(BYTE_LETTERS)}
    tokens = {t: i for t, i in vocab.items() if t not in special}
    if any(len(found := library.model.tokenize(t)) != 1 or found[0].id != i for t, i in tokens.items()):
        return None
    return tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks={bytes(map(byte.__getitem__, t)): i for t, i in tokens.items()}, special_tokens={})


class WordIds:
    """Token ids of whole texts as the tokenizers library gives them, worked out once for each distinct word.

    Byte-level files start a new piece at a single space or line feed between two characters that are not white space,
    so a text's ids are those of its parts: a word with its space, a line feed, and what other white space keeps together.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        pre = self.library.pre_tokenizer
        if self.library.normalizer is not None or type(pre).__name__ != "ByteLevel" or pre.add_prefix_space or not pre.use_regex:
            raise ValueError("a plain byte-level file is needed")
        (self.feed,) = self.library.encode("\n", add_special_tokens=False).ids
        self.quick = by_ranks(path, self.library)
        self.codes = Codes(self._learn, KEPT_WORDS)

    @staticmethod
    def parts(text: str) -> list[str]:
        """What a text is put together of: after a space first of all what has nothing before it, after a line feed what has
        that before it, and else what has a space before it."""
        found = _GAP.split(text) if _wide(text) else text.replace("\n", " \n").split(" ")
        found[0] = " " + found[0]
        return found

    def _ask(self, words: list[str], lead: str, feeds: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without white space in a row, `lead` before each (and before that, if asked for, a line feed's
        id), and how many each has.  Many words at a time, one a line: a line feed is always a piece and an id of its own."""
        found = [np.zeros(0, "<u4")]
        for at in range(0, len(words), 1000):
            text = "\n" + lead + ("\n" + lead).join(words[at : at + 1000])
            if self.quick and "<|" not in text and _PLAIN_TEXT.fullmatch(text):
                found.append(self.quick.encode_to_numpy(text))
            else:
                found.append(np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4"))
        ids = np.concatenate(found)
        sizes = np.diff(np.append(np.flatnonzero(ids == self.feed), len(ids)))
        return (ids, sizes) if feeds else (ids[ids != self.feed], sizes - 1)

    def _learn(self, parts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For parts(): which of them, their ids in a row, and how many each has."""
        odd = [i for i, part in enumerate(parts) if not part.isalnum() and (part[0] == " " or _SPACE.search(part, 1))]
        taken = set(odd)
        fed = [i for i, part in enumerate(parts) if part[0] == "\n" and i not in taken]
        taken.update(fed)
        spaced = [i for i in range(len(parts)) if i not in taken]
        spaced.sort(key=lambda i: not _PLAIN_TEXT.fullmatch(parts[i]))  # together, those that the library itself has to do
        yield np.array(spaced, "int64"), *self._ask([parts[i] for i in spaced], " ", False)
        yield np.array(fed, "int64"), *self._ask([parts[i][1:] for i in fed], "", True)
        codes = self.library.encode_batch_fast([parts[i][1:] if parts[i][0] == " " else " " + parts[i] for i in odd], add_special_tokens=False)
        found = [np.array(code.ids, "<u4") for code in codes]
        yield np.array(odd, "int64"), np.concatenate([np.zeros(0, "<u4"), *found]), np.array(list(map(len, found)), "int64")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        ids, ends = self.codes.of(list(map(self.parts, texts)))
        raw = ids.tobytes()
        return [raw[4 * low : 4 * high] for low, high in pairwise(ends)]


def word_ids(path: str) -> WordIds:
    return held_by_worker(("packing", path), lambda: WordIds(path))


def pack(sizes: np.ndarray, limits: tuple[int, int, int], cut: bool) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (example, first token, tokens).  sizes: a row (tokens, loss-bearing tokens) an example.

    Loss-bearing tokens are taken to stand at an example's end when it is cut.
    """
    most = np.array(limits, "float64")
    left, loss = sizes[:, 0].astype("int64").copy(), sizes[:, 1].astype("int64").copy()
    need = np.stack([left, np.ones(len(left)), loss], 1) / most
    start = np.zeros(len(left), "int64")
    order = np.argsort(-need.max(1), kind="stable")
    open_ = list(order[left[order] > 0])
    need, alive = need[open_], np.ones(len(open_), bool)
    bins: list[list[tuple[int, int, int]]] = []
    count = len(open_)
    while count:
        room, held = np.ones(3), []
        while count:
            fit = alive & (need <= room + 1e-9).all(1)
            score = np.where(fit, need @ room, -1.0)
            best = int(score.argmax())
            if score[best] < 0:
                space, spare = round(room[0] * limits[0]), round(room[2] * limits[2])
                if not cut or space <= 0 or spare <= 0 or room[1] * limits[1] < 0.5:
                    break
                best = int(np.where(alive, need @ room, -1.0).argmax())
                i = open_[best]
                quiet = int(left[i] - loss[i])
                take = min(space, int(left[i]), quiet + spare)
                if take <= 0:
                    break
                room -= np.array([take, 1, max(0, take - quiet)]) / most
                held.append((i, int(start[i]), take))
                start[i] += take
                left[i] -= take
                loss[i] -= max(0, take - quiet)
                if left[i]:
                    need[best] = np.array([left[i], 1, loss[i]]) / most
                else:
                    alive[best], count = False, count - 1
                continue
            i = open_[best]
            room -= need[best]
            held.append((i, int(start[i]), int(left[i])))
            alive[best], count = False, count - 1
        bins.append(held)
        if 2 * count < len(alive):
            keep = np.flatnonzero(alive)
            open_, need, alive = [open_[k] for k in keep], need[keep], np.ones(len(keep), bool)
    return bins


def powers(total: int) -> list[int]:
    """The powers of two that add up to total, largest first."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


def _split(held: list[tuple[int, int, int]], lengths: list[int]) -> list[list[tuple[int, int, int]]]:
    """A sequence's pieces dealt to shorter sequences of the given lengths."""
    out, queue = [], list(held)
    for length in lengths:
        part = []
        while length:
            i, at, size = queue.pop(0)
            take = min(size, length)
            part.append((i, at, take))
            length -= take
            if take < size:
                queue.insert(0, (i, at + take, size - take))
        out.append(part)
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    length: int = 2048,
    segments: int = 256,
    loss_tokens: int = 2048,
    end_id: int = 1,
    cut: bool = True,
    pool: int = 2048,
    doc_id: str = "doc_id",
    text: str = "text",
    prompt: str | None = None,
) -> DataFrame:
    """Per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, loss, sequence_id, offset.

    A document's ids are those of `prompt` (a column, if named: they bear no loss), of its text, and end_id.
    Each id lies in exactly one piece.  A sequence holds at most `length` tokens, `segments` pieces and `loss_tokens`
    loss-bearing tokens.  Without `cut`, only examples that exceed a limit on their own are cut.  With it, each task's
    last sequence is dealt to sequences of powers of two, which need no padding.
    A null text counts as empty: end_id alone.  Repeated rows are packed each.  Sequence ids are unique, the task's
    number above and a count below.  Other columns are ignored, so their names can't clash.  An empty table gives an
    empty result.
    """
    if loss_tokens < 1 or segments < 1 or length < 1:
        raise ValueError("limits must be positive")

    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = word_ids(tokenizer)
        end = array("I", [end_id]).tobytes()
        task = TaskContext.get().partitionId() << 33
        made = 0
        waiting: list[tuple[object, bytes, int, int, int]] = []  # doc_id, ids, first token, doc_tokens, tokens without loss
        done: list[tuple[object, int, bytes, int, int, int, int]] = []
        most = min(length, loss_tokens)

        def emit(held: list[tuple[object, int, bytes, int, int]]) -> None:
            nonlocal made
            offset = 0
            for doc, first, ids, total, loss in held:
                done.append((doc, first, ids, total, loss, task + made, offset))
                offset += len(ids) // 4
            made += 1

        def close(last: bool) -> None:
            nonlocal waiting
            sizes = np.array([[len(w[1]) // 4, max(0, len(w[1]) // 4 - w[4])] for w in waiting], "int64").reshape(-1, 2)
            bins = pack(sizes, (length, segments, loss_tokens), cut)
            rest = []
            if cut and bins and sum(size for _, _, size in bins[-1]) < length:
                if last:
                    total = sum(size for _, _, size in bins[-1])
                    bins[-1:] = _split(bins[-1], powers(total))
                else:
                    rest = bins.pop()

            def piece(i: int, at: int, size: int) -> tuple:
                doc, ids, first, total, quiet = waiting[i]
                return doc, first + at, ids[4 * at : 4 * (at + size)], total, max(0, at + size - max(at, quiet))

            for held in bins:
                emit([piece(*p) for p in held])
            waiting = [(w[0], w[1][4 * at : 4 * (at + size)], w[2] + at, w[3], max(0, min(size, w[4] - at))) for i, at, size in rest for w in [waiting[i]]]

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            sizes = pa.array([len(x) // 4 for x in columns[2]], pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), sizes, pa.array(columns[2], pa.binary()),
                    pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64()), pa.array(columns[6], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "loss", "sequence_id", "offset"],
            )

        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                heads = mine.encode(part.column("prompt").to_pylist())
                for doc, head, body in zip(part.column("doc_id").to_pylist(), heads, mine.encode(part.column("text").to_pylist()), strict=True):
                    ids = head + body + end
                    total, quiet, first = len(ids) // 4, len(head) // 4, 0
                    while total - first >= most:
                        size = min(length, max(0, quiet - first) + loss_tokens, total - first)
                        emit([(doc, first, ids[4 * first : 4 * (first + size)], total, max(0, first + size - max(first, quiet)))])
                        first += size
                    if first < total:
                        waiting.append((doc, ids[4 * first :], first, total, max(0, quiet - first)))
                    if len(waiting) >= pool:
                        close(False)
                if done:
                    yield flush()
        if waiting:
            close(True)
        if done:
            yield flush()

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"), (text_or_empty(prompt) if prompt else F.lit("")).alias("prompt")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, loss long, sequence_id long, offset long"
    )


def digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
