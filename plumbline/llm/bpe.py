"""Byte-pair encoding and decoding by prefix-sharing trie traversal.

The last token of a prefix's encoding, together with the encodings of shorter prefixes, gives the prefix's encoding:
a token that ends the prefix is the right one exactly when it and the last token before it encode to themselves.  The
distinct words of a batch are put into a trie, and a depth-first walk carries each prefix's last token, so that what
words share at their start is encoded once.  The trie is the sorted list of the words: its nodes are their prefixes, two
neighbours part where their common prefix ends, and reading the list in order is the depth-first walk.  Normalising and splitting follow the tokenizer file itself.
"""

from __future__ import annotations

import json
import re
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shipping import ship_package
from plumbline.llm.codes import BYTE_LETTERS, Codes
from plumbline.llm.common import held_by_worker, text_or_empty

#: Chunks that a worker keeps before they become the old ones.
KEPT_CHUNKS = 300_000
KEPT_PAIRS = 1_000_000
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
#: Printable characters below U+0100: their normal form, case and classes are the same in every Unicode version.
_PLAIN = re.compile("[!-~\u00a1-\u00ff]+")
_PLAIN_TEXT = re.compile("[\\x09-\\x0d -~\u00a1-\u00ff]*")


def _plain(spec: dict) -> regex.Pattern | None:
    """The file's own word pattern, if it is one that can be applied to plain chunks without the library."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    kinds = [s["type"] for s in steps]
    normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    if kinds != ["Split", "ByteLevel"] or normal != ["NFC", "Replace", "Lowercase"]:
        return None
    split, byte = steps
    if split["behavior"] != "Removed" or not split["invert"] or byte["use_regex"] or byte["add_prefix_space"]:
        return None
    return regex.compile(split["pattern"]["Regex"], regex.V0)


class TrieBpe:
    """A BPE tokenizer file with or without an end-of-word suffix, encoded through a trie."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.pairs = pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.joins: dict[str, dict[str, int]] = {}  # left token, right token: the merge's rank
        for rank, (left, right) in enumerate(pairs):
            self.joins.setdefault(left, {})[right] = rank
        self.made = {a + b: i for i, (a, b) in enumerate(pairs)}
        self.spines: tuple[dict, dict] = ({}, {})
        made = [self.vocab[a + b] for a, b in pairs]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError("merges must make new tokens in the order of their ids")
        self.token = {i: t for t, i in self.vocab.items()}
        self.special: dict[str, int] = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.token |= {i: t for t, i in self.special.items()}
        # tokens by their text, those that can end a word by their text without the suffix
        closing = {i for t, i in self.vocab.items() if self.suffix and t.endswith(self.suffix) and t != self.suffix}
        self.inner = {t: i for t, i in self.vocab.items() if i not in closing}
        self.final = {t[: -len(self.suffix)]: i for t, i in self.vocab.items() if i in closing} if self.suffix else self.inner
        self.beginnings = {t[:n] for t in self.inner for n in range(len(t) + 1)} | {t[:n] for t in self.final for n in range(len(t))}
        self.states: dict[str, tuple[str, dict, list, dict]] = {}
        self.fits: dict[int, dict[int, bool]] = {}
        self.kept_pairs = 0
        self.plain_split = _plain(spec)
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _spine(self, token: int, right: bool) -> list[tuple[str, float, float]]:
        """The tokens that stand at one end of `token` while it is being merged, and the ranks between which each does."""
        memo = self.spines[right]
        if token not in memo:
            found, name, until = [], self.token[token], float("inf")
            while True:
                since = self.made.get(name, -1)
                found.append((name, since, until))
                if since < 0:
                    break
                name, until = self.pairs[since][right], since
            memo[token] = found
        return memo[token]

    def _follows(self, before: int, token: int) -> bool:
        """Whether `before` (-1: nothing) and `token`, side by side, encode to themselves.

        They don't if some merge joins what stands on both sides of their border at that merge's turn; at equal rank the
        leftmost goes first, so a merge within `before` comes before it and one within `token` after it.
        """
        if before < 0:
            return True
        right = self._spine(token, False)
        for x, x_since, x_until in self._spine(before, True):
            joins = self.joins.get(x)
            if joins is None:
                continue
            for y, y_since, y_until in right:
                r = joins.get(y, -1)
                if r > x_since and r > y_since and r < x_until and r <= y_until:
                    return False
        return True

    def _fits(self, before: int, token: int, known: dict[int, bool]) -> bool:
        """_follows(), remembered in what is known of the token."""
        self.kept_pairs += 1
        if self.kept_pairs > KEPT_PAIRS:
            for pairs in self.fits.values():
                pairs.clear()
            self.kept_pairs = 1
        fit = known[before] = self._follows(before, token)
        return fit

    def _candidates(self, text: str, tokens: dict[str, int]) -> list[tuple[int, int, dict[int, bool]]]:
        """The tokens that `text` ends with, longest first: (id, symbols, what is known of pairs with it)."""
        found = []
        for at in range(len(text)):
            token = tokens.get(text[at:])
            if token is not None:
                found.append((token, len(text) - at, self.fits.setdefault(token, {})))
        return found

    def _state(self, text: str) -> tuple[str, dict, list, dict]:
        """What a prefix of a word leads to: the longest end of it that some token begins with, moves by symbol, the tokens
        that end there, and by closing symbol those that end the word."""
        for at in range(len(text) + 1):
            held = self.states.get(text[at:])
            if held is not None:
                return held
            if text[at:] in self.beginnings:
                break
        text = text[at:]
        made = self.states[text] = (text, {}, self._candidates(text, self.inner), {})
        return made

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each word (in the file's own alphabet), by one depth-first walk over the trie of all of them."""
        out: dict[str, list[int]] = {}
        last, path = [-1], [self._state("")]  # the last token of each prefix on the way to the word, and where it leads to
        sizes, before = [0], ""
        for word in sorted(words):
            if not word:
                out[word] = []
                continue
            end = len(word)
            shared, most = 0, min(end, len(before)) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], path[shared + 1 :], sizes[shared + 1 :]
            state = path[-1]
            for depth in range(shared + 1, end):
                symbol = word[depth - 1]
                moved = state[1].get(symbol)
                if moved is None:
                    moved = state[1][symbol] = self._state(state[0] + symbol)
                state = moved
                path.append(state)
                for token, size, known in state[2]:
                    previous = last[depth - size]
                    fit = known.get(previous)
                    if fit or (fit is None and self._fits(previous, token, known)):
                        last.append(token)
                        sizes.append(size)
                        break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
            symbol = word[-1]
            closing = state[3].get(symbol)
            if closing is None:
                closing = state[3][symbol] = self._candidates(state[0] + symbol, self.final)
            for token, size, known in closing:
                previous = last[end - size]
                fit = known.get(previous)
                if fit or (fit is None and self._fits(previous, token, known)):
                    break
            else:
                raise ValueError(f"no token ends {word!r}")
            ids, at = [token], end - size
            while at:
                ids.append(last[at])
                at -= sizes[at]
            ids.reverse()
            out[word] = ids
            before = word
        return out

    def pieces(self, chunk: str) -> list[str | int]:
        """A chunk without ASCII white space as words of the file's alphabet, and ids of added tokens."""
        if self.plain_split and "<|" not in chunk and _PLAIN.fullmatch(chunk):
            return self.in_bytes(self.plain_split.findall(chunk.lower()))
        normal, split = self.library.normalizer, self.library.pre_tokenizer
        found: list[str | int] = []
        for part in self.special_re.split(chunk) if self.special_re else [chunk]:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                text = normal.normalize_str(part) if normal else part
                found += [w for w, _ in split.pre_tokenize_str(text)] if split else [text]
        return found

    @staticmethod
    def in_bytes(words: list[str]) -> list[str]:
        return [w if w.isascii() else charmap_decode(w.encode(), "strict", BYTE_LETTERS)[0] for w in words]

    def decode(self, ids: Iterable[int]) -> str:
        """As the file says, which for word_bpe_49k is: tokens joined by a space.  Ids without a token are left out."""
        if self.library.decoder is not None:
            return self.library.decode(list(map(int, ids)), skip_special_tokens=False)
        return " ".join(t for i in ids if (t := self.token.get(int(i))) is not None)


class TextCoder:
    """Encodes whole texts, remembering chunks.  Only for files that drop white space, which then parts what it stands between."""

    def __init__(self, path: str):
        self.bpe = TrieBpe(path)
        if self.bpe.suffix == "" or self.bpe.library.decoder is not None:
            raise ValueError("texts are encoded piece by piece only where white space is dropped")
        self.shown = np.array([self.bpe.token.get(i) for i in range(max(self.bpe.token) + 1)], object)
        self.codes = Codes(self._learn, KEPT_CHUNKS)

    def chunks(self, text: str) -> list[str]:
        """A text's parts between white space; of plain texts in lower case, which they are encoded in anyway."""
        if self.bpe.plain_split and "<|" not in text and _PLAIN_TEXT.fullmatch(text):
            return text.lower().split()
        return _CHUNK.findall(text)

    def _words(self, chunk: str) -> list[str | int]:
        """As TrieBpe.pieces(), without a pattern for letters and for letters with a mark after them."""
        if self.bpe.plain_split and chunk.islower() and _PLAIN.fullmatch(chunk):
            if chunk.isalpha():
                return self.bpe.in_bytes([chunk])
            if chunk[-1] in ",.;:!?" and chunk[:-1].isalpha():
                return self.bpe.in_bytes([chunk[:-1], chunk[-1]])
        return self.bpe.pieces(chunk)

    def _learn(self, chunks: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For chunks: which of them (all), their ids in a row, and how many each has."""
        split = list(map(self._words, chunks))
        coded = self.bpe.encode_words({w for words in split for w in words if isinstance(w, str)})
        ids, sizes = [], []
        for words in split:
            before = len(ids)
            for w in words:
                ids += coded[w] if isinstance(w, str) else (w,)
            sizes.append(len(ids) - before)
        yield np.arange(len(chunks)), np.array(ids, "<u4"), np.array(sizes, "int64")

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Each text's ids (little-endian, 32 bits) and its tokens joined by a space."""
        out_ids, out_text = [], []
        for at in range(0, len(texts), 512):
            part = list(map(self.chunks, texts[at : at + 512]))
            ids, ends = self.codes.of(part)
            raw, shown = ids.tobytes(), self.shown[ids].tolist()
            for low, high in pairwise(ends):
                out_ids.append(raw[4 * low : 4 * high])
                out_text.append(" ".join(shown[low:high]))
        return out_ids, out_text


def coder(path: str) -> TextCoder:
    return held_by_worker(("bpe", path), lambda: TextCoder(path))


def encode_decode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, ids array<int>, decoded string (what the ids decode to, added tokens included).

    Whole texts at any length; a null text counts as empty and gives no ids.  Repeated rows each give a row.  Other
    columns are ignored, so their names can't clash.  An empty table gives an empty result.  `tokenizer` is a path that
    every executor can read.
    """

    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = coder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, decoded = mine.encode(part.column("text").to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("int32")
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(ends), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
