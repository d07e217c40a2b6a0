"""CRC-32 of any run of words of many texts, from one scan that keeps running registers.

The texts of a block lie one after another in one buffer, their words joined by one space each.  The scan keeps the raw
register before every byte.  Registers are linear over GF(2): that of a substring is the register after it xor the
register before it, shifted by as many zero bytes as the substring is long.  So each run of words costs two look-ups and
one shift, whatever its length, and nothing is scanned twice.

The scan itself goes through fixed lanes of the buffer side by side; what a lane starts with comes from the lanes before by
the same shift.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

#: The reflected polynomial of CRC-32 and its first register.
POLYNOMIAL, FIRST = 0xEDB88320, 0xFFFFFFFF
LANE = 512
BLOCK_BYTES = 4 << 20
_SPACE = 0x20


def _one_byte() -> np.ndarray:
    """The register after one byte, for each byte, from register 0."""
    table = np.arange(256, dtype="u4")
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), table >> np.uint32(1))
    return table


_BYTE = _one_byte()


def _through(tables: np.ndarray, registers: np.ndarray) -> np.ndarray:
    return tables[0][registers & 255] ^ tables[1][(registers >> 8) & 255] ^ tables[2][(registers >> 16) & 255] ^ tables[3][registers >> 24]


@cache
def _shift_tables(k: int) -> np.ndarray:
    """Registers moved on by 2**k zero bytes, for each value of each of the register's four bytes."""
    if k == 0:
        values = np.arange(256, dtype="u4")[None, :] << np.array([[0], [8], [16], [24]], "u4")
        return _BYTE[values & 255] ^ (values >> np.uint32(8))
    half = _shift_tables(k - 1)
    return np.stack([_through(half, row) for row in half])


def shifted(registers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each register moved on by its number of zero bytes."""
    out = registers.copy()
    for k in range(int(lengths.max()).bit_length() if len(lengths) else 0):
        at = np.flatnonzero((lengths >> k) & 1)
        out[at] = _through(_shift_tables(k), out[at])
    return out


def _scan(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(registers before each byte of each lane as if it began with 0, what each lane begins with)."""
    lanes = len(buffer) // LANE + 1
    padded = np.zeros(lanes * LANE, "u1")
    padded[: len(buffer)] = buffer
    columns = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
    running, register = np.empty((LANE, lanes), "u4"), np.zeros(lanes, "u4")
    for i in range(LANE):
        running[i] = register
        register = _BYTE[(register ^ columns[i]) & 255] ^ (register >> np.uint32(8))
    # what lanes begin with, in doubling steps: afterwards lane j has what the lanes before it leave
    begin, step = np.concatenate([np.zeros(1, "u4"), register[:-1]]), 1
    while step < lanes:
        moved = shifted(begin[:-step], np.full(lanes - step, step * LANE))
        begin[step:] ^= moved
        step *= 2
    return running, begin


@dataclass
class Words:
    """The words of a block of texts: places in the normalised buffer, the text of each, registers at both ends."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    per_text: np.ndarray
    before: np.ndarray
    after: np.ndarray

    def crcs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(CRC-32, text) of every run of so many words of one text, joined by one space."""
        n = max(0, len(self.starts) - length + 1)
        last = np.arange(n) + length - 1
        first = np.flatnonzero(self.text[:n] == self.text[last])
        last = last[first]
        moved = shifted(self.before[first] ^ np.uint32(FIRST), self.ends[last] - self.starts[first])
        return self.after[last] ^ moved ^ np.uint32(FIRST), self.text[first]


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]].  classes maps a byte to what stands for it, separators to a space."""
    low = classes[data]
    inside = low != _SPACE
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) + np.cumsum(begins)[at] - 1  # one space before each word but the first
    head = np.flatnonzero(begins[at])
    starts = place[head]
    ends = starts + np.diff(np.append(head, len(at)))
    buffer = np.full(len(at) + len(head), _SPACE, "u1")
    buffer[place] = low[at]
    text = np.searchsorted(offsets, at[head], side="right") - 1
    running, begin = _scan(buffer)

    def register(where: np.ndarray) -> np.ndarray:
        return running[where % LANE, where // LANE] ^ shifted(begin[where // LANE], where % LANE)

    return Words(starts, ends, text, np.bincount(text, minlength=len(offsets) - 1), register(starts), register(ends))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow array of strings or binaries, null ones being empty."""
    offsets = np.frombuffer(texts.buffers()[1], "i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    if texts.null_count:  # a null entry may still span bytes
        return bytes_of(pa.array([x or b"" for x in texts.cast(pa.binary()).to_pylist()], pa.binary()))
    data = np.frombuffer(texts.buffers()[2], "u1") if texts.buffers()[2] is not None else np.zeros(0, "u1")
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of whole rows with about so many bytes of text each; a longer text is a piece of its own."""
    if not batch.num_rows:
        return
    _, offsets = bytes_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto
