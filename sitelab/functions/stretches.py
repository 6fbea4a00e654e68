"""Gap-free stretches of aligned reads and their base counts, in numpy, a block of rows at a time."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from sitelab.functions.pileup import COUNT_FIELDS

#: Positions of a bin of the axis.
WIDTH = 1 << 9
#: Rows, and letters of reads, that are laid out at a time.
BLOCK = 4096
LETTERS = 1 << 20
REVERSE_FLAG = 16

_CODE = np.full(256, 4, dtype=np.uint8)
_CODE[np.frombuffer(b"ACGTacgt", dtype=np.uint8)] = [0, 1, 2, 3] * 2
_NONE = np.iinfo(np.int64).max
_STEP = re.compile(r"(\d+)([MIDNSHP=X])")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text of a column starts, and at the end where the last one ends, next to their bytes."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``_bytes``, with one byte for every letter."""
    offsets, data = _bytes(column)
    behind = (data & 0xC0) == 0x80
    if behind.any():
        # Of a letter beyond ASCII only the first byte stays, which is no base.
        offsets, data = np.append(0, np.cumsum(~behind))[offsets], data[~behind]
    return offsets, data


def _qualities(column: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """One byte for every letter of texts that lie at ``offsets``; a letter without a quality has the lowest."""
    ends, quality = _letters(column)
    if np.array_equal(offsets, ends):
        return quality
    of = np.repeat(np.arange(len(column)), np.diff(offsets))
    behind = np.arange(offsets[-1]) - offsets[of]
    known = behind < np.diff(ends)[of]
    out = np.zeros(offsets[-1], dtype=np.uint8)
    out[known] = quality[(ends[of] + behind)[known]]
    return out


@functools.lru_cache(1 << 16)
def aligned(cigar: str) -> np.ndarray:
    """Gap-free stretches of a CIGAR: (bases of the reference before it, bases of the read before it, length).

    Deletions and skips leave the stretches around them, so they count nowhere.
    """
    at = read_at = 0
    out = []
    for n, op in _STEP.findall(cigar):
        n = int(n)
        if op in "M=X":
            out.append((at, read_at, n))
        at += n if op in "M=XDN" else 0
        read_at += n if op in "M=XIS" else 0
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def cut_reads(batches: Iterable[pa.RecordBatch], keep: list[str], min_baseq: int) -> Iterator[pa.RecordBatch]:
    """(keep..., place, at, bases, quals): the aligned bases of reads, one row for each bin of the axis that holds some.

    Rows are (keep..., start, cigar, bases, quals) without NULLs, ``start`` counted from 1. The texts
    start ``at`` so many bases behind the start of the bin ``place``; a zero byte stands where the read has
    no base. Rows without a base of enough quality are left out.
    """
    for batch in batches:
        size = max(1, min(BLOCK, LETTERS * batch.num_rows // (batch.column("bases").nbytes + 1)))
        for part in (batch.slice(i, size) for i in range(0, batch.num_rows, size)):
            offsets, letters = _letters(part.column("bases"))
            quality = _qualities(part.column("quals"), offsets)
            cigars = part.column("cigar").dictionary_encode()
            walks = [aligned(c) for c in cigars.dictionary.to_pylist()]
            number = cigars.indices.to_numpy()
            many = np.array([len(w) for w in walks])
            row, nth = _each(many[number])
            before, read_at, length = np.concatenate(walks)[(np.cumsum(many) - many)[number][row] + nth].T
            begin = part.column("start").to_numpy()[row] - 1 + before
            # No longer than the letters there are.
            end = begin + np.minimum(length, np.diff(offsets)[row] - read_at)
            some = np.flatnonzero(end > begin)
            if not len(some):
                continue
            row, begin, end, source = row[some], begin[some], end[some], (offsets[row] + read_at - begin)[some]
            piece, nth = _each((end - 1) // WIDTH - begin // WIDTH + 1)
            place = begin[piece] // WIDTH + nth
            left, right = np.maximum(begin[piece], place * WIDTH), np.minimum(end[piece], (place + 1) * WIDTH)
            # Stretches of a read in one bin follow each other, and are one row.
            first = np.flatnonzero((np.diff(row[piece], prepend=-1) != 0) | (np.diff(place, prepend=place[0]) != 0))
            group = np.repeat(np.arange(len(first)), np.diff(first, append=len(piece)))
            start = left[first]
            where = np.append(0, np.cumsum(right[np.append(first[1:], len(piece)) - 1] - start))
            of, nth = _each(right - left)
            to, at = (where[group] + left - start[group])[of] + nth, (source[piece] + left)[of] + nth
            texts = np.zeros((2, where[-1]), dtype=np.uint8)
            texts[0, to], texts[1, to] = letters[at], quality[at]
            columns = [c.take(pa.array(row[piece[first]])) for c in part.select(keep).columns]
            columns += [pa.array(place[first]), pa.array((start - place[first] * WIDTH).astype(np.int32))]
            columns += [
                pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(where.astype(np.int32)), pa.py_buffer(t)]) for t in texts
            ]
            out = pa.RecordBatch.from_arrays(columns, names=[*keep, "place", "at", "bases", "quals"])
            yield out.filter(pa.array(np.maximum.reduceat(texts[1], where[:-1]) >= max(1, min_baseq + 33)))


def _each(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row number as often as its size says, and which of its turns it is."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]


def _order(quality: np.ndarray, flag: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Highest quality, then the smallest flag, then the first base, from the high bits to the low ones."""
    return ((255 - quality.astype(np.int64)) << 40) + (flag.astype(np.int64) << 8) + code


def _field(order: np.ndarray) -> np.ndarray:
    """The place in COUNT_FIELDS of what ``_order`` packed."""
    return (order & 255) * 2 + ((order >> 8) & REVERSE_FLAG != 0)


@dataclass
class _Bin:
    """A bin of which more rows may follow: counts of its sites, and the best base of its last name by position."""

    keys: pa.RecordBatch
    sites: np.ndarray
    counts: np.ndarray
    best: np.ndarray

    def settle(self) -> None:
        """Adds the last name's bases, of which no more follow."""
        at = np.flatnonzero(self.best < _NONE)
        self.counts[np.searchsorted(self.sites, at), _field(self.best[at])] += 1


def _found(keys: pa.RecordBatch, row: np.ndarray, sites: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sites with a count, next to the keys of the rows that name their bins."""
    some = np.flatnonzero(counts.any(axis=1))
    keys = keys.take(pa.array(row[some]))
    position = keys.column("place").to_numpy() * WIDTH + sites[some] + 1
    keys = keys.drop_columns("place")
    return pa.RecordBatch.from_arrays(
        [*keys.columns, pa.array(position), *[pa.array(counts[some, i]) for i in range(len(COUNT_FIELDS))]],
        names=[*keys.schema.names, "position", *COUNT_FIELDS],
    )


def count_bins(batches: Iterable[pa.RecordBatch], by: list[str], min_baseq: int) -> Iterator[pa.RecordBatch]:
    """(by..., position, counts...) at the wanted sites, from reads cut at the bins of the axis.

    Rows are (by..., place, row, name, flag, at, bases, quals, wanted), the texts as ``cut_reads`` leaves
    them: the rows of a bin follow each other, ordered by name; ``row`` is 1 where a bin starts and ``name``
    a number that grows with each name; ``wanted`` has a bit for each position of the bin, set at sites.
    Reads of one name count once at a site, by their best base. Between blocks only one bin's
    counts and one name's bases stay, however many rows either has.
    """
    size = len(COUNT_FIELDS)
    held: _Bin | None = None
    name = 0
    for part in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
        row, names, flag, at = (part.column(c).to_numpy() for c in ("row", "name", "flag", "at"))
        keys = part.select([*by, "place"])
        new_bin = row == 1
        new_name = new_bin | (np.diff(names, prepend=name) != 0)
        name = names[-1]
        if held is not None and new_name[0]:
            held.settle()
        if held is not None and new_bin[0]:
            yield _found(held.keys, np.zeros(len(held.sites), dtype=int), held.sites, held.counts)
            held = None
        bins = np.cumsum(new_bin) - new_bin[0]
        starts = np.append(0, np.flatnonzero(new_bin[1:]) + 1)
        wanted = np.unpackbits(_bytes(part.column("wanted").take(pa.array(starts)))[1]).astype(bool)
        # Cells are the positions of all bins of the block, sites those wanted of them.
        sites, site_of = np.flatnonzero(wanted), np.cumsum(wanted) - 1

        # One entry for each base that counts: its row, cell, code and quality.
        (offsets, letters), (_, quality) = _bytes(part.column("bases")), _bytes(part.column("quals"))
        of, nth = _each(np.diff(offsets))
        cell = (bins * WIDTH + at)[of] + nth
        code = _CODE[letters]
        good = np.flatnonzero((code < 4) & (quality >= max(1, min_baseq + 33)) & wanted[cell])
        of, cell, code, quality = of[good], cell[good], code[good], quality[good]
        # A name with one row counts at once; whether the last name goes on is not known yet.
        alone = new_name & np.append(new_name[1:], False)
        single = alone[of]
        reverse = flag & REVERSE_FLAG != 0
        found = site_of[cell[single]] * size + code[single] * 2 + reverse[of[single]]
        counts = np.bincount(found, minlength=len(sites) * size)
        # Of the other names each has cells of its own; the first may have begun before.
        shared = np.cumsum(new_name & ~alone) - (held is None or new_name[0])
        bin_of = np.zeros(shared[-1] + 1, dtype=int)
        bin_of[shared[~alone]] = bins[~alone]
        best = np.full(len(bin_of) * WIDTH, _NONE)
        if held is not None:
            counts[: held.counts.size] += held.counts.ravel()
            if not new_name[0]:
                best[:WIDTH] = held.best
        of, cell, code, quality = of[~single], cell[~single], code[~single], quality[~single]
        np.minimum.at(best, shared[of] * WIDTH + cell % WIDTH, _order(quality, flag[of], code))
        done = np.flatnonzero(best[:-WIDTH] < _NONE)
        found = site_of[bin_of[done // WIDTH] * WIDTH + done % WIDTH] * size + _field(best[done])
        counts = (counts + np.bincount(found, minlength=len(counts))).reshape(-1, size)

        open_ = np.searchsorted(sites, bins[-1] * WIDTH)
        if open_:
            yield _found(keys, starts[sites[:open_] // WIDTH], sites[:open_] % WIDTH, counts[:open_])
        held = _Bin(keys.slice(part.num_rows - 1), sites[open_:] % WIDTH, counts[open_:], best[-WIDTH:])
    if held is not None:
        held.settle()
        yield _found(held.keys, np.zeros(len(held.sites), dtype=int), held.sites, held.counts)
