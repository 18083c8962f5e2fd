"""Byte codecs of the archive: ULEB128, bit fields, header, footers and rank sidecars (driver or worker side)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The archive's magic bytes, version and header size, and the longest ULEB128.
MAGIC, VERSION, HEADER_BYTES, ULEB_MAX = b"SCS", 2, 12, 10
_ORDERED = 1 << 55


class ArchiveError(ValueError):
    """The bytes are no valid archive."""


def uleb_encode(n: int) -> bytes:
    if not 0 <= n < 1 << 64:
        raise ValueError(f"{n} is no unsigned 64-bit integer")
    groups = max(1, -(-n.bit_length() // 7))
    return bytes((n >> 7 * i & 127) | (128 if i < groups - 1 else 0) for i in range(groups))


def uleb_column(values: np.ndarray) -> bytes:
    """The codes of non-negative integers one after another, vectorised."""
    values = values.astype(np.uint64)
    groups = np.ones(len(values), np.int64)
    for i in range(1, ULEB_MAX):
        groups += values >> np.uint64(7 * i) > 0
    ends = np.cumsum(groups)
    out, starts = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8), ends - groups
    for i in range(int(groups.max()) if len(groups) else 0):
        has = groups > i
        out[starts[has] + i] = (values[has] >> np.uint64(7 * i) & np.uint64(127)) | np.where(groups[has] > i + 1, np.uint64(128), np.uint64(0))
    return out.tobytes()


def uleb_decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, bytes read)."""
    total = 0
    for i in range(ULEB_MAX):
        if at + i >= len(data):
            raise ArchiveError("truncated ULEB128")
        total |= (data[at + i] & 127) << 7 * i
        if data[at + i] < 128:
            if total >> 64:
                raise ArchiveError("ULEB128 exceeds 64 bits")
            return total, i + 1
    raise ArchiveError("ULEB128 longer than 10 bytes")


def bits_needed(n: int) -> int:
    return max(1, n.bit_length())


def pack_bits(fields: list[tuple[int, int]]) -> bytes:
    """(value, width) fields, lowest bit first, padded with zeros to a byte."""
    value, at = 0, 0
    out = bytearray()
    for v, width in fields:
        value |= (v & ((1 << width) - 1)) << at
        at += width
        whole = at // 8
        out += (value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
        value >>= 8 * whole
        at -= 8 * whole
    return bytes(out) + (value.to_bytes(1, "little") if at else b"")


def unpack_bits(data: bytes, widths: list[int]) -> list[int]:
    """Inverse of ``pack_bits``; reading beyond the end is an error."""
    if sum(widths) > 8 * len(data):
        raise ArchiveError("bit fields run past the end")
    out, value, held, at = [], 0, 0, 0
    for w in widths:
        while held < w:
            value |= data[at] << held
            held, at = held + 8, at + 1
        out.append(value & ((1 << w) - 1))
        value >>= w
        held -= w
    return out


def pack_columns(values: list[np.ndarray], widths: list[int]) -> bytes:
    """Rows of fixed-width fields, vectorised: same bytes as ``pack_bits`` over the rows' fields."""
    planes = [((v.astype(np.uint64)[:, None] >> np.arange(w, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) for v, w in zip(values, widths, strict=True)]
    return np.packbits(np.concatenate(planes, axis=1).ravel(), bitorder="little").tobytes()


def unpack_columns(data: bytes, rows: int, widths: list[int]) -> list[np.ndarray]:
    need = rows * sum(widths)
    if need > 8 * len(data):
        raise ArchiveError("bit fields run past the end")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=need, bitorder="little").reshape(rows, sum(widths)).astype(np.uint64)
    out, at = [], 0
    for w in widths:
        out.append((bits[:, at : at + w] << np.arange(w, dtype=np.uint64)).sum(axis=1, dtype=np.uint64))
        at += w
    return out


@dataclass(frozen=True)
class Header:
    separator: bytes
    ordered: bool
    footer: int
    version: int = VERSION

    def encode(self) -> bytes:
        if not 0 <= self.footer < _ORDERED:
            raise ValueError("footer offset exceeds 55 bits")
        tail = self.footer | (_ORDERED if self.ordered else 0)
        return MAGIC + bytes([self.version]) + self.separator[:1] + tail.to_bytes(7, "little")

    @classmethod
    def decode(cls, data: bytes) -> Header:
        if len(data) < HEADER_BYTES:
            raise ArchiveError("shorter than a header")
        if data[:3] != MAGIC:
            raise ArchiveError("no archive: wrong magic bytes")
        if data[3] != VERSION:
            raise ArchiveError(f"version {data[3]} is not supported")
        tail = int.from_bytes(data[5:12], "little")
        return cls(data[4:5], bool(tail & _ORDERED), tail & (_ORDERED - 1), data[3])


def ordered_footer(lengths: np.ndarray, offsets: np.ndarray, payload: int) -> bytes:
    """Footer of an ordered archive: the widest length, the number of lines, then (length, offset) bit fields."""
    most = int(lengths.max()) if len(lengths) else 0
    head = uleb_encode(most) + uleb_encode(len(lengths))
    return head + (pack_columns([lengths, offsets], [bits_needed(most), bits_needed(payload)]) if len(lengths) else b"")


def unordered_footer(lengths: np.ndarray, offsets: np.ndarray) -> bytes:
    """Footer of an unordered archive: per length ascending its count and the deltas of its ascending offsets."""
    out = bytearray()
    order = np.lexsort((offsets, lengths))
    lengths, offsets = lengths[order], offsets[order]
    sizes, first, counts = np.unique(lengths, return_index=True, return_counts=True)
    for size, at, n in zip(sizes.tolist(), first.tolist(), counts.tolist(), strict=True):
        out += uleb_encode(size) + uleb_encode(n)
        for delta in np.diff(offsets[at : at + n], prepend=0).tolist():
            out += uleb_encode(delta)
    return bytes(out)


def decode_footer(footer: bytes, ordered: bool, payload: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, offsets): lines in order, or words by offset.  Entries outside the payload, truncated fields and impossible
    counts are errors."""
    if ordered:
        most, a = uleb_decode(footer)
        n, b = uleb_decode(footer, a)
        width = [bits_needed(most), bits_needed(payload)]
        if n * sum(width) > 8 * (len(footer) - a - b):
            raise ArchiveError("more lines than the footer holds")
        lengths, offsets = unpack_columns(footer[a + b :], n, width) if n else (np.empty(0, np.uint64), np.empty(0, np.uint64))
    else:
        sizes, places, at = [], [], 0
        while at < len(footer):
            size, step = uleb_decode(footer, at)
            n, more = uleb_decode(footer, at + step)
            at += step + more
            if n > len(footer) - at:
                raise ArchiveError("more words than the footer holds")
            place = 0
            for _ in range(n):
                delta, step = uleb_decode(footer, at)
                place, at = place + delta, at + step
                if place + size > payload:
                    raise ArchiveError("a word ends outside the payload")
                sizes.append(size)
                places.append(place)
        lengths, offsets = np.array(sizes, np.uint64), np.array(places, np.uint64)
        order = np.argsort(offsets, kind="stable")
        lengths, offsets = lengths[order], offsets[order]
    if len(lengths) and int((lengths + offsets).max()) > payload:
        raise ArchiveError("a word ends outside the payload")
    return lengths.astype(np.int64), offsets.astype(np.int64)


def split_archive(data: bytes) -> tuple[Header, bytes, bytes]:
    """(header, payload, footer)."""
    head = Header.decode(data)
    if not HEADER_BYTES <= head.footer <= len(data):
        raise ArchiveError("footer offset lies outside the file")
    return head, data[HEADER_BYTES : head.footer], data[head.footer :]


def decode_archive(data: bytes) -> tuple[Header, bytes, list[tuple[bytes, int, int]]]:
    """(header, payload, [(word, offset, length)])."""
    head, payload, footer = split_archive(data)
    lengths, offsets = decode_footer(footer, head.ordered, len(payload))
    return head, payload, [(payload[o : o + n], o, n) for n, o in zip(lengths.tolist(), offsets.tolist(), strict=True)]


def encode_ranks(ranks: list[int | None]) -> bytes:
    """Rank sidecar: little-endian unsigned 32-bit integers in footer order; a missing rank is an error."""
    if any(r is None for r in ranks):
        raise ArchiveError("a word has no rank")
    return np.array(ranks, "<u4").tobytes()


def decode_ranks(data: bytes) -> list[int]:
    if len(data) % 4:
        raise ArchiveError("rank sidecar is no multiple of 4 bytes")
    return np.frombuffer(data, "<u4").tolist()
