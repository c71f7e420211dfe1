"""Reading ZIP archives by range: end record, ZIP64 directory, stored members."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import Protocol

# Signatures and sizes of the ZIP format.
_END, _END64_LOCATOR, _END64, _CENTRAL, _LOCAL = (
    b"PK\x05\x06",
    b"PK\x06\x07",
    b"PK\x06\x06",
    b"PK\x01\x02",
    b"PK\x03\x04",
)
_END_SIZE, _LOCATOR_SIZE, _END64_SIZE, _CENTRAL_SIZE, _LOCAL_SIZE = 22, 20, 56, 46, 30
_MAX_COMMENT = 0xFFFF
_ZIP64_EXTRA = 1
_WIDE, _WIDE16 = 0xFFFFFFFF, 0xFFFF


class RangeFile(Protocol):
    def size(self) -> int: ...

    def read_at(self, nbytes: int, offset: int) -> bytes: ...


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


class ZipError(ValueError):
    """The file isn't a ZIP archive that can be read by range."""


def _end(file: RangeFile) -> tuple[int, int, int]:
    """(offset, size, entries) of the central directory."""
    total = file.size()
    tail_at = max(0, total - _END_SIZE - _MAX_COMMENT - _LOCATOR_SIZE)
    tail = file.read_at(total - tail_at, tail_at)
    at = len(tail) - _END_SIZE
    while at >= 0:
        at = tail.rfind(_END, 0, at + len(_END))
        if at < 0:
            break
        if at + _END_SIZE + int.from_bytes(tail[at + 20 : at + 22], "little") == len(tail):
            break  # the comment ends with the file
        at -= 1
    if at < 0:
        raise ZipError("no end of central directory")
    entries, size, offset = struct.unpack("<HII", tail[at + 10 : at + 20])
    if entries == _WIDE16 or size == _WIDE or offset == _WIDE:
        locator = tail[at - _LOCATOR_SIZE : at] if at >= _LOCATOR_SIZE else b""
        if locator[:4] == _END64_LOCATOR:
            (where,) = struct.unpack("<Q", locator[8:16])
            end = file.read_at(_END64_SIZE, where)
            if end[:4] != _END64:
                raise ZipError("no ZIP64 end of central directory")
            entries, size, offset = struct.unpack("<QQQ", end[32:56])
    return offset, size, entries


def _wide(extra: bytes, size: int, packed: int, header: int) -> tuple[int, int, int]:
    """Sizes and offset with those that the ZIP64 extra field holds put in."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack("<HH", extra[at : at + 4])
        if kind == _ZIP64_EXTRA:
            body, values = extra[at + 4 : at + 4 + length], [size, packed, header]
            for i, v in enumerate(values):
                if v == _WIDE:
                    if len(body) < 8:
                        raise ZipError("short ZIP64 field")
                    values[i], body = int.from_bytes(body[:8], "little"), body[8:]
            return values[0], values[1], values[2]
        at += 4 + length
    return size, packed, header


def members(file: RangeFile) -> list[Member]:
    """All members by the central directory; no member data is read."""
    offset, size, entries = _end(file)
    data, at, out = file.read_at(size, offset), 0, []
    for _ in range(entries):
        if data[at : at + 4] != _CENTRAL:
            raise ZipError("broken central directory")
        flags, method = struct.unpack("<HH", data[at + 8 : at + 12])
        packed, full, n_name, n_extra, n_comment = struct.unpack("<IIHHH", data[at + 20 : at + 34])
        (header,) = struct.unpack("<I", data[at + 42 : at + 46])
        name = data[at + _CENTRAL_SIZE : at + _CENTRAL_SIZE + n_name]
        extra_at = at + _CENTRAL_SIZE + n_name
        full, packed, header = _wide(data[extra_at : extra_at + n_extra], full, packed, header)
        out.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, full, packed, header))
        at = extra_at + n_extra + n_comment
    return out


def stored_range(file: RangeFile, member: Member) -> tuple[int, int]:
    """(offset, size) of a stored member's bytes in the file."""
    if member.method != 0:
        raise ZipError(f"{member.name} is compressed; only stored members are read by range")
    head = file.read_at(_LOCAL_SIZE, member.header)
    if head[:4] != _LOCAL:
        raise ZipError(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    return member.header + _LOCAL_SIZE + n_name + n_extra, member.size
