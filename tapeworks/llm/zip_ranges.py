"""Members of ZIP archives by their directories, for readers that fetch ranges of bytes.

The end record is looked for in the file's last 64 KiB; a ZIP64 end record and ZIP64 fields of an
entry replace what 16 and 32 bits can't hold. Nothing but the tail, the central directory and
a member's local header is read to find where its bytes are.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

STORED = 0
_END, _LOCATOR, _END64, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\7", b"PK\6\6", b"PK\1\2", b"PK\3\4"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int  # place of the local header


def _directory_place(read: Callable[[int, int], bytes], length: int) -> tuple[int, int, int]:
    """Start, bytes and entries of the central directory."""
    base = max(0, length - 22 - _FULL16)
    tail = read(base, length - base)
    at = tail.rfind(_END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):  # not a signature inside the comment
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP archive, or cut off")
    entries, size, start = struct.unpack_from("<HII", tail, at + 10)
    if _FULL16 in (entries,) or _FULL32 in (size, start):
        place = base + at - 20
        locator = read(place, 20) if place >= 0 else b""
        if locator[:4] != _LOCATOR:
            raise ValueError("no ZIP64 locator before the end record")
        place = struct.unpack_from("<Q", locator, 8)[0]
        record = read(place, 56)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 end record where the locator says")
        entries, size, start = struct.unpack_from("<QQQ", record, 32)
    return start, size, entries


def members(read: Callable[[int, int], bytes], length: int) -> list[Member]:
    """All members of an archive of `length` bytes; read(start, size) gives bytes of it."""
    start, size, entries = _directory_place(read, length)
    raw, at, out = read(start, size), 0, []
    for _ in range(entries):
        if raw[at : at + 4] != _ENTRY:
            raise ValueError("broken central directory")
        flags, method, crc, packed, full, n_name, n_extra, n_comment, header = struct.unpack_from("<HH4xIIIHHH8xI", raw, at + 8)
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # in this order, each only where its field is full
                fields = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                full = next(fields) if full == _FULL32 else full
                packed = next(fields) if packed == _FULL32 else packed
                header = next(fields) if header == _FULL32 else header
            e += 4 + n
        out.append(Member(name, method, crc, packed, full, header))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_place(read: Callable[[int, int], bytes], member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed: no ranges of it can be read")
    local = read(member.header, 30)
    if local[:4] != _LOCAL:
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))
