"""Capture date from the first bytes of a JPEG or TIFF file."""

from __future__ import annotations

import struct

# Tag numbers of the two date entries and of the pointer to the embedded directory.
DATE_TIME, DATE_TIME_ORIGINAL, EXIF_POINTER = 0x0132, 0x9003, 0x8769
HEAD_BYTES = 65536
_ASCII = 2


def _tiff_block(head: bytes) -> bytes | None:
    if head[:4] in (b"II*\x00", b"MM\x00*"):
        return head
    if head[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(head) and head[at] == 0xFF:
        marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        if marker == 0xE1 and head[at + 4 : at + 10] == b"Exif\x00\x00":
            return head[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def raw_dates(head: bytes) -> list[str]:
    """Texts of the date entries in file order: main directory, then the embedded one."""
    tiff = _tiff_block(head)
    if not tiff or len(tiff) < 8:
        return []
    end = "<" if tiff[:2] == b"II" else ">"
    found: list[str] = []
    pending, visited = [struct.unpack_from(end + "I", tiff, 4)[0]], set()
    while pending:
        at = pending.pop(0)
        if at in visited or at + 2 > len(tiff):
            continue
        visited.add(at)
        for k in range(struct.unpack_from(end + "H", tiff, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(tiff):
                break
            tag, kind, count = struct.unpack_from(end + "HHI", tiff, entry)
            value = struct.unpack_from(end + "I", tiff, entry + 8)[0]
            if tag == EXIF_POINTER:
                pending.append(value)
            elif tag in (DATE_TIME, DATE_TIME_ORIGINAL) and kind == _ASCII:
                start = entry + 8 if count <= 4 else value
                found.append(tiff[start : start + count].split(b"\x00")[0].decode("ascii", "replace"))
    return found
