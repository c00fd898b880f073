"""What a camera wrote about a picture: a few tags of the TIFF directory inside a JPEG, or of a TIFF file itself."""

from __future__ import annotations

import struct

#: Tags that are kept (fixed values of the format).
TAGS = {0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "DateTime"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4}


def directory(content: bytes) -> bytes:
    """The TIFF part of a picture, empty without one."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        return content
    at = 2
    while content.startswith(b"\xff\xd8") and at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return content[at + 10 : at + 2 + size]
        at += 2 + size
    return b""


def facts(content: bytes) -> dict[str, str]:
    """The kept tags as text; damaged directories give what can be read of them."""
    tiff = directory(content)
    order = "<" if tiff[:2] == b"II" else ">"
    out: dict[str, str] = {}
    try:
        (first,) = struct.unpack_from(order + "I", tiff, 4)
        (entries,) = struct.unpack_from(order + "H", tiff, first)
        for i in range(entries):
            at = first + 2 + 12 * i
            tag, kind, n = struct.unpack_from(order + "HHI", tiff, at)
            if tag not in TAGS or kind not in SIZES:
                continue
            size = SIZES[kind] * n
            place = at + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, at + 8)[0]
            if kind == 2:
                out[TAGS[tag]] = tiff[place : place + n].split(b"\0")[0].decode("latin-1").strip()
            else:
                out[TAGS[tag]] = str(struct.unpack_from(order + {1: "B", 3: "H", 4: "I"}[kind], tiff, place)[0])
    except struct.error:
        pass
    return out
