"""Camera fields of image bytes: a walk through the TIFF directories in a JPEG, PNG or TIFF file.

The walk reads the byte order, the chain of directories and the two sub-directories (camera, position), and
resolves values that are stored elsewhere in the file. Bytes of other formats, without these directories, cut off within one,
or with a directory that is reached twice, give null; a field that is missing or not of its type is null within the struct.
Files are walked in Arrow batches on the executors, a row at a time; only the fields go on.
"""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

#: Fixed values of the format: bytes by value type, and tags of the directories.
_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_LETTER = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_CAMERA, _POSITION = 0x8769, 0x8825
MAKE, MODEL, ORIENTATION, DATE = 0x010F, 0x0110, 0x0112, 0x0132
EXPOSURE, APERTURE, ISO, TAKEN, FOCAL, WIDTH, HEIGHT = 0x829A, 0x829D, 0x8827, 0x9003, 0x920A, 0xA002, 0xA003

FIELDS = StructType(
    [StructField(n, StringType()) for n in ("make", "model", "taken")]
    + [StructField(n, IntegerType()) for n in ("orientation", "iso", "width", "height")]
    + [StructField(n, DoubleType()) for n in ("exposure", "aperture", "focal", "latitude", "longitude")]
)


def tiff_start(data: bytes) -> int | None:
    """Where the TIFF header lies in a file; None if there is none."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return 0
    if data[:2] == b"\xff\xd8":
        at = 2
        while data[at : at + 1] == b"\xff" and (kind := data[at + 1]) not in (0xD9, 0xDA):  # segments up to the image data
            if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return at + 10
            at += 2 + int.from_bytes(data[at + 2 : at + 4])
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while data[at + 4 : at + 8] not in (b"eXIf", b"IEND", b""):
            at += 12 + int.from_bytes(data[at : at + 4])
        return at + 8 if data[at + 4 : at + 8] == b"eXIf" else None
    return None


class _Directories:
    def __init__(self, data: memoryview):
        self.data, self.order, self.seen = data, "<" if data[:2] == b"II" else ">", set()
        if self._at("H", 2)[0] != 42:
            raise ValueError("no TIFF header")

    def _at(self, form: str, at: int) -> tuple:
        return struct.unpack_from(self.order + form, self.data, at)

    def read(self, at: int) -> tuple[dict, int]:
        """({tag: (type, count, place of the value)}, place of the next directory or 0)."""
        if at in self.seen:
            raise ValueError("a directory is reached twice")
        self.seen.add(at)
        n, entries = self._at("H", at)[0], {}
        for i in range(n):
            tag, kind, count = self._at("HHI", at + 2 + 12 * i)
            size = _BYTES.get(kind, 0) * count
            entries[tag] = (kind, count, at + 10 + 12 * i if size <= 4 else self._at("I", at + 10 + 12 * i)[0])
        return entries, self._at("I", at + 2 + 12 * n)[0]

    def values(self, entries: dict, tag: int) -> list | None:
        """Numbers, a text in a list, or None for no such field."""
        if tag not in entries:
            return None
        kind, count, at = entries[tag]
        if at + _BYTES.get(kind, 0) * count > len(self.data):
            raise ValueError("a value is cut off")
        if kind == 2:
            return [bytes(self.data[at : at + count]).split(b"\0")[0].decode("utf-8", "replace").strip()]
        if kind in (5, 10):
            pairs = self._at(("II" if kind == 5 else "ii") * count, at)
            return [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        return list(self._at(_LETTER[kind] * count, at)) if kind in _LETTER else None


def _date(text: str | None) -> str | None:
    m = re.fullmatch(r"(\d{4}):(\d\d):(\d\d) (\d\d:\d\d:\d\d)", text or "")
    return f"{m[1]}-{m[2]}-{m[3]}T{m[4]}" if m and m[1] > "0000" else None


def _degrees(parts: list | None, side: list | None, minus: str) -> float | None:
    if not parts or len(parts) != 3 or None in parts:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -value if side and side[0] == minus else value


def fields(data: bytes | None) -> tuple | None:
    """The fields of one file in the order of FIELDS; None if it has no readable directories."""
    try:
        if data is None or (start := tiff_start(data)) is None:
            return None
        walk = _Directories(memoryview(data)[start:])
        main, following = walk.read(walk._at("I", 4)[0])
        subs = [walk.read(walk.values(main, tag)[0])[0] if tag in main else {} for tag in (_CAMERA, _POSITION)]
        while following:
            following = walk.read(following)[1]
        one = lambda entries, tag, kind: v[0] if (v := walk.values(entries, tag)) and isinstance(v[0], kind) else None
        camera, place = subs
        number = (int, float)
        return (
            one(main, MAKE, str), one(main, MODEL, str), _date(one(camera, TAKEN, str) or one(main, DATE, str)),
            one(main, ORIENTATION, int), one(camera, ISO, int), one(camera, WIDTH, int), one(camera, HEIGHT, int),
            *(None if (v := one(camera, tag, number)) is None else float(v) for tag in (EXPOSURE, APERTURE, FOCAL)),
            _degrees(walk.values(place, 2), walk.values(place, 1), "S"), _degrees(walk.values(place, 4), walk.values(place, 3), "W"),
        )
    except (ValueError, IndexError, struct.error, OverflowError, TypeError):
        return None


@F.pandas_udf(FIELDS)
def _fields_udf(content: pd.Series) -> pd.DataFrame:
    rows = [fields(d) or (None,) * len(FIELDS) for d in content]
    return pd.DataFrame(rows, columns=FIELDS.names, dtype=object)


def camera_fields(content):
    """struct of FIELDS of a column of file bytes; null where no field could be read."""
    got = _fields_udf(content)
    return F.when(F.coalesce(*[got[n].cast("string") for n in FIELDS.names]).isNotNull(), got)
