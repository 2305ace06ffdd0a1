"""Sizes of objects in memory, by the convention of the dump's readers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a value of each type but references.
WIDTHS = {"boolean": 1, "byte": 1, "char": 2, "short": 2, "int": 4, "float": 4, "long": 8, "double": 8}
COMPRESSED_LIMIT = 32 << 30


@dataclass(frozen=True)
class Sizing:
    """Bytes of an object's header, an array's header and a reference."""

    header: int
    array_header: int
    reference: int

    @staticmethod
    def resolve(mode: str, id_size: int, max_id: int) -> Sizing:
        """mode: mat, compressed, full, or auto: by the width of ids and the largest one."""
        if mode == "auto":
            mode = "mat" if id_size == 4 else "compressed" if max_id < COMPRESSED_LIMIT else "full"
        if mode == "compressed":
            return Sizing(12, 16, 4)
        if mode == "full":
            return Sizing(16, 24, 8)
        return Sizing(2 * id_size, 16 if id_size == 8 else 12, id_size)

    def width(self, kind: str) -> int:
        return WIDTHS.get(kind, self.reference)

    def instance(self, field_bytes: Column) -> Column:
        return aligned(field_bytes + self.header)

    def array(self, length: Column, element: Column) -> Column:
        return F.least(aligned(length * element + self.array_header), F.lit((1 << 32) - 1))


def aligned(n: Column) -> Column:
    return (F.ceil(n / 8) * 8).cast("long")
