"""A materialised result with typed access and a text form."""

from __future__ import annotations

import datetime as dt
import io
from typing import Any, TextIO

from pyspark.sql import types as T


class Result:
    def __init__(self, schema: T.StructType, rows: list) -> None:
        self.schema, self.rows = schema, rows

    @property
    def row_count(self) -> int:
        return len(self.rows)

    @property
    def column_names(self) -> list[str]:
        return self.schema.names

    def is_null(self, row: int, column: int) -> bool:
        return self.rows[row][column] is None

    def get(self, row: int, column: int) -> Any:
        return self.rows[row][column]

    def print(self, out: TextIO) -> None:
        """A header and one line a row, cells parted by " | "."""
        out.write(" | ".join(self.column_names) + "\n")
        for r in self.rows:
            out.write(" | ".join(_cell(v) for v in r) + "\n")

    def __str__(self) -> str:
        buffer = io.StringIO()
        self.print(buffer)
        return buffer.getvalue()


def _cell(v: Any) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return v.isoformat() if isinstance(v, dt.date) else str(v)
