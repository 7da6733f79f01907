"""Keys and values of messages to bytes and back, as columns.

Opaque Python objects are not decoded: they stay binary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_bytes(value: Column, charset: str = "UTF-8") -> Column:
    """Text to bytes; binary passes through as it is by the caller's choice, other types by their text."""
    return F.encode(value.cast("string"), charset)


def bytes_string(value: Column, charset: str = "UTF-8") -> Column:
    return F.decode(value, charset)


def json_bytes(*columns: Column) -> Column:
    return F.encode(F.to_json(F.struct(*columns)), "UTF-8")


def bytes_json(value: Column, schema: str) -> Column:
    """Bytes to a struct of the given schema, null where the JSON is broken."""
    return F.from_json(F.decode(value, "UTF-8"), schema)


@dataclass(frozen=True)
class Codec:
    """How keys and values are written: ``string``, ``json`` or ``binary`` (left alone).

    A null becomes no bytes and no bytes become null, so an empty text reads back as null.
    """

    key: str = "string"
    value: str = "json"
    value_schema: str | None = None

    def encode_key(self, column: Column) -> Column:
        return F.coalesce(self._encode(self.key, column), F.lit(b""))

    def encode_value(self, column: Column) -> Column:
        return F.coalesce(self._encode(self.value, column), F.lit(b""))

    def decode_key(self, column: Column) -> Column:
        return self._decode(self.key, F.nullif(column, F.lit(b"")), None)

    def decode_value(self, column: Column) -> Column:
        return self._decode(self.value, F.nullif(column, F.lit(b"")), self.value_schema)

    @staticmethod
    def _encode(kind: str, column: Column) -> Column:
        if kind == "string":
            return string_bytes(column)
        if kind == "json":
            return F.encode(F.to_json(column), "UTF-8")
        return column

    @staticmethod
    def _decode(kind: str, column: Column, schema: str | None) -> Column:
        if kind == "string":
            return bytes_string(column)
        if kind == "json":
            return bytes_json(column, schema) if schema else bytes_string(column)
        return column


STRING = Codec("string", "string")
JSON = Codec("string", "json")
BINARY = Codec("binary", "binary")
