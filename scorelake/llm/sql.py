"""Pieces of the operators' SQL."""

_TABLE = "list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
#: A table expression of one row (t): the 256 values of CRC-32.
CRC = f"crc AS (SELECT {_TABLE} AS t)"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, where ``crc`` is joined."""
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"
