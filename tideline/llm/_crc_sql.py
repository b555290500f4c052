"""CRC-32 of an ASCII string in DuckDB's SQL, which has no function for it."""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a SQL expression that gives an ASCII string of one character or more: eight shift steps
    for each of its bytes."""
    step = "(CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)"
    byte = f"list_reduce(list_prepend(xor(a, b), [CAST(z AS BIGINT) FOR z IN range(8)]), lambda c, z: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: {byte}), CAST(4294967295 AS BIGINT))"
