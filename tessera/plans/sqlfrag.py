"""DuckDB fragments shared by the oracle SQL (same semantics as the
Column helpers in tessera.functions)."""

# Python str.split() whitespace, as an RE2 class.
WS = (r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda s: s <> '')"


def word_count(x: str) -> str:
    return f"CAST(len({words(x)}) AS BIGINT)"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lit(s: str) -> str:
    """A string literal that may hold newlines (built with chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join(sql_str(p) for p in parts) if len(parts) > 1 else sql_str(s)
