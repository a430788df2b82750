"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _as_column(item: Column | str) -> Column:
    return item if isinstance(item, Column) else F.col(item)


def literal_pattern(text: str) -> Column:
    """``text`` as a regular expression that matches itself."""
    return F.lit("\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E")


def format_text(template: str, *parts: Column | str) -> Column:
    """Fill ``{}`` places; null when any part is null (``format_string`` would print ``null``)."""
    pieces = template.split("{}")
    if len(pieces) != len(parts) + 1:
        raise ValueError(f"template has {len(pieces) - 1} places for {len(parts)} values")
    out = [F.lit(pieces[0])]
    for part, piece in zip(parts, pieces[1:]):
        out += [_as_column(part).cast("string"), F.lit(piece)]
    return F.concat(*out)


def concat_str(*parts: Column | str, separator: str = "") -> Column:
    """Join as text; null when any part is null (``concat_ws`` would skip it)."""
    out = []
    for part in parts:
        if out:
            out.append(F.lit(separator))
        out.append(_as_column(part).cast("string"))
    return F.concat(*out)


def replace_first(col: Column | str, pattern: str, value: str, literal: bool = False) -> Column:
    """Replace only the first match; ``$1``-style group references work when not literal."""
    col = _as_column(col)
    regex = literal_pattern(pattern) if literal else F.lit(pattern)
    at = F.regexp_instr(col, regex)
    head = F.substring(col, F.lit(1), at - 1)
    found = F.regexp_substr(col, regex)
    tail = F.substring(col, at + F.char_length(found), F.char_length(col))
    changed = F.lit(value) if literal else F.regexp_replace(found, regex, F.lit(value))
    return F.when(at > 0, F.concat(head, changed, tail)).otherwise(col)


def split_literal(col: Column | str, by: str) -> Column:
    """Split on literal text (Spark's ``split`` takes a regular expression)."""
    return F.split(_as_column(col), literal_pattern(by))


def split_exact(col: Column | str, by: str, n: int) -> Column:
    """Struct ``field_0 .. field_n`` of the first ``n + 1`` pieces, null where missing."""
    pieces = split_literal(col, by)
    return F.struct(*[F.get(pieces, F.lit(i)).alias(f"field_{i}") for i in range(n + 1)])


def extract(col: Column | str, pattern: str, group: int = 1) -> Column:
    """Capture group of the first match, null without a match (``regexp_extract`` gives ``''``)."""
    col = _as_column(col)
    return F.when(F.regexp_like(col, F.lit(pattern)), F.regexp_extract(col, pattern, group))


def slice_text(col: Column | str, offset: int, length: int | None = None) -> Column:
    """Substring from a 0-based offset; a negative offset counts from the end."""
    col = _as_column(col)
    size = F.char_length(col)
    start = F.lit(offset) if offset >= 0 else F.greatest(size + offset, F.lit(0))
    # A negative offset before the beginning shortens the piece by the part that hangs over.
    kept = size if length is None else (F.lit(length) if offset >= 0
                                        else F.lit(length) + F.least(size + offset, F.lit(0)))
    return F.substring(col, start + 1, F.greatest(kept, F.lit(0)))


def pad_start(col: Column | str, length: int, fill: str = " ") -> Column:
    """Left-pad to ``length`` characters; never truncates."""
    col = _as_column(col)
    return F.lpad(col, F.greatest(F.lit(length), F.char_length(col)), F.lit(fill))


def pad_end(col: Column | str, length: int, fill: str = " ") -> Column:
    """Right-pad to ``length`` characters; never truncates."""
    col = _as_column(col)
    return F.rpad(col, F.greatest(F.lit(length), F.char_length(col)), F.lit(fill))


def zfill(col: Column | str, length: int) -> Column:
    """Pad with zeros after a leading sign; never truncates."""
    col = _as_column(col)
    signed = F.substring(col, 1, 1).isin("+", "-")
    body = F.when(signed, F.substring(col, F.lit(2), F.char_length(col))).otherwise(col)
    sign = F.when(signed, F.substring(col, 1, 1)).otherwise(F.lit(""))
    width = F.lit(length) - F.char_length(sign)
    return F.concat(sign, F.lpad(body, F.greatest(width, F.char_length(body)), F.lit("0")))
