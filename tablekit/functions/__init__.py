"""Column helpers for the scalar functions whose meaning differs from Spark's built-in of the same name."""

from .lists import distinct_values, first_n, last_n, list_get, sorted_values, value_counts_map, where_values
from .numeric import is_finite, is_infinite, lenient_double, quantile_disc, safe_divide, safe_mod, xor
from .parse import boolean_from_text, datetime_from_text, excel_serial, number_from_text
from .temporal import (combine, date_part_ns, date_part_us, iso_weekday, offset_by, round_to, spark_pattern,
                       strftime, to_date_text, to_datetime_text, truncate)
from .text import (concat_str, extract, format_text, pad_end, pad_start, replace_first, slice_text, split_exact,
                   split_literal, zfill)

__all__ = [
    "boolean_from_text", "combine", "concat_str", "date_part_ns", "date_part_us", "datetime_from_text",
    "distinct_values", "excel_serial", "extract", "first_n", "format_text", "is_finite", "is_infinite",
    "iso_weekday", "last_n", "lenient_double", "list_get", "number_from_text", "offset_by", "pad_end", "pad_start",
    "quantile_disc", "replace_first", "round_to", "safe_divide", "safe_mod", "slice_text", "sorted_values",
    "spark_pattern", "split_exact", "split_literal", "strftime", "to_date_text", "to_datetime_text", "truncate",
    "value_counts_map", "where_values", "xor", "zfill",
]
