"""Explore, clean, reshape, combine, sample and summarise tables of any size on Spark."""

from .operators.aggregate import count_by, group_summary, sum_by
from .operators.combine import ColumnMap, align, beside, concat_tables, default_mapping
from .operators.columns import (columns_of_type, create_column, display_text, drop_columns, head, marker_size,
                                promote_header, rename_columns, row_page, row_slice, select_by_type, tail)
from .operators.convert import apply_conversion, cast_columns, convert_columns, null_growth
from .operators.dedup import drop_duplicate_rows
from .operators.filters import Condition, apply_filter, compile_filter, where_sql
from .operators.infer import apply_suggestions, suggest_types
from .operators.joins import join_tables
from .operators.profile import (category_domain, datetime_profile, describe_table, distinct_count, fill_profile,
                                numeric_profile, value_counts)
from .operators.recipe import Recipe, apply_recipe
from .operators.reshape import melt_table, pivot_table
from .operators.sample import column_sample_size, representative_sample, sample_rows
from .operators.sort import sort_by, top_k
from .operators.windows import aggregate_over, cumulative_sum, first_over, rank_over, sum_over
from .plans.layout import ROW_ID, with_row_id
from .session import build_session
from .sources.sinks import write_csv, write_csv_like_source, write_parquet
from .sources.table import read_table, source_facts

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("operators", "plans", "sources", "session", "functions")]
