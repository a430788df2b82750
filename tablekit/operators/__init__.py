"""Table operators; every one takes and returns DataFrames (or builds a Column)."""
