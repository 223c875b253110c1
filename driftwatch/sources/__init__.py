"""Sources: delimited snapshot reader, parquet tables, fixture views."""
