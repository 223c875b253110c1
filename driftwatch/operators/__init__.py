"""DataFrame -> DataFrame check operators (row, group, compare, statistics)."""
