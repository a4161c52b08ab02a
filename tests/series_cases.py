"""What several tests of the series operators share."""

from __future__ import annotations

SMALL = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
