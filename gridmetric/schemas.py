"""The schema of chips, and the check for columns a relation must have."""

from pyspark.sql import DataFrame

CHIP = "chip_id LONG, split STRING, vv ARRAY<FLOAT>, vh ARRAY<FLOAT>, mask ARRAY<SHORT>"


def require_columns(df: DataFrame, columns) -> DataFrame:
    """df itself; ValueError naming the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
