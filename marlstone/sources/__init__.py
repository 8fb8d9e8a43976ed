"""Sources: Parquet table binding, CSV bulk loads, generated rows and binary blocks."""
