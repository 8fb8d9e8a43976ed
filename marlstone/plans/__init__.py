"""Query trees: decoding, analysis and compilation to Spark columns."""
