"""Record sources: generator, driver tables, bindings and Parquet I/O."""
