"""Point clouds on Parquet with PySpark: levels of detail, spatial packing, box and view queries."""
