"""Sources and sinks: CSV with explicit schemas, Parquet stages, MLlib model
persistence, metrics as JSON."""

from plotwise.sources.io import (  # noqa: F401
    read_csv, write_table, save_model, load_model, write_metrics_json,
    RAW_FLAT_SCHEMA, RAW_HOUSE_SCHEMA, APARTMENT_SCHEMA, GEO_SCHEMA, MODEL_SCHEMA,
)
