"""Sources and sinks: declared schemas, CSV ingest, the synthetic-table mapping, publishing."""
