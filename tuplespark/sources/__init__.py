"""Sources and sinks: driver tables, the derived fixture view, JSON/TSV corpora."""
