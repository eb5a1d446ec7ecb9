"""Entity tables: derivation from other tables, and validated ingest."""
