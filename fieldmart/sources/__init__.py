"""Reading and writing: CSV ingest, lake layers, versioned tables, catalog, staging."""
