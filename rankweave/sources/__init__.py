"""Tables in and out: schemas, the block store, catalog and page ingestion."""
