"""Training-data operators: scoring, de-duplication, packing and scans over a table of documents."""
