"""Reading, ingesting and writing datasets."""
