"""Tables, templates, workload files, and the metadata store."""
