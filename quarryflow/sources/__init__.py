"""Sources and sinks: schemas, loaders, source-text scans, result sinks."""
