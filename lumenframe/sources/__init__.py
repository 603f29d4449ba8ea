"""Sources and sinks: delimited tables with a metadata header, parquet bundles, network, system and workspace files."""
