"""Sources and sinks: file listings, decoders, cube stores and catalogues."""
