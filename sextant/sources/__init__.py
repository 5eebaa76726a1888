"""Sources and sinks: listings, containers, file formats, record adapters."""
