"""Sources: relations derived from tables, files and manifests."""
