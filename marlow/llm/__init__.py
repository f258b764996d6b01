"""Training-data operators: URL filter, language id, quality rules, chat
formatting, near-duplicates, sharding, licence scan, decontamination, mixing
and substring dedup.  Nothing else in the library imports this subpackage."""
