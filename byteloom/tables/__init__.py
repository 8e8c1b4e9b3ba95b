"""Fixed and derived tables: encodings, names, single-byte code pages, language models."""
