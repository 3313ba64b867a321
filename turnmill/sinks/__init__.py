"""Writers for corpora, versions and append-only tables."""
