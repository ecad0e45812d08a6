"""Operators on text collections: personal data, near-duplicates, clusters, leaked test items, mixtures, spam pages."""
