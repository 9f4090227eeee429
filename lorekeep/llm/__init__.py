"""Training-data operators: deduplication, quality, tokens, search, licences, personal data, packing, mixing."""
