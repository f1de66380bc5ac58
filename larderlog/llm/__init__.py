"""Training-data operators: sharding, near and exact duplicates, filters, token counts, language-model scores."""
