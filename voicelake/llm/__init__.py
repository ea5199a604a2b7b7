"""Training-data operators: mixing, fingerprints, tokenising, chat, shards, quality, dedup, toxicity, WARC."""
