"""Training-data operators: quality, mixing, licences, deduplication, tokens, language, WARC and toxicity."""
