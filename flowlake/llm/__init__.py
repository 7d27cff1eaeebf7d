"""Training-data operators: quality, deduplication, mixing, search, tokens and safety scans."""
