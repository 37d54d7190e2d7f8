"""Training-data operators: search, media, quality, dedup, extraction, packing, licences, mixing, chat, lines."""
