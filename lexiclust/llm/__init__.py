"""Training-data operators: language, quality, near duplicates, leaks, packing,
extraction, URL filters, chat formatting, neighbours and token counts."""
