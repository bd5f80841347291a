"""Training-data operators (text, media, packing). Nothing outside this folder imports it."""
