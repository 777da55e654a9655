"""Operators for training-data pipelines: quality, mixing, languages, urls, duplicates, search, packing, archives, licences, whitening, tokens, resampling."""
