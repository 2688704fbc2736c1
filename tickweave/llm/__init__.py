"""Operators for large text corpora: cleaning, joins on similarity, packing, search and learned scores."""
