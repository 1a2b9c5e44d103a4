"""Operators over corpora: search, ranking, packing, reading, graphs, edits."""
