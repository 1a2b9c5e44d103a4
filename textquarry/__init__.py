"""Queries, navigation and safe edits over large text and code corpora, as Spark plans."""
