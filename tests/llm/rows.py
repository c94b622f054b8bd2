"""Rows that every operator must take."""

ODD = [(900_001, None), (900_002, ""), (900_003, " \t\n "), (None, "a null id"), (900_004, "x" * 200_000)]
DOCS = "doc_id long, text string"
