"""Column functions of the text and metric semantics."""
