"""Training-data operators: scoring, filtering, joining, mixing and archiving text.

Nothing outside this subpackage imports it; remove the folder and the rest
of the library keeps working.
"""
