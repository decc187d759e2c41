"""Training-data operators: dedup, decontamination, language ID, tokenising, sharding.

Nothing outside this subpackage imports it; the rest of the library works
without the folder.
"""
