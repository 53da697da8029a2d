"""Training-data operators (deduplication, search, language, secrets, packing, tokens, quality).

Nothing outside this subpackage imports it; `__spark_entry__.py` adds its queries when it is present.
"""
