"""Training-data operators: fingerprints, tokenisation, sharding, filters, dedup, packing, scoring, formatting.

Nothing outside this subpackage imports it.  ``registry`` lists its queries and
their SQL; ``__spark_entry__`` adds them when the subpackage can be imported.
"""
