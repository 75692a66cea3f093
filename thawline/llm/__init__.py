"""Training-data operators: dedup, filtering, scoring, encoding and sharding of large text corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; ``queries`` binds them to the contract queries.
"""
