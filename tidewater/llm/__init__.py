"""Training-data operators: thirteen corpus operators, their queries and their SQL oracles.

Nothing outside this subpackage imports it; `__spark_entry__` adds its queries when present.
"""
