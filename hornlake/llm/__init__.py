"""Operators for preparing training text at scale: counting, identifying, de-duplicating, cleaning and mixing.

Nothing outside this folder imports it.  `queries` holds the registered queries and their SQL.
"""
