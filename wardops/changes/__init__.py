"""Bulk change rules: a batch of commands in, row changes out.

Every rule takes a DataFrame of commands and the current tables and returns a
``Changes`` value that holds only the touched rows.  ``Changes.apply`` merges
them into new table states; nothing is modified in place.
"""

from wardops.changes.core import Changes

__all__ = ["Changes"]
