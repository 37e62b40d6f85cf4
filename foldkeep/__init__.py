"""foldkeep: event-sourced keyed-collection analytics on PySpark.

An append-only log of typed write effects is the only source of truth; every
view (strings, sets, hashes, sorted sets, deltas, tiers) is a DataFrame that is
computed from it.
"""

__version__ = "0.1.0"
