"""Training-data operators: chat repair, sharding, dedup, scoring, tokens, audio.

Nothing else in the library imports this subpackage.
"""
