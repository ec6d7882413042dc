"""Training-data operators: licences, dedup, extraction, tokens, quality, language, shards.

Nothing else in the library imports this package. Python functions of its modules travel to
the executors by value, so the package need not be installed there.
"""

from spanrules.session import ship_by_value

ship_by_value(__name__)
