"""All queries of the library: importing the modules registers them."""

from quern.plans import captures, ledgers, marks, records, stores, texts, walls, webtexts  # noqa: F401
from quern.plans.registry import QUERIES, SQL  # noqa: F401
