"""All registered queries of the retrieval, graph and text operators with their SQL."""

from loomwork.plans import queries_graph, queries_search, queries_state, queries_text  # noqa: F401  they register themselves
from loomwork.plans.base import ORACLES, QUERIES  # noqa: F401
