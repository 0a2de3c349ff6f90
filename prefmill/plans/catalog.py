"""All registered queries."""

from prefmill.plans import (align_queries, encode_queries, eval_queries, loss_queries, media_queries, mix_queries,  # noqa: F401
                            render_queries, source_queries, stream_queries, subspace_queries)
from prefmill.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
