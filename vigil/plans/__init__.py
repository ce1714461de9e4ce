"""Named queries (one per operator family) and their oracle SQL."""

_LOADED = False


def load_all() -> None:
    """Imports every query module so their registrations run once."""
    global _LOADED
    if _LOADED:
        return
    from vigil.plans import (access_log_queries, budget_queries, cache_queries, chat_queries,  # noqa: F401
                             cost_queries,
                             govern_queries, limit_queries, pii_queries, policy_queries, report_queries, sink_queries,
                             stream_queries)
    _LOADED = True
