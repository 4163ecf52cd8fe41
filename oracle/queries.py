"""All oracle SQL, keyed like the query registry."""

from oracle import blocks_sql, graph_sql, learn_sql, profile_sql, voice_sql
from oracle.views import with_views

_BODIES: dict[str, str] = {}
_BODIES.update(voice_sql.QUERIES)
_BODIES.update(blocks_sql.QUERIES)
_BODIES.update(graph_sql.QUERIES)
_BODIES.update(learn_sql.QUERIES)
_BODIES.update(profile_sql.QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: with_views(v) for k, v in _BODIES.items()}
