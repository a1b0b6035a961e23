"""All queries on the reference's operators, by name."""

from __future__ import annotations

import re

from pricelode.plans import q_blocks, q_diff, q_evidence, q_gates, q_geometry, q_index, q_labels, q_log, q_pricing, q_reads, q_review, q_search, q_sources, q_state, q_temporal, q_text  # noqa: F401
from pricelode.plans.base import QUERIES, SQL, Query
from pricelode.sources.observations import OBS_SQL


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL of each query, with the projections it uses put in front."""

    def whole(text: str) -> str:
        text = text.strip()
        if not re.search(r"\bobs\b", text):
            return text
        rest = re.match(r"with\s+(recursive\s+)?", text)
        if rest:
            return f"with {rest[1] or ''}obs as materialized ({OBS_SQL}), {text[rest.end():]}"
        return f"with obs as materialized ({OBS_SQL}) {text}"

    return {name: whole(text) for name, text in SQL.items()}
