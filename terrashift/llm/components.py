"""Connected components with each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from terrashift.llm.common import materialize
from terrashift.operators import components


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node that it reaches."""
    return components.connected_components(edges, lambda df: materialize(df, "components"))
