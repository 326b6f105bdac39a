"""Queries over a panel whose limits force the splitting form of every operator.

Each returns what its plain namesake returns and is compared with the same SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barspan.plans.layout import Limits
from barspan.queries import feature_queries, protocol_queries
from barspan.queries.common import Query
from barspan.sources.bars import panel_from_events

TIGHT = Limits(series_rows=20, cross_rows=3, date_rows=60, chunk_rows=16, page_members=3)
#: i05 shows the page a member is on, so its pages stay as long as the plain form's.
LONG_PAGES = Limits(series_rows=20, cross_rows=3, date_rows=60, chunk_rows=16)


def split(query: Query, limits: Limits) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query.over(panel_from_events(spark, sf_dir, limits))

    return run


PLAIN = {
    n: q
    for queries in (feature_queries.QUERIES, protocol_queries.QUERIES)
    for n, q in queries.items()
    if n in ("d09_rolling", "d18_cross_zscores", "d25_regime_buckets", "d27_date_volatility", "i05_snapshots", "i06_snapshot_order", "i07_padded_batches")
}
QUERIES: dict[str, Query] = {
    f"{n}_split": split(q, LONG_PAGES if n == "i05_snapshots" else TIGHT) for n, q in PLAIN.items()
}
