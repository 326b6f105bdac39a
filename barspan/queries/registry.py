"""All registered queries, by name."""

from barspan.queries import feature_queries, model_queries, protocol_queries, split_queries

QUERIES = dict(
    sorted((feature_queries.QUERIES | protocol_queries.QUERIES | model_queries.QUERIES | split_queries.QUERIES).items())
)
