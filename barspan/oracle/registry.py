"""All comparison SQL, by the name of its query. A split query has its plain namesake's."""

from barspan.oracle import features, linear, models, protocol
from barspan.queries.split_queries import PLAIN

PLAIN_SQL = features.SQL | protocol.SQL | models.SQL | linear.SQL
SQL = dict(sorted((PLAIN_SQL | {f"{n}_split": PLAIN_SQL[n] for n in PLAIN}).items()))
