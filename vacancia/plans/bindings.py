"""The engine's tables over the star-schema test tables.

Each binding is a projection in SQL that Spark and a plain SQL engine read alike. Orders stand for
opportunities, line items for listings, suppliers for sources, events for source runs, labels for user states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HOSTS = {f"site{k}": (f"site{k}.example", f"www.site{k}.example") for k in range(0, 60, 2)}

BINDINGS = {
    "sources": """SELECT s_suppkey AS id, concat('site', CAST(s_suppkey AS STRING)) AS name, s_name AS display_name, s_acctbal > 1000 AS enabled,
  CASE WHEN s_suppkey % 7 = 0 THEN 'timeout' END AS last_error FROM {supplier}""",
    "listings": """SELECT ((l_orderkey * 10000 + l_suppkey) * 1000000 + l_partkey) * 10 + l_linenumber AS id, l_suppkey AS source_id, l_orderkey AS opportunity_id,
  concat('item', CAST(l_partkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS external_id,
  concat(CASE WHEN l_partkey % 7 = 0 THEN 'http' WHEN l_partkey % 11 = 0 THEN 'HTTPS' ELSE 'https' END, '://', CASE WHEN l_partkey % 5 = 0 THEN 'www.' ELSE '' END,
    'site', CAST(CASE WHEN l_partkey % 13 = 0 THEN l_suppkey + 1 ELSE l_suppkey END AS STRING), '.example', CASE WHEN l_partkey % 17 = 0 THEN ':443' ELSE '' END, '/jobs/', CAST(l_partkey AS STRING)) AS source_url,
  CAST(floor(l_extendedprice) AS BIGINT) AS quality_score, l_returnflag <> 'R' AS is_active, l_linestatus = 'F' AS normalized,
  CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 = 0 THEN 'missing' WHEN l_returnflag = 'R' AND l_linenumber % 3 = 1 THEN 'source_closed' END AS archive_reason,
  CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_shipdate END AS published_at, l_shipdate + INTERVAL '2' DAY AS first_seen_at, l_shipdate + INTERVAL '9' DAY AS last_seen_at,
  l_quantity AS version FROM {lineitem}""",
    "opportunities": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'freelance_project' ELSE 'employment' END AS kind, 'active' AS status,
  concat(substr(o_orderpriority, 3), ' engineer') AS title, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE c_name END AS company, concat('Order ', o_orderpriority, ' of ', c_mktsegment) AS description,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE c_mktsegment END AS location_text,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'remote' WHEN '2' THEN 'hybrid' WHEN '3' THEN 'onsite' WHEN '4' THEN 'remote' ELSE 'unknown' END AS work_mode,
  CASE o_orderkey % 6 WHEN 0 THEN 'full_time' WHEN 1 THEN 'Full-Time' WHEN 2 THEN 'full_time,contractor' WHEN 3 THEN 'Part Time' WHEN 4 THEN 'contract, intern' END AS employment_type,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_totalprice / 2 AS DECIMAL(14,2)) END AS salary_min, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(14,2)) END AS salary_max,
  CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'UAH' WHEN 2 THEN 'eur' END AS salary_currency, CASE o_orderkey % 5 WHEN 0 THEN 'month' WHEN 1 THEN 'Month' WHEN 2 THEN 'year' WHEN 3 THEN 'hour' END AS salary_period,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS published_at, CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate + INTERVAL '5' DAY END AS source_updated_at,
  o_orderdate + INTERVAL '1' DAY AS first_seen_at, o_orderdate + INTERVAL '8' DAY AS last_seen_at FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "evaluations": """SELECT o_orderkey AS opportunity_id, 'default' AS profile_id, CASE WHEN o_orderkey % 10 = 0 THEN 'v1' ELSE 'v2' END AS rules_version, CAST((o_orderkey * 37) % 101 AS INT) AS score,
  o_clerk_hash AS listing_content_hash FROM (SELECT *, CAST(o_custkey % 17 AS STRING) AS o_clerk_hash FROM {orders}) AS o WHERE o_orderkey % 11 <> 0""",
    "user_states": """SELECT doc_id AS opportunity_id, CASE WHEN toxic = 1 THEN 'hidden' WHEN quality = 1 THEN 'favorite' ELSE 'new' END AS disposition, doc_id * 7 % 1000 AS changed FROM {labels}""",
    "runs": """SELECT event_id AS id, user_id AS source_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'succeeded' END AS status, ts AS started_at,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE ts + INTERVAL '1' MINUTE END AS finished_at, CAST(floor(value) AS INT) AS discovered_count, CAST(floor(value / 10) AS INT) AS error_count,
  CAST(floor(value / 25) AS INT) AS detail_failure_count, event_id % 4 <> 0 AS limit_reached FROM {events}""",
    "deliveries": """SELECT event_id AS id, user_id AS opportunity_id, CASE event_type WHEN 'click' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'sent' WHEN 'view' THEN 'pending' ELSE 'skipped' END AS status,
  CAST(event_id % 9 AS INT) AS attempts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL '6' HOUR END AS next_attempt_at, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS message_text,
  'https://site0.example/' AS source_url, ts AS created_at FROM {events}""",
}
RAW = ("supplier", "lineitem", "orders", "customer", "labels", "events")
#: Half a price in cents as a plain SQL engine casts it: the double times 100, rounded half away from zero. Spark's cast rounds the shortest decimal instead (0.145 to 0.15).
SPARK_FORMS = {"CAST(o_totalprice / 2 AS DECIMAL(14,2))": "CAST(CAST(round(o_totalprice / 2 * 100D) AS BIGINT) * 0.01BD AS DECIMAL(14,2))"}
PRELUDE = ", ".join(f"{name} AS ({sql.format(**{t: t for t in RAW})})" for name, sql in BINDINGS.items())


class Tables:
    """Raw and bound tables of a directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, **instead: DataFrame):
        self.spark, self.dir, self._instead = spark, sf_dir, instead

    def over(self, **instead: DataFrame) -> Tables:
        """The same tables with others in place of some raw ones, such as streams."""
        return Tables(self.spark, self.dir, **instead)

    def raw(self, name: str) -> DataFrame:
        if name in self._instead:
            return self._instead[name]
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _bound(self, name: str) -> DataFrame:
        sql = BINDINGS[name]
        for plain, own in SPARK_FORMS.items():
            sql = sql.replace(plain, own)
        return self.spark.sql(sql, **{t: self.raw(t) for t in RAW if "{" + t + "}" in sql})

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BINDINGS:
            raise AttributeError(name)
        found = self._bound(name)
        setattr(self, name, found)
        return found
