"""A policy estate derived from the generated tables: hosts from `customer`, rules from `orders`.

The estate is resolved and placed once per session and folder and read back from the
checkpoint folder by every query, the way a snapshot is computed once and then asked.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paths
from ..operators.scratch import cut
from ..plans import snapshot
from ..sources.normalize import CATALOG, RULE, SEEN, Normalized, Parsed, normalize, resolved_rows, shaped, shared_entities

TOOL_RANK = "CASE source_tool WHEN 'firewall' THEN 0 WHEN 'microseg' THEN 1 ELSE 2 END"
LABEL = "generated"

ASSET_SQL = """
SELECT concat('host-', cast(c_custkey AS string)) AS name,
 concat('10.', cast(cast(floor(c_custkey/65536) AS bigint) % 256 AS string), '.',
        cast(cast(floor(c_custkey/256) AS bigint) % 256 AS string), '.',
        cast(c_custkey % 256 AS string)) AS ip,
 CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'dmz,internet-facing' WHEN 'BUILDING' THEN 'prod'
   WHEN 'FURNITURE' THEN 'dev' WHEN 'HOUSEHOLD' THEN 'customer-data,pci,prod' ELSE '' END AS tags_csv
FROM {customer}"""

# hosts facing the internet are also listed by the cloud tool, under another name
CLOUD_NAME_SQL = """
SELECT concat('vm-', cast(c_custkey AS string)) AS name,
 concat('10.', cast(cast(floor(c_custkey/65536) AS bigint) % 256 AS string), '.',
        cast(cast(floor(c_custkey/256) AS bigint) % 256 AS string), '.',
        cast(c_custkey % 256 AS string)) AS ip
FROM {customer} WHERE c_mktsegment = 'AUTOMOBILE'"""

RULE_SQL = """
SELECT o_orderkey AS rule_order, concat('R-', cast(o_orderkey AS string)) AS raw_ref,
 CASE o_orderkey % 3 WHEN 0 THEN 'firewall' WHEN 1 THEN 'microseg' ELSE 'cloud' END AS source_tool,
 CASE WHEN o_orderkey % 100 = 1 THEN '0.0.0.0/0'
  WHEN o_orderkey % 10 = 0 THEN concat('host-', cast((o_orderkey * 7919) % (SELECT count(*) FROM {customer}) AS string))
  ELSE concat('10.', cast(o_orderkey % 4 AS string), '.', cast(o_orderkey % 8 AS string), '.',
        cast(o_orderkey % 256 AS string), '/',
        CASE (o_orderkey % 7) WHEN 0 THEN '8' WHEN 1 THEN '12' WHEN 2 THEN '16' WHEN 3 THEN '20'
          WHEN 4 THEN '24' WHEN 5 THEN '28' ELSE '32' END) END AS src_token,
 concat('host-', cast(o_custkey AS string)) AS dst_token,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'tcp/3389' WHEN '2-HIGH' THEN 'tcp/443'
  WHEN '3-MEDIUM' THEN 'udp/443' WHEN '4-NOT SPECIFIED' THEN 'tcp/5432'
  ELSE CASE o_orderstatus WHEN 'P' THEN 'any' WHEN 'O' THEN 'quic' ELSE 'tcp/8000-8100' END END AS service,
 CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'deny' ELSE 'allow' END AS action
FROM {orders}"""


class Estate:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def derived(self, sql: str, *tables: str) -> DataFrame:
        return self.spark.sql(sql, **{t: self.table(t) for t in tables})

    @cached_property
    def rules(self) -> DataFrame:
        return self.derived(RULE_SQL, "orders", "customer")

    @cached_property
    def hosts(self) -> DataFrame:
        return self.derived(ASSET_SQL, "customer").withColumn(
            "tags", F.expr("CASE WHEN tags_csv = '' THEN CAST(array() AS array<string>) ELSE split(tags_csv, ',') END"))

    @cached_property
    def parsed(self) -> Parsed:
        cloud = self.derived(CLOUD_NAME_SQL, "customer")
        return Parsed(
            shaped(self.rules, RULE, tool_rank=TOOL_RANK, src="src_token", dst="dst_token", order="rule_order",
                   record_seq="rule_order"),
            shaped(self.hosts, CATALOG),
            shaped(cloud, SEEN, kind="'identity'", tool="'cloud'", tool_rank="2", tags="array('cloud')",
                   abstract="false", record_seq="-1"),
            resolved_rows(self.hosts, "firewall", ["name", "ip", "tags"]))

    @cached_property
    def entities(self) -> DataFrame:
        return cut(shared_entities(self.parsed))

    @cached_property
    def normalized(self) -> Normalized:
        """Records by themselves; those of `view` were resolved when they were placed."""
        if "view" in self.__dict__:
            return Normalized(self.view.records, self.entities, self.parsed.resolved)
        return Normalized(cut(normalize(self.parsed, by_tool=False).records), self.entities, self.parsed.resolved)

    @cached_property
    def view(self) -> snapshot.View:
        return snapshot.build_view(self.parsed, self.entities, materialize=True)

    @cached_property
    def internet_paths(self) -> DataFrame:
        return cut(paths.internet_paths(self.view.passing, self.view.nodes))

    @cached_property
    def findings(self) -> DataFrame:
        """Every finding, with its local key."""
        chained = snapshot.chains.path_findings(
            paths.describe(paths.cross_tool(self.internet_paths), self.view.nodes))
        return cut(snapshot.rule_findings(self.view.placed).unionByName(chained))


_OPEN: dict[tuple[str, str], Estate] = {}


def estate(spark: SparkSession, sf_dir: str) -> Estate:
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _OPEN:
        _OPEN[key] = Estate(spark, str(sf_dir))
    return _OPEN[key]
