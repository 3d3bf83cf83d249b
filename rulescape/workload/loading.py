"""Registered queries: exports of several documents per tool, and a mapped source, to canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..sources import exports, profile
from .core import csv, query
from .estate import estate

# what each service text decodes to: text, protocol, port, port_end, service, l7_app, l7_source
_SERVICES = [
    ("tcp/443", "tcp", 443, None, "tcp/443", "tls", "inferred"), ("udp/53-60", "udp", 53, 60, "udp/53-60", "dns", "inferred"),
    ("weird/12", "tcp", 12, None, "weird/12", None, None), ("tcp/abc", "tcp", None, None, "tcp/abc", None, None),
    (" SSH ", "tcp", 22, None, "ssh", "ssh", "declared"), ("any", "any", None, None, "any", None, None),
    ("tcp/1-x", "tcp", None, None, "tcp/1-x", None, None), ("TCP/80", "tcp", 80, None, "TCP/80", "http", "inferred"),
    ("nonsense", "tcp", None, None, "nonsense", None, None),
]


def _literal(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


_TEXTS = "CASE {0} " + " ".join(f"WHEN {i} THEN '{row[0]}'" for i, row in enumerate(_SERVICES)) + " END"
_DECODED = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(map(_literal, row[1:]))})" for i, row in enumerate(_SERVICES)) + (
    ") AS v(k, protocol, port, port_end, service, l7_app, l7_source)")
_TAGS = "CASE {0} % 3 WHEN 0 THEN array('pci', 'prod') WHEN 1 THEN array('dev') ELSE array() END"
_TAGS_CSV = "CASE {0} % 3 WHEN 0 THEN 'pci,prod' WHEN 1 THEN 'dev' ELSE '' END"


def _export(spark, sf_dir, sql: str, schema: str, *tables: str):
    """Rows of derived documents with exactly the columns and types of an export."""
    made = estate(spark, sf_dir).derived(sql, *tables)
    want = spark.createDataFrame([], schema).schema
    return made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])


def _flat(records, *more):
    return records.select("raw_ref", "source", "source_kind", "source_ip", "destination", csv("dest_tags"), "dest_ip", "protocol", "port", "port_end",
                          "service", "l7_app", "l7_source", "action", F.col("order").cast("bigint").alias("rule_order"), *more)


# ---- firewall: a document per 300 orders -----------------------------------------

_FIREWALL = f"""
SELECT 'v' AS vendor, 'rules' AS export_type, concat('fw-', cast(o_orderkey div 300 AS string)) AS device, '' AS generated,
  map_from_entries(array_distinct(collect_list(struct(concat('obj-', cast(o_custkey AS string)), struct(
    CASE WHEN o_custkey % 2 = 0 THEN 'host' ELSE 'network' END,
    concat('10.7.', cast(o_custkey % 256 AS string), CASE WHEN o_custkey % 2 = 0 THEN '.5' ELSE '.0/24' END), {_TAGS.format('o_custkey')}))))) AS objects,
  array_sort(collect_list(struct(concat('FW-', lpad(cast(o_orderkey AS string), 10, '0')), cast(o_orderkey % 50 AS int),
    CASE WHEN o_orderkey % 4 = 0 THEN concat('10.', cast(o_orderkey % 200 AS string), '.7.9/16') ELSE concat('src-', cast(o_orderkey % 90 AS string)) END,
    concat('obj-', cast(o_custkey AS string)), {_TEXTS.format(f'o_orderkey % {len(_SERVICES)}')}, NULL,
    CASE WHEN o_orderkey % 5 = 0 THEN 'deny' ELSE 'allow' END, 'note'))) AS rules
FROM {{orders}} GROUP BY o_orderkey div 300"""


def _firewall(spark, sf_dir):
    return _export(spark, sf_dir, _FIREWALL, schemas.FIREWALL_EXPORT, "orders")


@query(f"""SELECT concat('FW-', lpad(cast(o_orderkey AS VARCHAR), 10, '0')) AS raw_ref,
            CASE WHEN o_orderkey % 4 = 0 THEN concat('10.', o_orderkey % 200, '.0.0/16') ELSE concat('src-', o_orderkey % 90) END AS source,
            CASE WHEN o_orderkey % 4 = 0 THEN 'cidr' ELSE 'identity' END AS source_kind, NULL::VARCHAR AS source_ip,
            concat('obj-', o_custkey) AS destination, {_TAGS_CSV.format('o_custkey')} AS dest_tags,
            CASE WHEN o_custkey % 2 = 0 THEN concat('10.7.', o_custkey % 256, '.5') END AS dest_ip, protocol, port, port_end, service, l7_app, l7_source,
            CASE WHEN o_orderkey % 5 = 0 THEN 'deny' ELSE 'allow' END AS action, o_orderkey % 50 AS rule_order
          FROM orders JOIN decoded_text ON k = o_orderkey % {len(_SERVICES)}""", decoded_text=_DECODED)
def load_firewall(spark, sf_dir):
    return _flat(exports.normalize_firewall(_firewall(spark, sf_dir)).records)


@query(f"""SELECT DISTINCT concat('fw-', o_orderkey // 300) AS source_device, concat('obj-', o_custkey) AS object_name, 'address' AS object_kind,
            concat('10.7.', o_custkey % 256, CASE WHEN o_custkey % 2 = 0 THEN '.5' ELSE '.0/24' END) AS value, {_TAGS_CSV.format('o_custkey')} AS tags
          FROM orders""")
def load_resolved(spark, sf_dir):
    out = exports.normalize_firewall(_firewall(spark, sf_dir)).resolved
    return out.select("source_device", "object_name", "object_kind", F.get_json_object("resolved", "$.value").alias("value"),
                      F.array_join(F.from_json(F.get_json_object("resolved", "$.tags"), "array<string>"), ",").alias("tags"))


# ---- microsegmentation: a document per 40 customers ------------------------------------

_MICROSEG = f"""
SELECT 'v' AS vendor, cast(c_custkey div 40 AS string) AS export_type,
  map_from_entries(collect_list(struct(concat('seg-', cast(c_custkey AS string)), struct(
    CASE WHEN c_custkey % 5 = 0 THEN 'segment' ELSE 'app' END, 'prod', {_TAGS.format('c_custkey')})))) AS labels,
  array_sort(collect_list(struct(concat('MS-', lpad(cast(c_custkey AS string), 10, '0')), concat('src-', cast(c_custkey % 11 AS string)),
    concat('seg-', cast(c_custkey AS string)), cast(c_custkey % 1000 AS int),
    CASE c_custkey % 5 WHEN 0 THEN 'tcp' WHEN 1 THEN 'UDP' WHEN 2 THEN 'bogus' WHEN 3 THEN NULL ELSE 'any' END,
    CASE WHEN c_custkey % 6 = 0 THEN 'http3' END, CASE WHEN c_nationkey < 5 THEN 'deny' ELSE 'allow' END, 'set'))) AS policies
FROM {{customer}} GROUP BY c_custkey div 40"""

_MS = """
SELECT *, CASE c_custkey % 5 WHEN 1 THEN 'udp' WHEN 4 THEN 'any' ELSE 'tcp' END AS own, c_custkey % 1000 AS prt,
  c_custkey % 6 = 0 AS named, row_number() OVER (PARTITION BY c_custkey // 40 ORDER BY c_custkey) * 10 AS nth FROM customer"""


@query(f"""SELECT concat('MS-', lpad(cast(c_custkey AS VARCHAR), 10, '0')) AS raw_ref, concat('src-', c_custkey % 11) AS source, 'identity' AS source_kind,
            NULL::VARCHAR AS source_ip, concat('seg-', c_custkey) AS destination, {_TAGS_CSV.format('c_custkey')} AS dest_tags, NULL::VARCHAR AS dest_ip,
            CASE WHEN named AND c_custkey % 5 = 3 THEN 'udp' ELSE own END AS protocol, prt AS port, NULL::INTEGER AS port_end,
            CASE WHEN named THEN 'http3' ELSE concat(own, '/', prt) END AS service, CASE WHEN named THEN 'http3' ELSE l7 END AS l7_app,
            CASE WHEN named THEN 'declared' WHEN l7 IS NOT NULL THEN 'inferred' END AS l7_source,
            CASE WHEN c_nationkey < 5 THEN 'deny' ELSE 'allow' END AS action, nth AS rule_order
          FROM (SELECT *, CASE concat(own, '/', prt) WHEN 'tcp/22' THEN 'ssh' WHEN 'tcp/53' THEN 'dns' WHEN 'tcp/80' THEN 'http' WHEN 'tcp/389' THEN 'ldap'
              WHEN 'tcp/443' THEN 'tls' WHEN 'tcp/445' THEN 'smb' WHEN 'tcp/636' THEN 'ldaps' WHEN 'udp/53' THEN 'dns' WHEN 'udp/80' THEN 'http3-discovery'
              WHEN 'udp/123' THEN 'ntp' WHEN 'udp/443' THEN 'quic' WHEN 'udp/514' THEN 'syslog' WHEN 'udp/853' THEN 'dns-over-quic' END AS l7 FROM ms)""", ms=_MS)
def load_microseg(spark, sf_dir):
    return _flat(exports.normalize_microseg(_export(spark, sf_dir, _MICROSEG, schemas.MICROSEG_EXPORT, "customer")).records)


# ---- cloud: a document per 25 suppliers ----------------------------------------------

_CLOUD = f"""
SELECT 'v' AS vendor, cast(s_suppkey div 25 AS string) AS export_type,
  map_from_entries(collect_list(struct(concat('vm-', cast(s_suppkey AS string)), struct('aws', 'vm', s_suppkey % 2 = 0,
    concat('10.8.0.', cast(s_suppkey % 256 AS string)), {_TAGS.format('s_suppkey')})))) AS assets,
  array_sort(collect_list(struct(concat('CL-', lpad(cast(s_suppkey AS string), 10, '0')),
    CASE WHEN s_suppkey % 2 = 0 THEN 'internet_ingress' ELSE 'lateral' END, concat('peer-', cast(s_suppkey % 7 AS string)),
    concat('vm-', cast(s_suppkey AS string)), 443, 'tcp', NULL))) AS exposures
FROM {{supplier}} GROUP BY s_suppkey div 25"""


def _cloud(spark, sf_dir):
    return exports.normalize_cloud(_export(spark, sf_dir, _CLOUD, schemas.CLOUD_EXPORT, "supplier"))


@query(f"""SELECT concat('CL-', lpad(cast(s_suppkey AS VARCHAR), 10, '0')) AS raw_ref,
            CASE WHEN s_suppkey % 2 = 0 THEN '0.0.0.0/0' ELSE concat('peer-', s_suppkey % 7) END AS source,
            CASE WHEN s_suppkey % 2 = 0 THEN 'cidr' ELSE 'identity' END AS source_kind, NULL::VARCHAR AS source_ip, concat('vm-', s_suppkey) AS destination,
            {_TAGS_CSV.format('s_suppkey')} AS dest_tags, concat('10.8.0.', s_suppkey % 256) AS dest_ip, 'tcp' AS protocol, 443 AS port,
            NULL::INTEGER AS port_end, 'tcp/443' AS service, 'tls' AS l7_app, 'inferred' AS l7_source, 'allow' AS action, NULL::BIGINT AS rule_order
          FROM supplier""")
def load_cloud(spark, sf_dir):
    return _flat(_cloud(spark, sf_dir).records)


@query(f"""SELECT concat('vm-', s_suppkey) AS name, 'identity' AS kind, concat('10.8.0.', s_suppkey % 256) AS ip, NULL::VARCHAR AS cidr,
            {_TAGS_CSV.format('s_suppkey')} AS tags, CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END AS internet_facing, false AS abstract FROM supplier
          UNION ALL SELECT DISTINCT concat('peer-', s_suppkey % 7), 'identity', NULL, NULL, '', NULL, false FROM supplier WHERE s_suppkey % 2 = 1
          UNION ALL SELECT '0.0.0.0/0', 'cidr', NULL, '0.0.0.0/0', '', NULL, true""")
def load_entities(spark, sf_dir):
    return _cloud(spark, sf_dir).entities.select("name", "kind", "ip", "cidr", csv("tags"),
                                                 F.try_element_at("identifiers", F.lit("internet_facing")).alias("internet_facing"), "abstract")


# ---- a mapped source: a document per 60 parts -------------------------------------------

_MAPPED = f"""
SELECT parse_json(to_json(named_struct(
  'hosts', map_from_entries(collect_list(struct(concat('box-', cast(p_partkey AS string)), named_struct(
    'value', concat('10.6.0.', cast(p_partkey % 256 AS string)), 'type', 'host', 'tags', {_TAGS.format('p_partkey')})))),
  'rulebase', array_sort(collect_list(named_struct('id', concat('PR-', lpad(cast(p_partkey AS string), 10, '0')), 'from', '10.1.2.3/8',
    'to', concat('box-', cast(p_partkey AS string)), 'svc', {_TEXTS.format(f'p_partkey % {len(_SERVICES)}')}, 'act', CASE p_size % 3 WHEN 0 THEN 'deny'
      WHEN 1 THEN 'allow' ELSE 'permit' END)))))) AS doc
FROM {{part}} GROUP BY p_partkey div 60"""
_PROFILE = profile.SourceProfile("vendorx", "rulebase", profile.FieldMap("from", "to", action="act", service="svc", ref="id"), objects_path="hosts")


def _mapped(spark, sf_dir):
    return estate(spark, sf_dir).derived(_MAPPED, "part")


@query(f"""SELECT concat('PR-', lpad(cast(p_partkey AS VARCHAR), 10, '0')) AS raw_ref, '10.0.0.0/8' AS source, 'cidr' AS source_kind, NULL::VARCHAR AS source_ip,
            concat('box-', p_partkey) AS destination, {_TAGS_CSV.format('p_partkey')} AS dest_tags, NULL::VARCHAR AS dest_ip, protocol, port, port_end, service,
            l7_app, l7_source, CASE WHEN p_size % 3 = 0 THEN 'deny' ELSE 'allow' END AS action,
            row_number() OVER (PARTITION BY p_partkey // 60 ORDER BY p_partkey) * 10 AS rule_order
          FROM part JOIN decoded_text ON k = p_partkey % {len(_SERVICES)}""", decoded_text=_DECODED)
def load_profile(spark, sf_dir):
    return _flat(profile.apply_profile(_mapped(spark, sf_dir), _PROFILE).records)


@query("""SELECT count(*) > 0 AS valid, count(*) AS records, count(*) + 1 AS entities FROM part""")
def profile_validation(spark, sf_dir):
    return profile.validate_profile(_mapped(spark, sf_dir), _PROFILE)[0]
