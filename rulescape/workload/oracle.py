"""The same estate in plain SQL, by other means: integer address ranges and self-joins."""

from __future__ import annotations

from .estate import ASSET_SQL, CLOUD_NAME_SQL, RULE_SQL


def _plain(sql: str) -> str:
    return sql.format(customer="customer", orders="orders").strip()


_SENSITIVE = "({0} LIKE '%pci%' OR {0} LIKE '%customer-data%')"

CTES = {
    "td_asset": _plain(ASSET_SQL),
    "td_cloud": _plain(CLOUD_NAME_SQL),
    "td_rule": _plain(RULE_SQL),
    # addresses as integer ranges
    "net": """
SELECT *, cast(floor(ip / width) AS BIGINT) * width AS lo, cast(floor(ip / width) AS BIGINT) * width + width - 1 AS hi
FROM (SELECT rule_order, plen, ip, cast(pow(2, 32 - plen) AS BIGINT) AS width FROM (
  SELECT rule_order, cast(split_part(src_token, '/', 2) AS INTEGER) AS plen,
    cast(split_part(src_token, '.', 1) AS BIGINT) * 16777216 + cast(split_part(src_token, '.', 2) AS BIGINT) * 65536
    + cast(split_part(src_token, '.', 3) AS BIGINT) * 256
    + cast(split_part(split_part(src_token, '.', 4), '/', 1) AS BIGINT) AS ip
  FROM td_rule WHERE src_token LIKE '%/%'))""",
    "decoded": """
SELECT rule_order, CASE service WHEN 'any' THEN 'any' WHEN 'quic' THEN 'udp' ELSE split_part(service, '/', 1) END AS protocol,
  CASE service WHEN 'any' THEN NULL WHEN 'quic' THEN 443
    ELSE cast(split_part(split_part(service, '/', 2), '-', 1) AS INTEGER) END AS port,
  CASE WHEN service LIKE '%-%' THEN cast(split_part(service, '-', 2) AS INTEGER) END AS port_end,
  CASE service WHEN 'quic' THEN 'quic' WHEN 'udp/443' THEN 'quic' WHEN 'tcp/443' THEN 'tls' WHEN 'tcp/3389' THEN 'rdp'
    WHEN 'tcp/5432' THEN 'postgresql' END AS l7_app,
  CASE WHEN service = 'quic' THEN 'declared'
    WHEN service IN ('udp/443', 'tcp/443', 'tcp/3389', 'tcp/5432') THEN 'inferred' END AS l7_source
FROM td_rule""",
    "rec": f"""
SELECT r.rule_order AS seq, r.source_tool AS tool, r.raw_ref AS ref, r.action, r.service, s.protocol, s.port, s.port_end,
  s.l7_app, s.l7_source, n.plen, n.lo, n.hi, CASE WHEN n.plen IS NULL THEN 'identity' ELSE 'cidr' END AS source_kind,
  CASE WHEN n.plen IS NULL THEN r.src_token ELSE concat(cast(n.lo // 16777216 AS VARCHAR), '.',
    cast(n.lo // 65536 % 256 AS VARCHAR), '.', cast(n.lo // 256 % 256 AS VARCHAR), '.', cast(n.lo % 256 AS VARCHAR), '/',
    cast(n.plen AS VARCHAR)) END AS source,
  r.dst_token AS destination, d.tags_csv AS dest_tags, coalesce(a.tags_csv, '') AS src_tags,
  {_SENSITIVE.format('d.tags_csv')} AS sensitive
FROM td_rule r JOIN decoded s ON s.rule_order = r.rule_order LEFT JOIN net n ON n.rule_order = r.rule_order
LEFT JOIN td_asset d ON d.name = r.dst_token LEFT JOIN td_asset a ON a.name = r.src_token""",
    "factors": """
SELECT *, CAST(CASE WHEN plen IS NULL THEN 0.1 WHEN plen = 0 THEN 1.0 WHEN plen <= 8 THEN 0.9 WHEN plen <= 16 THEN 0.7
    WHEN plen <= 23 THEN 0.5 WHEN plen <= 27 THEN 0.3 ELSE 0.1 END AS DOUBLE) AS e,
  CAST(CASE WHEN protocol = 'any' THEN 1.0 WHEN port = 3389 THEN 1.0 WHEN port = 5432 THEN 0.9 WHEN port = 443 THEN 0.4
    ELSE 0.5 END AS DOUBLE) AS p,
  CAST(CASE dest_tags WHEN 'customer-data,pci,prod' THEN 0.9 WHEN 'prod' THEN 0.6 WHEN 'dev' THEN 0.2 ELSE 0.4 END AS DOUBLE) AS d,
  CASE WHEN source = '0.0.0.0/0' THEN 'internet' WHEN src_tags LIKE '%dmz%' THEN 'dmz' WHEN src_tags = 'dev' THEN 'dev'
    ELSE 'internal' END AS src_zone,
  CASE WHEN dest_tags LIKE '%dmz%' THEN 'dmz' WHEN dest_tags = 'dev' THEN 'dev' ELSE 'internal' END AS dst_zone
FROM rec""",
    "bounded": """
SELECT *, CAST(CASE WHEN dst_zone = 'internal' AND src_zone = 'internet' THEN 1.5
    WHEN dst_zone = 'internal' AND src_zone IN ('dmz', 'dev') THEN 1.25 ELSE 1.0 END AS DOUBLE) AS b FROM factors""",
    "scored": """
SELECT *, CAST(round_even(100 * least((d * (0.5::DOUBLE + 0.5::DOUBLE * p)) * (0.4::DOUBLE + 0.6::DOUBLE * e) * b, 1.0::DOUBLE), 0)
    AS INTEGER) AS sev FROM bounded""",
    "edge": """
SELECT source AS s, destination AS d, list_sort(list(DISTINCT tool)) AS tools, list_sort(list(DISTINCT service)) AS services,
  list_sort(list(DISTINCT l7_app) FILTER (WHERE l7_app IS NOT NULL)) AS apps, count(*) AS n_grants,
  arg_min(tool, [tool, ref]) AS rep_tool, arg_min(ref, [tool, ref]) AS rep_ref, arg_min(service, [tool, ref]) AS rep_service
FROM rec WHERE action = 'allow' GROUP BY 1, 2""",
    # names observed per tool; a cloud name joins its host when both were observed
    "observed": """
SELECT DISTINCT tool, name FROM (
  SELECT tool, source AS name FROM rec UNION ALL SELECT tool, destination FROM rec UNION ALL SELECT 'cloud', name FROM td_cloud)""",
    "named": """
SELECT o.name, count(*) AS n_tools, list_sort(list(o.tool)) AS tools, coalesce(any_value(a.ip), any_value(c.ip)) AS ip,
  coalesce(any_value(a.tags_csv), CASE WHEN any_value(c.name) IS NOT NULL THEN 'cloud' END, '') AS tags_csv
FROM observed o LEFT JOIN td_asset a ON a.name = o.name LEFT JOIN td_cloud c ON c.name = o.name GROUP BY o.name""",
    "aliased": """
SELECT n.*, CASE WHEN ip IS NULL THEN name ELSE first_value(name) OVER (PARTITION BY ip, ip IS NULL ORDER BY n_tools DESC, name) END
  AS asset_key FROM named n WHERE ip IS NOT NULL
UNION ALL SELECT n.*, name AS asset_key FROM named n WHERE ip IS NULL""",
    "node": f"""
SELECT asset_key AS node, CASE WHEN asset_key LIKE '%/%' THEN 'abstract' ELSE 'concrete' END AS kind,
  list_sort(list_distinct(flatten(list(CASE WHEN tags_csv = '' THEN [] ELSE string_split(tags_csv, ',') END)))) AS tags,
  list_sort(list_distinct(flatten(list(tools)))) AS tools,
  CASE WHEN asset_key LIKE '%/%' THEN asset_key ELSE concat(any_value(ip), '/32') END AS address,
  bool_or({_SENSITIVE.format('tags_csv')}) AS sensitive, bool_or(tags_csv LIKE '%dmz%') AS dmz, bool_or(tags_csv = 'dev') AS dev
FROM aliased GROUP BY asset_key""",
    "walk": """
SELECT s AS start, d AS last, [s, d] AS path, tools AS tools, 1 AS hops, [rep_ref] AS refs, rep_service AS last_service
  FROM edge WHERE s = '0.0.0.0/0'
UNION ALL
SELECT w.start, e.d, list_append(w.path, e.d), list_concat(w.tools, e.tools), w.hops + 1, list_append(w.refs, e.rep_ref), e.rep_service
  FROM walk w JOIN edge e ON e.s = w.last WHERE w.hops < 8 AND NOT list_contains(w.path, e.d) AND w.last NOT LIKE '%/%'""",
}


def sql(final: str, **extra: str) -> str:
    """`final` over the estate's common table expressions, plus the ones given."""
    ctes = {**CTES, **extra}
    needed: list[str] = []

    def need(text: str) -> None:
        import re
        for name in ctes:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.append(name)
                need(ctes[name])

    need(final)
    if not needed:
        return final.strip()
    body = ",\n".join(f"{n} AS ({ctes[n].strip()})" for n in ctes if n in needed)
    return f"WITH RECURSIVE {body}\n{final.strip()}"
