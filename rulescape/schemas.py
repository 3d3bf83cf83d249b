"""Column lists and read schemas of the tables the package exchanges."""

from __future__ import annotations

TAGS = "array<string>"

FIREWALL_EXPORT = f"""
  vendor string, export_type string, device string, generated string,
  objects map<string, struct<type: string, value: string, tags: {TAGS}>>,
  rules array<struct<rule_id: string, `order`: int, src: string, dst: string, service: string,
                     app: string, action: string, comment: string>>"""

MICROSEG_EXPORT = f"""
  vendor string, export_type string,
  labels map<string, struct<role: string, env: string, tags: {TAGS}>>,
  policies array<struct<policy_id: string, src_label: string, dst_label: string, port: int,
                        protocol: string, app: string, action: string, ruleset: string>>"""

CLOUD_EXPORT = f"""
  vendor string, export_type string,
  assets map<string, struct<cloud: string, type: string, internet_facing: boolean, ip: string, tags: {TAGS}>>,
  exposures array<struct<exposure_id: string, kind: string, src: string, dst: string, port: int,
                         protocol: string, app: string>>"""

RECORD = [
    "id", "source_tool", "raw_ref", "source", "source_kind", "destination", "destination_kind",
    "dest_tags", "service", "port", "port_end", "protocol", "l7_app", "l7_source", "action", "order",
    "source_ip", "dest_ip", "note", "src_net", "record_seq",
]

ENTITY = ["name", "kind", "tool", "tool_rank", "ip", "cidr", "tags", "identifiers", "abstract"]

RESOLVED = ["source_tool", "source_device", "object_name", "object_kind", "resolved", "is_dynamic"]

FINDING = [
    "local_key", "type", "title", "severity", "severity_band", "forced_critical", "signals",
    "involved", "raw_refs", "source_tools",
]
