"""The published demo estate (fixed values) as three export documents."""

import json

OBJECTS = {
    "app-segment": ("network", "10.30.0.0/16", ["prod"]),
    "app-server-07": ("host", "10.30.7.7", ["prod"]),
    "app-server-08": ("host", "10.30.7.8", ["prod"]),
    "app-server-09": ("host", "10.30.7.9", ["prod"]),
    "db-prod-01": ("host", "10.50.0.10", ["pci", "customer-data", "prod"]),
    "dev-box-01": ("host", "10.31.0.10", ["dev"]),
    "internal-app": ("network", "10.40.0.0/16", ["prod", "internal-app"]),
}
RULES = [  # number, source, destination, service, action
    (1, "0.0.0.0/0", "10.0.0.0/8", "any", "allow"),
    (2, "0.0.0.0/0", "db-prod-01", "tcp/3389", "allow"),
    (10, "10.20.5.0/24", "app-segment", "tcp/443", "allow"),
    (11, "10.0.0.0/8", "app-segment", "tcp/443", "allow"),
    (20, "10.0.0.0/8", "app-server-07", "tcp/443", "allow"),
    (21, "10.20.5.7/32", "app-server-07", "tcp/443", "deny"),
    (30, "internal-app", "db-prod-01", "tcp/5432", "allow"),
    (46, "172.16.0.0/12", "app-server-08", "tcp/3389", "allow"),
    (50, "10.0.0.0/8", "app-server-09", "tcp/22", "allow"),
    (60, "10.30.5.0/24", "app-server-08", "tcp/443", "allow"),
    (61, "10.30.0.0/16", "app-server-08", "tcp/443", "allow"),
    (70, "10.30.0.0/24", "app-server-09", "tcp/443", "allow"),
    (71, "10.31.0.0/24", "dev-box-01", "tcp/22", "allow"),
    (72, "10.10.0.0/24", "app-server-08", "tcp/9100", "allow"),
    (80, "0.0.0.0/0", "app-server-09", "udp/443", "allow"),
    (82, "10.0.0.0/8", "app-server-08", "quic", "allow"),
]
LABELS = {
    "app-server-07": ("app", "prod", ["prod"]),
    "app-server-08": ("app", "prod", ["prod"]),
    "app-tier": ("app", "prod", ["prod"]),
    "artifact-store": ("storage", "dev", ["dev"]),
    "ci-runner": ("ci", "dev", ["dev"]),
    "internal-app": ("segment", "prod", ["prod", "internal-app"]),
    "monitoring": ("monitoring", "prod", ["prod"]),
    "web-tier": ("web", "prod", ["prod"]),
}
POLICIES = [  # number, source, destination, port, application
    (1, "app-server-07", "internal-app", 8443, None),
    (10, "web-tier", "app-tier", 8443, None),
    (11, "monitoring", "app-server-07", 9100, None),
    (12, "ci-runner", "artifact-store", 443, None),
    (20, "web-tier", "app-tier", None, "quic"),
]
ASSETS = {
    "app-server-08": ("ec2", False, "10.30.7.8", ["prod"]),
    "appsrv-07": ("ec2", False, "10.30.7.7", ["prod"]),
    "lb-public-01": ("load_balancer", True, "52.20.10.10", ["dmz", "internet-facing", "prod", "cloud"]),
    "lb-public-02": ("load_balancer", True, "52.20.10.11", ["dmz", "internet-facing", "prod", "cloud"]),
    "rds-prod-customers": ("rds", False, "10.50.0.20", ["pci", "customer-data", "prod", "cloud"]),
}
EXPOSURES = [  # number, source (None: internet), destination, port, protocol
    (1, None, "lb-public-01", 443, "tcp"),
    (2, "lb-public-01", "appsrv-07", 8443, "tcp"),
    (10, None, "lb-public-02", 443, "tcp"),
    (11, "lb-public-02", "app-server-08", 443, "tcp"),
    (20, None, "lb-public-01", 443, "udp"),
    (21, "lb-public-01", "appsrv-07", 443, "udp"),
]


def documents():
    firewall = {
        "vendor": "v", "device": "afa-edge-fw-01",
        "objects": {n: {"type": t, "value": v, "tags": g} for n, (t, v, g) in OBJECTS.items()},
        "rules": [{"rule_id": f"ALGO-{n:03d}", "order": n, "src": s, "dst": d, "service": svc, "action": a,
                   "comment": f"rule {n}"} for n, s, d, svc, a in RULES],
    }
    microseg = {
        "vendor": "v", "labels": {n: {"role": r, "env": e, "tags": g} for n, (r, e, g) in LABELS.items()},
        "policies": [{"policy_id": f"GC-{n:03d}", "src_label": s, "dst_label": d, "action": "allow", "ruleset": "r",
                      **({"app": a} if a else {"port": p, "protocol": "tcp"})} for n, s, d, p, a in POLICIES],
    }
    cloud = {
        "vendor": "v",
        "assets": {n: {"cloud": "aws", "type": t, "internet_facing": i, "ip": ip, "tags": g}
                   for n, (t, i, ip, g) in ASSETS.items()},
        "exposures": [{"exposure_id": f"WIZ-{n:03d}", "kind": "lateral" if s else "internet_ingress", "dst": d,
                       "port": p, "protocol": pr, **({"src": s} if s else {})} for n, s, d, p, pr in EXPOSURES],
    }
    return {"firewall": firewall, "microseg": microseg, "cloud": cloud}


def write(folder):
    paths = {}
    for name, doc in documents().items():
        paths[name] = str(folder / f"{name}.json")
        (folder / f"{name}.json").write_text(json.dumps(doc))
    return paths
