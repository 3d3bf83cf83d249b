"""Licence notices by ordered signature rules.

A rule is a regular expression over the words of a text, joined by single spaces; it has a label, a
priority and the keywords without which it cannot match. The keywords found in a text open the
few rules worth trying. Where detections overlap, a higher priority wins, then the longer one; what
lies inside an accepted detection, or overlaps it, is suppressed.

Rules come from families: each family lists its names, versions and notices, and a template turns
them into patterns. A base rule is a plain phrase; its places are counted and always reported.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels, fixed by contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_SEPARATORS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float


_LICENSE = "licen[cs]e"
_UNDER = "(?:released |licensed |distributed |available |provided |published |redistributed |covered |made available )"
_VERSION = "(?:version |v ?)?"

#: Families: (label, names, versions with the labels they give, family keyword). A version is written as words.
FAMILIES = (
    ("gpl", ("gnu general public", "gnu gpl", "gpl"), {"1": "gpl-1", "2": "gpl-2", "3": "gpl-3"}, ("gnu", "gpl")),
    ("lgpl", ("gnu lesser general public", "gnu library general public", "gnu lgpl", "lgpl"),
     {"2": "lgpl-2", "2 1": "lgpl-2.1", "3": "lgpl-3"}, ("gnu", "lgpl")),
    ("agpl", ("gnu affero general public", "affero general public", "gnu agpl", "agpl"), {"1": "agpl-1", "3": "agpl-3"},
     ("affero", "agpl")),
    ("gfdl", ("gnu free documentation", "gnu fdl", "gfdl"), {"1 1": "gfdl-1.1", "1 2": "gfdl-1.2", "1 3": "gfdl-1.3"},
     ("gfdl", "documentation", "fdl")),
    ("apache", ("apache software", "apache"), {"1": "apache-1", "1 1": "apache-1.1", "2": "apache-2"}, ("apache",)),
    ("mpl", ("mozilla public", "mpl"), {"1": "mpl-1", "1 1": "mpl-1.1", "2": "mpl-2"}, ("mozilla", "mpl")),
    ("epl", ("eclipse public", "epl"), {"1": "epl-1", "2": "epl-2"}, ("eclipse", "epl")),
    ("eupl", ("european union public", "eupl"), {"1 1": "eupl-1.1", "1 2": "eupl-1.2"}, ("european", "eupl")),
    ("cddl", ("common development and distribution", "cddl"), {"1": "cddl-1", "1 1": "cddl-1.1"}, ("cddl", "development")),
    ("cpl", ("common public", "cpl"), {"1": "cpl-1"}, ("common", "cpl")),
    ("osl", ("open software", "osl"), {"1": "osl-1", "2": "osl-2", "2 1": "osl-2.1", "3": "osl-3"}, ("software", "osl")),
    ("afl", ("academic free", "afl"), {"2": "afl-2", "2 1": "afl-2.1", "3": "afl-3"}, ("academic", "afl")),
    ("artistic", ("perl artistic", "artistic"), {"1": "artistic-1", "2": "artistic-2"}, ("artistic",)),
    ("bsl", ("boost software", "bsl"), {"1": "bsl-1"}, ("boost", "bsl")),
    ("python", ("python software foundation", "psf"), {"2": "python-2"}, ("python", "psf")),
    ("zpl", ("zope public", "zpl"), {"2": "zpl-2", "2 1": "zpl-2.1"}, ("zope", "zpl")),
    ("ms-pl", ("microsoft public", "ms pl"), {}, ("microsoft", "ms")),
    ("ms-rl", ("microsoft reciprocal", "ms rl"), {}, ("microsoft", "ms")),
    ("mit", ("mit", "expat", "x11"), {}, ("mit", "expat", "x11")),
    ("isc", ("isc", "internet systems consortium"), {}, ("isc", "internet")),
    ("zlib", ("zlib libpng", "zlib"), {}, ("zlib",)),
    ("bsd-2", ("bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd"), {}, ("bsd", "freebsd")),
    ("bsd-3", ("bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd", "modified bsd", "revised bsd"), {}, ("bsd",)),
    ("bsd-4", ("bsd 4 clause", "4 clause bsd", "original bsd"), {}, ("bsd",)),
    ("bsd", ("bsd", "bsd style"), {}, ("bsd",)),
    ("unlicense", ("unlicense",), {}, ("unlicense",)),
    ("wtfpl", ("do what the fuck you want to public", "wtfpl"), {"2": "wtfpl-2"}, ("wtfpl", "fuck")),
    ("odbl", ("open database", "odbl"), {"1": "odbl-1"}, ("database", "odbl")),
    ("ofl", ("sil open font", "open font", "ofl"), {"1": "ofl-1", "1 1": "ofl-1.1"}, ("font", "ofl")),
    ("ecl", ("educational community", "ecl"), {"1": "ecl-1", "2": "ecl-2"}, ("educational", "ecl")),
    ("cecill", ("cecill",), {"1": "cecill-1", "2": "cecill-2", "2 1": "cecill-2.1"}, ("cecill",)),
    ("ipl", ("ibm public", "ipl"), {"1": "ipl-1"}, ("ibm", "ipl")),
    ("ncsa", ("university of illinois ncsa open source", "ncsa"), {}, ("ncsa",)),
    ("vim", ("vim",), {}, ("vim",)),
    ("php", ("php",), {"3": "php-3", "3 01": "php-3.01"}, ("php",)),
    ("ruby", ("ruby",), {}, ("ruby",)),
    ("openssl", ("openssl",), {}, ("openssl",)),
    ("postgresql", ("postgresql",), {}, ("postgresql",)),
)

#: Creative Commons: short form, and the words that stand for each element.
CC_ELEMENTS = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:atives|s)", "sa": "share ?alike"}
CC_KINDS = ("by", "by nc", "by nd", "by sa", "by nc nd", "by nc sa")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Notices that name no licence, or quote the text of one.
NOTICES = (
    Rule("mit-grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission",), 40, 0.95),
    Rule("isc-grant", "isc", "permission to use copy modify and or distribute this software for any purpose", ("permission",), 40, 0.9),
    Rule("bsd-grant", "bsd", "redistribution and use in source and binary forms with or without modification", ("redistribution",), 40, 0.9),
    Rule("bsd-endorse", "bsd-3", "neither the name of (?:(?!neither the name of ).)*?nor the names of its contributors may be used to endorse", ("neither",), 45, 0.9),
    Rule("gpl-grant", "gpl", "redistribute it and or modify it under the terms of the gnu general public license", ("gnu",), 42, 0.9),
    Rule("gpl-later", "gpl-later", "either version [123] of the license or at your option any later version", ("version",), 44, 0.9),
    Rule("zlib-grant", "zlib", "this software is provided as is without any express or implied warranty", ("warranty",), 35, 0.7),
    Rule("unlicense-grant", "unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",), 46, 0.95),
    Rule("cc0", "cc0", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", ("cc0", "zero"), 46, 0.9),
    Rule("public-domain", "public-domain", "(?:in|into|to) the public domain", ("domain",), 20, 0.6),
    Rule("all-rights", "proprietary", "all rights reserved", ("rights",), 10, 0.4),
    Rule("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", ("copyright",), 5, 0.3),
)


def _version(text: str) -> str:
    return text.replace(" ", " ?") + ("" if " " in text else "(?: 0)?")


def _joined(name: str, version: str) -> tuple[str, tuple[str, ...]]:
    """A version written in one word with an abbreviation, as in gplv3: what follows the name, and the words it gives."""
    if " " in name and not (name.startswith("gnu ") and name.count(" ") == 1):
        return "", ()
    v = "v?" if name.endswith("gpl") else "v"  # gpl3 is common, the other names with a bare digit may be anything
    last = name.split()[-1]
    heads = {version.split()[0], version.replace(" ", "")}
    return f"|{v}{_version(version)}", tuple(sorted(last + x + h for x in {"v", v.replace("v?", "")} for h in heads))


def _family_rules() -> Iterator[Rule]:
    """From each name: named licence, notice, and short form, each with every version and without one."""
    for label, names, versions, keywords in FAMILIES:
        for name in names:
            short = " " not in name and len(name) <= 5
            for version, exact in [*versions.items(), (None, label)]:
                joined, words = _joined(name, version) if version else ("", ())
                apart = f"(?: {_VERSION}{_version(version)})" if version else ""
                v = f"(?:{apart}{joined})"
                opens = keywords + words
                key = f"{name}-{version or 'any'}"
                bump = 5 if version else 0
                yield Rule(f"named-{key}", exact, f"(?:the )?{name} {_LICENSE}{apart}", keywords, 30 + bump, 0.8 + 0.01 * bump)
                yield Rule(f"notice-{key}", exact, f"{_UNDER}?under (?:the )?(?:terms of the )?(?:conditions of the )?{name}(?:(?: {_LICENSE})?{apart}{joined})",
                           opens, 50 + bump, 0.9 + 0.01 * bump)
                yield Rule(f"tag-{key}", exact, f"spdx license identifier {name}{v}", ("spdx",), 60 + bump, 0.95 + 0.01 * bump)
                if version and short:
                    yield Rule(f"short-{key}", exact, f"{name}{v}", opens, 25, 0.7)


def _creative_commons() -> Iterator[Rule]:
    for kind in CC_KINDS:
        spoken = " ".join(CC_ELEMENTS[e] for e in kind.split())
        label = "cc-" + kind.replace(" ", "-")
        for version in (*CC_VERSIONS, None):
            v, exact = (f" {_VERSION}{version.replace(' ', ' ?')}", f"{label}-{version.replace(' ', '.')}") if version else ("", label)
            yield Rule(f"cc-{kind}-{version}", exact, f"(?:licensed under )?(?:the )?cc {kind}{v}", ("cc",), 55 + 5 * bool(version) + len(kind), 0.85)
            yield Rule(f"creative-{kind}-{version}", exact, f"creative commons {spoken}{v}(?: international| unported| generic)?(?: {_LICENSE})?",
                       ("commons",), 55 + 5 * bool(version) + len(kind), 0.95)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first."""
    return tuple(sorted([*NOTICES, *_creative_commons(), *_family_rules()], key=lambda r: (-r.priority, r.name)))


@lru_cache(maxsize=1)
def _compiled():
    word = r"(?<![^ ])(?:{})(?![^ ])"
    made = [(r, re.compile(word.format(r.pattern))) for r in rules()]
    by_key: dict[str, list[int]] = {}
    for i, (r, _) in enumerate(made):
        for k in r.keywords:
            by_key.setdefault(k, []).append(i)
    base = [(label, re.compile(word.format(phrase)), phrase.split()[-2]) for phrase, label in BASE]
    return made, by_key, base, frozenset(by_key)


def words_of(text: str) -> str:
    """The words of a text, lower-cased in A-Z and joined by single spaces."""
    return _SEPARATORS.sub(" ", text.translate(_LOWER)).strip(" ")


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Disjoint detections: by priority, then length, then place.

    One that lies inside an accepted detection, or overlaps it, is suppressed.
    """
    kept: list[tuple[int, int, Rule]] = []
    spans: list[tuple[int, int]] = []  # accepted, in order of place
    for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].name)):
        at = bisect.bisect_left(spans, (start, end))
        if (at and spans[at - 1][1] > start) or (at < len(spans) and spans[at][0] < end):
            continue
        spans.insert(at, (start, end))
        kept.append((start, end, rule))
    return kept


def scan(text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, Rule]]]:
    """`(words, base places, detections)`: places as (first word, label), detections as word ranges."""
    made, by_key, base, keys = _compiled()
    flat = words_of(text or "")
    if not flat:
        return 0, [], []
    n = flat.count(" ") + 1
    opened = keys.intersection(flat.split(" "))
    hits = [(m.start(), label) for label, pattern, key in base if key in flat for m in pattern.finditer(flat)]
    tried = sorted({i for k in opened for i in by_key[k]})
    found = [(m.start(), m.end(), made[i][0]) for i in tried for m in made[i][1].finditer(flat)]
    # word numbers of the offsets met, in one pass over the text
    wanted = sorted({p for p, _ in hits} | {p for s, e, _ in found for p in (s, e)})
    number, last, seen = {}, 0, 0
    for p in wanted:
        seen += flat.count(" ", last, p)
        last = p
        number[p] = seen
    return (n, sorted((number[p], label) for p, label in hits),
            sorted(((number[s], number[e], r) for s, e, r in resolve(found)), key=lambda d: (d[0], d[1], d[2].name)))


_RESULT = ("struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,"
           "detections:array<struct<first:bigint,last:bigint,label:string,rule:string,confidence:double>>>")


def with_licenses(docs: DataFrame, name: str = "licenses") -> DataFrame:
    """Add `name`: what `scan` finds in `text`.

    A null or empty text has no words, no places (first and last null), no labels (empty text) and
    score 0. The score is the largest confidence among detections; a base place counts as 0.9.
    """
    @F.arrow_udf(_RESULT)
    def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                          ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                          ("detections", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()),
                                                             ("rule", pa.string()), ("confidence", pa.float64())])))])
        for part in parts:
            rows = []
            for text in part:
                n, places, found = scan(text.as_py())
                own = {label for _, label in places}
                rows.append({"n_words": n, "n_base": len(places), "first_word": places[0][0] if places else None,
                             "last_word": places[-1][0] if places else None, "base_labels": ",".join(sorted(own)),
                             "labels": ",".join(sorted(own | {r.label for _, _, r in found})),
                             "score": max([r.confidence for _, _, r in found] + [0.9] * bool(places) + [0.0]),
                             "detections": [{"first": s, "last": e, "label": r.label, "rule": r.name, "confidence": r.confidence}
                                            for s, e, r in found]})
            yield pa.array(rows, type=kind)

    return docs.withColumn(name, find.asNondeterministic()(F.col("text")))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`, with what its text says of licences; only `doc_id` and `text` are read."""
    out = with_licenses(docs.select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"licenses.{c}").alias(c) for c in
                                  ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])
