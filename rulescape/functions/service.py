"""Service text, port and application columns decoded to L4 and L7 facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lookups as L

# the same as map keys and values of one text
_TRANSPORT_OF = {app: L.transport_text(*pair) for app, pair in L.APP_TRANSPORT.items()}
_APP_OF = {L.transport_text(*pair): app for pair, app in L.APP_BY_TRANSPORT.items()}

SERVICE_COLUMNS = ["protocol", "port", "port_end", "service", "l7_app", "l7_source"]


def _trimmed(text: str) -> str:
    return f"trim(BOTH ' \\t\\n\\r\\u000b\\u000c' FROM {text})"


def _known_protocol(token: str) -> str:
    """Lower-cased protocol, `tcp` when it is not one we know."""
    low = f"lower({_trimmed(token)})"
    return f"CASE WHEN {low} IN ({L.listing(L.PROTOCOLS)}) THEN {low} ELSE 'tcp' END"


def with_service(df: DataFrame, service: str | None = None, port: str | None = None,
                 protocol: str | None = None, app: str | None = None) -> DataFrame:
    """Add `protocol, port, port_end, service, l7_app, l7_source`.

    Precedence: a known application, then the service text (any, application,
    proto/ports, bare word), then separate port and protocol. Bad text never fails.
    Arguments are SQL expressions.
    """
    text, proto, named = (e or "CAST(NULL AS string)" for e in (service, protocol, app))
    tokens = L.listing(L.APP_TOKENS)
    df = df.withColumns({
        "__text": F.expr(_trimmed(text)),
        "__given": F.expr(f"coalesce(length({text}) > 0, false)"),
        "__port": F.expr(f"CAST({port or 'NULL'} AS int)"),
        "__proto": F.expr(f"nullif({proto}, '')"),
        "__app": F.expr(f"lower({_trimmed(named)})"),
    }).withColumns({
        "__form": F.expr(f"""CASE WHEN __app IN ({tokens}) THEN 'app'
            WHEN NOT __given THEN 'ports'
            WHEN lower(__text) = 'any' THEN 'any'
            WHEN lower(__text) IN ({tokens}) THEN 'token'
            WHEN instr(__text, '/') > 0 THEN 'pair' ELSE 'word' END"""),
        "__tail": F.expr("substring(__text, instr(__text, '/') + 1)"),
    }).withColumns({
        "__token": F.expr("CASE __form WHEN 'app' THEN __app WHEN 'token' THEN lower(__text) END"),
        "__last": F.expr("CASE WHEN instr(__tail, '-') > 0 THEN try_cast(substring(__tail, instr(__tail, '-') + 1) AS int) END"),
        "__first": F.expr("try_cast(substring_index(__tail, '-', 1) AS int)"),
    }).withColumn("__transport", L.pick(_TRANSPORT_OF, "__token"))
    return df.withColumns({
        "protocol": F.expr(f"""CASE
            WHEN __token IS NOT NULL THEN CASE WHEN __proto IS NOT NULL THEN {_known_protocol('__proto')}
                                          ELSE coalesce(split_part(__transport, '/', 1), 'tcp') END
            WHEN __form = 'any' THEN 'any'
            WHEN __form = 'pair' THEN {_known_protocol("substring_index(__text, '/', 1)")}
            WHEN __form = 'word' THEN {_known_protocol('__text')}
            ELSE {_known_protocol("coalesce(__proto, 'tcp')")} END"""),
        "port": F.expr("""CASE
            WHEN __token IS NOT NULL THEN coalesce(__port, try_cast(split_part(__transport, '/', 2) AS int))
            WHEN __form = 'pair' AND (instr(__tail, '-') = 0 OR __last IS NOT NULL) THEN __first
            WHEN __form = 'ports' THEN __port END"""),
        "port_end": F.expr("CASE WHEN __form = 'pair' AND __first IS NOT NULL THEN __last END"),
    }).withColumns({
        "service": F.expr("""CASE WHEN __token IS NOT NULL THEN __token WHEN __form = 'any' THEN 'any'
            WHEN __form = 'ports' THEN concat_ws('/', protocol, port) ELSE __text END"""),
        "l7_app": F.expr(f"""CASE WHEN __token IS NOT NULL THEN __token WHEN __form IN ('pair', 'ports')
            THEN {L.pick_sql(_APP_OF, "concat(protocol, '/', port)")} END"""),
        "l7_source": F.expr(f"""CASE WHEN __token IS NOT NULL THEN 'declared' WHEN __form IN ('pair', 'ports')
            AND {L.pick_sql(_APP_OF, "concat(protocol, '/', port)")} IS NOT NULL THEN 'inferred' END"""),
    }).drop("__text", "__given", "__port", "__proto", "__app", "__token", "__form", "__tail", "__first", "__last",
            "__transport")


def same_traffic(a: str, b: str) -> Column:
    """Services of aliases `a` and `b` touch the same traffic: protocol equal or any, port equal or open."""
    return F.expr(f"({a}_protocol = 'any' OR {b}_protocol = 'any' OR {a}_protocol = {b}_protocol) "
                  f"AND ({a}_port IS NULL OR {b}_port IS NULL OR {a}_port = {b}_port)")


def grant_answers(protocol: str, port: str, app: str, g_protocol: str, g_port: str, g_port_end: str,
                  g_app: str) -> Column:
    """Does a grant answer a question about a protocol, port or application?

    Open grants answer everything; an application question looks at nothing else.
    """
    return F.expr(f"""coalesce({g_protocol} = 'any', false) OR CASE
        WHEN {app} IS NOT NULL THEN coalesce(lower({g_app}) = lower({app}), false)
        ELSE ({protocol} IS NULL OR {protocol} = 'any' OR {g_protocol} = {protocol})
         AND ({port} IS NULL OR coalesce({port} BETWEEN {g_port} AND coalesce({g_port_end}, {g_port}), false)) END""")
