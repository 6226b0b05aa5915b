"""E2 and E5: text built from other columns -- endpoints, URLs, principals,
image tags, realms. Plain ``concat`` / ``format_string`` expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.columns import as_col


def _c(x: Column | str | int) -> Column:
    if isinstance(x, Column):
        return x
    return F.lit(x) if isinstance(x, int) else F.col(x)


def endpoint(host: Column | str, port: Column | str | int) -> Column:
    """``host:port``."""
    return F.concat_ws(":", as_col(host), _c(port).cast("string"))


def url(scheme: str, host: Column | str, port: Column | str | int, path: str = "") -> Column:
    """``scheme://host:port[path]``."""
    return F.concat(F.lit(f"{scheme}://"), endpoint(host, port), F.lit(path))


def quorum(hosts: Column | str, port: Column | str | int) -> Column:
    """Comma list of ``host:port`` from an array of hosts."""
    p = _c(port).cast("string")
    return F.array_join(F.transform(as_col(hosts), lambda h: F.concat_ws(":", h, p)), ",")


def realm(network: Column | str) -> Column:
    """E5: the realm is the network name upper-cased."""
    return F.upper(as_col(network))


def principal(name: Column | str, realm_col: Column | str) -> Column:
    """``name@REALM``."""
    return F.concat_ws("@", as_col(name), as_col(realm_col))


def image_tag(prefix: str, version: Column | str, suffix: Column | str) -> Column:
    """``{prefix}{version}_{suffix}`` e.g. a per-role image name."""
    return F.concat(F.lit(prefix), as_col(version), F.lit("_"), as_col(suffix))
