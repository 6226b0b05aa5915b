"""W16 on real configuration files: the ordered rewrites the source applies
to the Kerberos files of the KDC host and to every agent's ini file, for all
clusters at once.

``files`` holds (cluster_id, host, path, content) -- e.g. read with
:func:`fleetlens.sources.read_text_files`; ``clusters`` holds one row per
cluster with the values the rewrites put in. Files are matched by the end of
their path. The cluster values are joined in once (one row per cluster) and
each file is rewritten by a chain of ``regexp_replace``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import falsy_default
from fleetlens.operators.text import literal_replacement
from fleetlens.plans.skew import join_one_per_key

# ---------------------------------------------------------------------------
# The files and patterns the source rewrites, in the order it
# applies them (the innermost substitution first). A replacement names a cluster
# value in braces; ``$1`` is the pattern's first group.
# ---------------------------------------------------------------------------
DEFAULT_MAX_LIFE = "1d"
RULES = [
    ("krb5.conf", r"kerberos.example.com", "{kdc_host}"),
    ("krb5.conf", r"ticket_lifetime = ((.)*)", "ticket_lifetime = {lifetime_or_group}"),
    ("krb5.conf", r"example.com", "{network}"),
    ("krb5.conf", r"EXAMPLE.COM", "{realm}"),
    ("kdc.conf", r"\[kdcdefaults\]", "[kdcdefaults]\n max_renewablelife = 7d\n max_life = {max_life}"),
    ("kdc.conf", r"EXAMPLE.COM", "{realm}"),
    ("kadm5.acl", r"EXAMPLE.COM", "{realm}"),
    ("agent.ini", r"(hostname)=.*", "$1={primary_host}"),
]
# ---------------------------------------------------------------------------


def _replacement(template: str, values: dict[str, Column]) -> Column:
    """The template with its cluster value put in; NULL where the value is."""
    before, _, rest = template.partition("{")
    name, _, after = rest.partition("}")
    return F.concat(F.lit(before), values[name], F.lit(after))


def rewrite_cluster_files(files: DataFrame, clusters: DataFrame, network: str = "network",
                          kdc_host: str = "kdc_host", primary_host: str = "primary_host",
                          lifetime: str = "ticket_lifetime", status: str | None = "status") -> DataFrame:
    """Rewritten ``content`` for every file whose path ends in one of the
    known names; other files pass unchanged.

    A rule whose cluster value is NULL leaves the text as it is. ``status``
    says what happened: ``other`` (no known name), ``no cluster`` (the file's cluster is
    not listed), ``value missing`` (at least one rule left out), ``done``.
    ``clusters`` holds one row per cluster; a cluster with very many files keeps them in
    place in the join."""
    life = F.col(lifetime).cast("string")
    text = lambda c: literal_replacement(F.col(c))
    vals = clusters.select("cluster_id", F.struct(
        text(network).alias("network"), literal_replacement(F.upper(F.col(network))).alias("realm"),
        text(kdc_host).alias("kdc_host"), text(primary_host).alias("primary_host"),
        F.when(life.isNull() | (life == ""), F.lit("$1")).otherwise(literal_replacement(life)).alias("lifetime_or_group"),
        literal_replacement(falsy_default(life, DEFAULT_MAX_LIFE)).alias("max_life")).alias("_fl_vals"))
    j = join_one_per_key(files, vals, "cluster_id", "left")
    names = ("network", "realm", "kdc_host", "primary_host", "lifetime_or_group", "max_life")
    values = {n: F.col(f"_fl_vals.{n}") for n in names}
    out, done = F.col("content"), F.lit("other")
    for kind in dict.fromkeys(k for k, _, _ in RULES):
        new, missing = F.col("content"), F.lit(False)
        for k, pattern, template in RULES:
            if k == kind:
                r = _replacement(template, values)
                new = F.when(r.isNull(), new).otherwise(F.regexp_replace(new, F.lit(pattern), r))
                missing = missing | r.isNull()
        known = F.col("path").endswith(kind)
        out = F.when(known, new).otherwise(out)
        done = F.when(known, F.when(F.col("_fl_vals").isNull(), F.lit("no cluster"))
                      .when(missing, F.lit("value missing")).otherwise(F.lit("done"))).otherwise(done)
    picked = [out.alias(c) if c == "content" else F.col(f"`{c}`") for c in files.columns]
    return j.select(*picked, *([done.alias(status)] if status else []))
