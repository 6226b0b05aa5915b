"""The Kerberos configuration bags the source writes as new tagged versions
Kerberos, and their replacement of the current bags.

A new version replaces the whole bag of its type (it is not merged with the
current one), so :func:`replace_bags` drops the current rows of those types
and adds the new ones. Both steps are map-only apart from one anti join on
(cluster, type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import falsy_default

# ---------------------------------------------------------------------------
# The bags the source writes. "{kdc_realm}", "{kdc_host}" and
# "{ticket_lifetime}" are filled per cluster; "{{...}}" and "{%...%}" belong
# to the template language of the target system and stay as they are.
# ---------------------------------------------------------------------------
DEFAULT_TICKET_LIFETIME = "24h"
KRB5_CONTENT = (
    "[libdefaults]\n  renew_lifetime = 7d\n  forwardable = true\n  default_realm = {{realm}}\n  "
    "ticket_lifetime = {ticket_lifetime}\n  "
    "dns_lookup_realm = false\n  dns_lookup_kdc = false\n"
    "  default_ccache_name = /tmp/krb5cc_%{uid}\n"
    "  #default_tgs_enctypes = {{encryption_types}}\n"
    "  #default_tkt_enctypes = {{encryption_types}}\n"
    "{% if domains %}\n[domain_realm]\n{%- for domain in domains.split(',') %}\n"
    "  {{domain|trim()}} = {{realm}}\n{%- endfor %}\n{% endif %}\n"
    "[logging]\n  default = FILE:/var/log/krb5kdc.log\n"
    "  admin_server = FILE:/var/log/kadmind.log\n  kdc = FILE:/var/log/krb5kdc.log\n\n"
    "[realms]\n  {{realm}} = {\n{%- if master_kdc %}\n    master_kdc = {{master_kdc|trim()}}\n"
    "{%- endif -%}\n{%- if kdc_hosts > 0 -%}\n"
    "{%- set kdc_host_list = kdc_hosts.split(',')  -%}\n"
    "{%- if kdc_host_list and kdc_host_list|length > 0 %}\n"
    "    admin_server = {{admin_server_host|default(kdc_host_list[0]|trim(), True)}}\n"
    "{%- if kdc_host_list -%}\n{%- if master_kdc and (master_kdc not in kdc_host_list) %}\n"
    "    kdc = {{master_kdc|trim()}}\n{%- endif -%}\n{% for kdc_host in kdc_host_list %}\n"
    "    kdc = {{kdc_host|trim()}}\n{%- endfor -%}\n{% endif %}\n{%- endif %}\n{%- endif %}\n"
    "  }\n\n{# Append additional realm declarations below #}"
)
KERBEROS_BAGS = {
    "krb5-conf": {
        "domains": "",
        "manage_krb5_conf": "true",
        "conf_dir": "/etc",
        "content": KRB5_CONTENT,
    },
    "kerberos-env": {
        "kdc_type": "mit-kdc",
        "manage_identities": "true",
        "create_ambari_principal": "true",
        "manage_auth_to_local": "true",
        "install_packages": "false",
        "encryption_types": "aes des3-cbc-sha1 rc4 des-cbc-md5",
        "realm": "{kdc_realm}",
        "kdc_hosts": "{kdc_host}",
        "master_kdc": "",
        "admin_server_host": "{kdc_host}",
        "executable_search_paths":
            "/usr/bin, /usr/kerberos/bin, /usr/sbin, /usr/lib/mit/bin, /usr/lib/mit/sbin",
        "service_check_principal_name": "${cluster}-${short_date}",
        "case_insensitive_username_rules": "false",
    },
}
# ---------------------------------------------------------------------------


def kerberos_bags(clusters: DataFrame, network: str = "network", kdc_host: str = "kdc_host",
                  lifetime: str = "ticket_lifetime", enabled: Column | None = None) -> DataFrame:
    """Long rows (cluster_id, config_type, key, value) of the two new bags
    for each cluster (where ``enabled`` holds). The realm is the network
    name upper-cased; a missing lifetime becomes 24h."""
    entries = F.array(*[
        F.struct(F.lit(t).alias("config_type"), F.lit(k).alias("key"), F.lit(v).alias("value"))
        for t, bag in KERBEROS_BAGS.items() for k, v in bag.items()])
    src = clusters if enabled is None else clusters.filter(enabled)
    rows = src.select(
        "cluster_id", F.upper(F.col(network)).alias("_fl_realm"), F.col(kdc_host).alias("_fl_kdc"),
        falsy_default(F.col(lifetime).cast("string"), DEFAULT_TICKET_LIFETIME).alias("_fl_life"),
        F.explode(entries).alias("_fl_e"))
    v = F.col("_fl_e.value")
    for token, col in (("{kdc_realm}", "_fl_realm"), ("{kdc_host}", "_fl_kdc"),
                       ("{ticket_lifetime}", "_fl_life")):
        v = F.replace(v, F.lit(token), F.coalesce(F.col(col), F.lit("")))
    return rows.select("cluster_id", F.col("_fl_e.config_type").alias("config_type"),
                       F.col("_fl_e.key").alias("key"), v.alias("value"))


def replace_bags(current: DataFrame, new: DataFrame) -> DataFrame:
    """Current long rows with every (cluster, type) present in ``new``
    replaced by the new rows as a whole."""
    keys = ["cluster_id", "config_type"]
    replaced = new.select(*keys).distinct()
    kept = current.join(replaced, keys, "left_anti")
    return kept.select("cluster_id", "config_type", "key", "value").unionByName(
        new.select("cluster_id", "config_type", "key", "value"))
