"""W16 on configuration files against Python's ``re.sub`` with the same
ordered rules, the way the source rewrites them."""

import re

from fleetlens.plans.kdc_files import rewrite_cluster_files

KRB5 = """[libdefaults]
 default_realm = EXAMPLE.COM
 ticket_lifetime = 24h
 renew_lifetime = 7d
[realms]
 EXAMPLE.COM = {
  kdc = kerberos.example.com
  admin_server = kerberos.example.com
 }
[domain_realm]
 .example.com = EXAMPLE.COM
 example.com = EXAMPLE.COM
"""
KDC = "[kdcdefaults]\n kdc_ports = 88\n[realms]\n EXAMPLE.COM = {\n  acl_file = x\n }\n"
ACL = "*/admin@EXAMPLE.COM *\n"
INI = "[server]\nhostname=localhost\nurl_port=8440\n[agent]\nhostname_script=x\n"


def model(kind, text, network, kdc, primary, lifetime):
    realm = network.upper()
    if kind == "krb5":
        text = re.sub(r"kerberos.example.com", kdc, text)
        text = re.sub(r"ticket_lifetime = ((.)*)",
                      "ticket_lifetime = " + (lifetime if lifetime else r"\g<1>"), text)
        text = re.sub(r"example.com", network, text)
        return re.sub(r"EXAMPLE.COM", realm, text)
    if kind == "kdc":
        text = re.sub(r"\[kdcdefaults\]",
                      "[kdcdefaults]\n max_renewablelife = 7d\n max_life = " + (lifetime or "1d"), text)
        return re.sub(r"EXAMPLE.COM", realm, text)
    if kind == "acl":
        return re.sub(r"EXAMPLE.COM", realm, text)
    return re.sub(r"(hostname)=.*", r"\1=" + primary, text)


def test_rewrite_cluster_files(spark):
    clusters = [("c1", "net-one", "kdc.net-one", "node-1.net-one", "86400"),
                ("c2", "lab", "kdc.lab", "n1.lab", None)]
    files = []
    for c, *_ in clusters:
        files += [(c, "kdc", "/etc/krb5.conf", KRB5), (c, "kdc", "/var/kerberos/krb5kdc/kdc.conf", KDC),
                  (c, "kdc", "/var/kerberos/krb5kdc/kadm5.acl", ACL),
                  (c, "h1", "/etc/agent/conf/node-agent.ini", INI),
                  (c, "h1", "/etc/motd", "example.com stays")]
    fdf = spark.createDataFrame(files, "cluster_id string, host string, path string, content string")
    cdf = spark.createDataFrame(clusters, "cluster_id string, network string, kdc_host string, "
                                          "primary_host string, ticket_lifetime string")
    out = {(r.cluster_id, r.path): r.content for r in rewrite_cluster_files(fdf, cdf).collect()}
    kinds = {"/etc/krb5.conf": ("krb5", KRB5), "/var/kerberos/krb5kdc/kdc.conf": ("kdc", KDC),
             "/var/kerberos/krb5kdc/kadm5.acl": ("acl", ACL),
             "/etc/agent/conf/node-agent.ini": ("ini", INI)}
    for c, net, kdc, pri, life in clusters:
        for path, (kind, text) in kinds.items():
            assert out[(c, path)] == model(kind, text, net, kdc, pri, life), (c, path)
        assert out[(c, "/etc/motd")] == "example.com stays"
    assert "max_life = 1d" in out[("c2", "/var/kerberos/krb5kdc/kdc.conf")]
    assert "ticket_lifetime = 24h" in out[("c2", "/etc/krb5.conf")]
    assert "default_realm = NET-ONE" in out[("c1", "/etc/krb5.conf")]


def test_missing_values_keep_the_text(spark):
    """A rule without its value leaves the text alone, and the status says so."""
    files = spark.createDataFrame(
        [("c1", "h", "/etc/krb5.conf", "kdc = kerberos.example.com EXAMPLE.COM"), ("c1", "h", "/etc/agent.ini", "hostname=old"),
         ("gone", "h", "/etc/krb5.conf", "EXAMPLE.COM"), (None, "h", "/etc/kdc.conf", "EXAMPLE.COM"), ("c1", "h", "/x", "example.com")],
        "cluster_id string, host string, path string, content string")
    clusters = spark.createDataFrame([("c1", "net.one", None, None, None)],
                                     "cluster_id string, network string, kdc_host string, primary_host string, ticket_lifetime string")
    got = {(r.cluster_id, r.path): (r.content, r.status) for r in rewrite_cluster_files(files, clusters).collect()}
    assert got == {
        ("c1", "/etc/krb5.conf"): ("kdc = kerberos.net.one NET.ONE", "value missing"), ("c1", "/etc/agent.ini"): ("hostname=old", "value missing"),
        ("gone", "/etc/krb5.conf"): ("EXAMPLE.COM", "no cluster"), (None, "/etc/kdc.conf"): ("EXAMPLE.COM", "no cluster"),
        ("c1", "/x"): ("example.com", "other"),
    }
