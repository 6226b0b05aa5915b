"""Plans built from the operators: size-checked broadcasts and the skew-safe
position plan (``sizing``, ``ordinal``); whole jobs over every cluster -- the
configuration chain and its rule tables (``configure``, ``lineage_rules``,
``kerberos_rules``), the start-up readiness report (``readiness``),
component bundles per release (``bundles``), rewrites of cluster files
(``kdc_files``), principal ids (``principals``); and the catalog of queries
over the driver tables (``catalog``)."""
