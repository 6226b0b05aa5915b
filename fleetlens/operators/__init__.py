"""The operators W01-W20. Each takes and returns DataFrames and calls no
action, except where a parameter table is size-checked before a broadcast."""

from fleetlens.operators.configs import (
    Rule, append_missing, append_missing_by_key, carry_between_types, carry_property, first_by, json_prop, overlay,
    overlay_bags, overlay_tagged,
    resolve_current, select_rules,
)
from fleetlens.operators.filters import having_member, keep_listed
from fleetlens.operators.gates import (
    all_healthy, blocker_rows, blockers, reconcile, reconcile_summary, reconcile_tagged,
    state_is, state_rows, state_summary, time_to_ready,
)
from fleetlens.operators.rosters import (
    assemble_roster, assign_ids, check_cardinality, rename_keys, replicate_template,
)
from fleetlens.operators.text import (
    extract_first, literal_replacement, rewrite_by_rules, rewrite_expr, rewrite_text,
)
from fleetlens.operators.versions import bracket_lookup, expand_bundle_table, expand_bundles

__all__ = [
    "Rule", "all_healthy", "append_missing", "append_missing_by_key", "assemble_roster", "assign_ids",
    "blocker_rows", "blockers", "bracket_lookup", "carry_between_types", "carry_property",
    "check_cardinality",
    "expand_bundle_table", "expand_bundles", "extract_first", "first_by", "having_member", "json_prop",
    "keep_listed", "literal_replacement", "overlay", "overlay_bags", "overlay_tagged", "reconcile",
    "reconcile_summary",
    "reconcile_tagged",
    "rename_keys", "replicate_template", "resolve_current", "rewrite_by_rules", "rewrite_expr", "rewrite_text",
    "select_rules",
    "state_is", "state_rows", "state_summary", "time_to_ready",
]
