"""Column expressions used inside the operators."""

from fleetlens.functions.columns import (
    as_col, falsy_default, java_replacement, regex_quote, upper_list,
)
from fleetlens.functions.templates import endpoint, image_tag, principal, quorum, realm, url
from fleetlens.functions.versions import version_key, version_literal, version_prefix

__all__ = [
    "as_col", "endpoint", "falsy_default", "image_tag", "java_replacement", "principal",
    "quorum", "realm", "regex_quote", "upper_list", "url",
    "version_key", "version_literal", "version_prefix",
]
