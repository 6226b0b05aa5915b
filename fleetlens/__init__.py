"""fleetlens: fleet-metadata analytics as Spark DataFrame operators.

Questions a cluster launcher asks of one cluster (are the expected hosts
registered, is every host healthy, which component blocks start-up, which
configuration version is current, what does a property bag look like after
an update) asked of many clusters at once, as DataFrame plans.
"""

from fleetlens.operators import *  # noqa: F401,F403
from fleetlens.operators import __all__ as _ops

__all__ = list(_ops)
