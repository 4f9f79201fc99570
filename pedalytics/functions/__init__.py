"""Column -> Column building blocks (all JVM-side, codegen friendly)."""

from pedalytics.functions.columns import *  # noqa: F401,F403
from pedalytics.functions.columns import __all__  # noqa: F401
