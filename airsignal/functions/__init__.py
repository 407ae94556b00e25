"""Pure Column functions (no shuffle, no window): calendar, scaling, categories."""

from airsignal.functions.columns import *  # noqa: F401,F403
from airsignal.functions.columns import __all__  # noqa: F401
