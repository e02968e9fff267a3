from launchlens.functions.columns import *  # noqa: F401,F403
from launchlens.functions.columns import __all__  # noqa: F401
