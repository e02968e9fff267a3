from launchlens.sources.tables import *  # noqa: F401,F403
from launchlens.sources.tables import __all__  # noqa: F401
