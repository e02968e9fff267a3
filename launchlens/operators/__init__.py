"""DataFrame to DataFrame operators, by subject."""

from launchlens.operators.clean import *  # noqa: F401,F403
from launchlens.operators.cluster import *  # noqa: F401,F403
from launchlens.operators.evaluate import *  # noqa: F401,F403
from launchlens.operators.features import *  # noqa: F401,F403
from launchlens.operators.gram import *  # noqa: F401,F403
from launchlens.operators.impute import *  # noqa: F401,F403
from launchlens.operators.materialize import *  # noqa: F401,F403
from launchlens.operators.moments import *  # noqa: F401,F403
from launchlens.operators.overlap import *  # noqa: F401,F403
from launchlens.operators.profile import *  # noqa: F401,F403
from launchlens.operators.quantiles import *  # noqa: F401,F403
from launchlens.operators.regress import *  # noqa: F401,F403
from launchlens.operators.reshape import *  # noqa: F401,F403
from launchlens.operators.rollup import *  # noqa: F401,F403
from launchlens.operators.shape import *  # noqa: F401,F403
from launchlens.operators.split import *  # noqa: F401,F403
from launchlens.operators.trees import *  # noqa: F401,F403
