"""All registered queries. Later modules use the SQL views of earlier ones."""
from filigrane.plans import statistics  # noqa: F401, I001
from filigrane.plans import sequences  # noqa: F401
from filigrane.plans import relations  # noqa: F401
from filigrane.plans import networks  # noqa: F401
from filigrane.plans import pathways  # noqa: F401
from filigrane.plans import pixels  # noqa: F401
from filigrane.plans import measures  # noqa: F401
from filigrane.plans import junctions  # noqa: F401
from filigrane.plans import storage  # noqa: F401
from filigrane.plans import observation  # noqa: F401
from filigrane.plans import images  # noqa: F401
from filigrane.plans.registry import ORACLES, QUERIES  # noqa: F401
