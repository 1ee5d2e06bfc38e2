"""Queries bound to tables; importing a module registers its queries."""

from . import registry as registry
from . import enrichment as enrichment
from . import merge as merge
from . import rewrites as rewrites
from . import metrics as metrics
from . import knowledge as knowledge
from . import third_party as third_party
from . import identity as identity
from . import lineage as lineage
from . import rules as rules
from . import renames as renames
from . import absorb as absorb
from . import signals as signals
from . import managed as managed
from . import normalise as normalise
