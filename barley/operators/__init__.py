from barley.operators.registry import OPERATORS, operator, lookup  # noqa: F401
from barley.operators.spec import Slice, Track  # noqa: F401
from barley.operators import scalar, rolling, cross  # noqa: F401  (they fill the registry)
from barley.operators.factorset import Board, FactorSet, Term  # noqa: F401
