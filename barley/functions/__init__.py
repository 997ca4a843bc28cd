from barley.functions.numeric import (  # noqa: F401
    both, bottom_of, clean, compare, either, finite, negate, normal_inverse, pick, ratio, root, top_of, truth,
)
