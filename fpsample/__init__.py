"""A Spark-native engine for finite-population survey sampling.

Design, and by topic: criteria, search, sampling (with Population), clustering, random (generators), measure.
"""

from fpsample.operators import clustering, criteria, measure, sampling, search
from fpsample.operators.design import Design
from fpsample.sources import generators as random

__version__ = "0.1.0"
__all__ = ["Design", "clustering", "criteria", "measure", "random", "sampling", "search"]
