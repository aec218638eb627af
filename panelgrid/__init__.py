"""Panel forecasting studies as Spark jobs.

Tables go in as DataFrames keyed by series and time; standardized panels, rolling
random-feature ridge forecasts, their statistics and the counterfactual studies
built on them come out as DataFrames.
"""

import sys

from pyspark import cloudpickle

from panelgrid.config import CounterfactualConfig, StudyConfig
from panelgrid.operators.blocks import TimeAxis
from panelgrid.operators.engine import rolling_forecasts
from panelgrid.operators.scoring import score
from panelgrid.operators.standardize import standardize_panel
from panelgrid.operators.windows import expanding_vol, trailing_uncentered_vol
from panelgrid.plans.study import run_study

__all__ = [
    "CounterfactualConfig",
    "StudyConfig",
    "TimeAxis",
    "expanding_vol",
    "rolling_forecasts",
    "run_study",
    "score",
    "standardize_panel",
    "trailing_uncentered_vol",
]

# Task functions travel with their helpers: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
