"""cellcast: space-time demand analysis on Spark DataFrames.

Point events (taxi pickups) are binned into grid cells and hours, turned into
trailing and lagged count layers, smoothed over neighbouring cells, joined with
calendar, weather and static geographic covariates, fed to a random forest, and
evaluated by how much demand the top-ranked cells capture.

Sub-packages:

* ``functions``  Column expressions: projection, grid binning, hour periods.
* ``sources``    Readers and writers: trip text, weather CSV/JSON, geo rasters
                 stored as cell tables, the layer store.
* ``operators``  DataFrame -> DataFrame steps: counts, lags, layers, smoothing,
                 features, model, evaluation.
* ``plans``      End-to-end jobs composed from operators, plus the query catalog.
* ``streaming``  Incremental cell-hour counts over arriving trip files.
"""

from cellcast.functions.grid import GridSpec, NYC_50M, TEST_1KM  # noqa: F401
from cellcast.session import build_session, scratch_dir  # noqa: F401
