"""aerolens: telemetry integrity analytics as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function usable with
``DataFrame.transform``.  Layers:

* L1 ``operators.rules``        physical-range checks
* L2 ``operators.statistical``  rolling z-scores and freeze detection
* L3 ``operators.features`` +   window features and detectors
  ``operators.models``
* ``operators.evaluation`` / ``operators.curves`` / ``operators.segments``
* ``streaming``                 stateful Structured Streaming job
"""

from aerolens.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
