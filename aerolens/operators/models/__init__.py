"""L3 detectors."""

from aerolens.operators.models.detector import AnomalyDetector, compare_algorithms, detect_ml_anomalies

__all__ = ["AnomalyDetector", "compare_algorithms", "detect_ml_anomalies"]
