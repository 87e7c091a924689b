"""Graph anomaly detection on Spark node and edge tables."""

from kithwatch.graph import Graph
from kithwatch.plans.detection import Detection, detect_anomalies

__all__ = ["Detection", "Graph", "detect_anomalies"]
