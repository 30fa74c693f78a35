"""netsieve: labelled network-flow analytics on Spark.

Profiling, cleaning, feature preparation, reproducible splits, flow
sequences, MLlib training, classification metrics, a model registry and a
Structured Streaming scorer -- all expressed as DataFrame / MLlib plans.
"""

from netsieve.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
