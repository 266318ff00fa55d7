"""pairlab: a Spark-native retrieval data engine.

Exact cosine top-k joins, threshold calibration, bidirectional hard-negative
mining, training-instance assembly, loss audits and ranking metrics, all as
DataFrame jobs.
"""

__version__ = "0.1.0"
