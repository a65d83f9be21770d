"""calibra: Spark-native data work around binary classifiers.

Data quality, exact stratified splits and sticky routing, scaling, PCA and
minority oversampling, batch scoring, tie-exact distributed evaluation,
model comparison and A/B statistics, drift, degradation and retraining
decisions, run/model-version analytics, and Structured Streaming monitors.
"""

__version__ = "0.1.0"
