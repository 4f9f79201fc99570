"""Spark-native membership and usage analytics.

Raw monthly files -> staging tables -> marts -> data-quality checks, all
expressed as DataFrame transformations so that Catalyst plans the work.
"""

__version__ = "0.1.0"
