"""tessera: Spark-native data cleaning and multivariate statistics.

Every operator takes Spark DataFrames and returns Spark DataFrames (or a small
fitted model holding Python scalars / p x p NumPy matrices). Heavy work is a
distributed aggregation; the transform step is a lazy column projection.
"""

__version__ = "0.1.0"
