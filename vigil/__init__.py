"""vigil: Spark-native analytics for labelled multivariate sensor logs.

Every operator takes a DataFrame plus the names of the columns that play the
roles of *run* (the series key), *order* (time plus a unique tie-breaker),
*label* and *sensors*, so the same code serves plant recordings and any other
keyed event table.
"""

__version__ = "0.1.0"
