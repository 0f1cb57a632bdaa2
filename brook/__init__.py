"""brook: a Spark-native feed lake and run-fleet analytics library.

Every operator is a function from DataFrame(s) to a DataFrame built with the
DataFrame / SQL API, so Catalyst plans, prunes and pushes down; Python runs only
inside Arrow-batched ``mapInPandas`` helpers where no built-in expression fits.
"""

__version__ = "0.1.0"
