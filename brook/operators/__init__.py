"""DataFrame -> DataFrame operators.  Nothing here triggers an action except
the explicit gates in ``quality`` and the model fit in ``trainprep``."""
