"""Parallel-corpus analytics for Spark: every operator is ``DataFrame -> DataFrame``
or ``Column -> Column``, lazy, and free of driver-side loops over data."""
