"""logweave: log and incident analytics as Spark DataFrame transformations.

Every public operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function built from the Spark DataFrame API, usable with ``df.transform``.
"""

__version__ = "0.1.0"
