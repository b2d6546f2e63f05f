"""quillon: a PySpark-native engine for collections of structured legal-style documents.

Every operator is a plain ``DataFrame -> DataFrame`` or ``Column -> Column``
function.  Iterative operators write their intermediate tables to the shared
folder named by ``spark.checkpoint.dir`` and never keep state on one machine.
"""

__version__ = "0.1.0"
