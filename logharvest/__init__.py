"""Study, at corpus scale and on Spark, how source code uses logging.

Sub-packages
------------
``functions``  column expressions (classify, normalise, match, parse)
``sources``    readers and writers
``operators``  DataFrame -> DataFrame steps
``plans``      whole studies composed from the operators
``streaming``  the incremental framework scan
"""

__version__ = "0.1.0"
