"""flowloom: network-flow analytics written as Spark DataFrame transforms.

``functions`` holds pure Column expressions, ``operators`` holds
``DataFrame -> DataFrame`` transforms, ``sources`` reads and writes tables,
``streaming`` holds the Structured Streaming jobs and ``plans`` wires them into
named queries over the supplied tables.
"""

__version__ = "0.1.0"
