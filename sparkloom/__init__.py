"""sparkloom: hybrid text retrieval and code-structure analytics as Spark plans."""

__version__ = "0.1.0"
