"""basketlens: commerce behaviour analytics as Spark DataFrame jobs.

Every operator is a pure ``DataFrame -> DataFrame`` function built from
DataFrame/SQL primitives so Catalyst can prune, push down and plan it.
"""

__version__ = "0.1.0"
