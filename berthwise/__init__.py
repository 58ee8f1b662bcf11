"""berthwise — port-call analytics as Spark DataFrame operators.

Every public operator is a plain function ``DataFrame -> DataFrame`` built from
``pyspark.sql.functions`` so Catalyst plans it.  Python runs only inside the
Arrow-batched grouped jobs (plan repair and
reservation admission) whose semantics are sequential inside a group.
"""

from berthwise.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
