"""How much a session has read from files, by the figures that Spark itself keeps of its stages."""

from __future__ import annotations


def scanned_rows(spark) -> int:
    """Rows that stages have read from files since the session began."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).inputRecords() for i in range(stages.size()))
