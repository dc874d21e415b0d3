"""Which workers may run a portable task elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligible() -> Column:
    """Of a task (protocol, schema_version, mobility, required, hint, kinds, envelope) and a worker (health, capabilities, tasks,
    runners, resources): the first of the worker's entries for the protocol decides on schema and mobility."""
    own = F.get(F.filter("tasks", lambda t: t["protocol"] == F.col("protocol")), F.lit(0))
    runs = F.exists("runners", lambda r: (r["runner"] == F.col("hint")) & (r["generation"] > 0))
    return (
        (F.col("health") == "ready") & F.col("envelope") & (F.col("mobility") != "local_only") & (F.col("capabilities").bitwiseAND(F.col("required")) == F.col("required"))
        & F.coalesce((own["schema_version"] == F.col("schema_version")) & own["mobile"], F.lit(False)) & (F.col("hint").isNull() | runs) & F.forall("kinds", lambda k: F.array_contains("resources", k))
    )


def candidates(tasks: DataFrame, fleet: DataFrame, excluded: DataFrame) -> DataFrame:
    """Pairs of a task and an eligible worker that isn't excluded. They meet by protocol: a worker that doesn't list a task's
    protocol can't run it."""
    listed = fleet.join(excluded.select("idx"), "idx", "left_anti").withColumn("protocol", F.explode(F.array_distinct(F.transform("tasks", lambda t: t["protocol"]))))
    return tasks.join(listed, "protocol").where(eligible())
