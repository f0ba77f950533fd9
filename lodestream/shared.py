"""The folder that driver and executors share."""

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Temporary folders of local sessions that name no shared one.
_OWN: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir. A local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="lodestream-")
        _OWN[app] = found
    return f"{found.rstrip('/')}/lodestream/{name}-{uuid.uuid4().hex}"
