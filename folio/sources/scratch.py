"""Folders that all executors share, for tables between steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a session of one machine may go without that setting."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        shared = tempfile.mkdtemp(prefix="folio")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
