"""Readers of what enrichment takes: commits and documents."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import shared_dir

#: Folders that hold documents (fixed values).
DOC_FOLDERS = ("docs", ".concept-graph")


def git_commits(spark: SparkSession, workspace: str) -> DataFrame:
    """(path, commit_ts, author_email), a row for each file that a commit on HEAD's history changes
    against its first parent.  git writes its log to the shared folder; Spark reads it from there."""
    log = subprocess.run(["git", "-C", workspace, "log", "--first-parent", "-m", "--name-only", "--format=%x01%ct%x02%ae", "-z"], check=True, capture_output=True)
    path = f"{shared_dir(spark)}/git-log-{os.getpid()}-{abs(hash(workspace))}"
    text = log.stdout.decode("utf-8", "replace").replace("\n", "\0")
    spark.createDataFrame([(c,) for c in text.split("\x01") if c.strip("\0")], "value string").write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path).select(F.split("value", "\x00").alias("p"))
    rows = rows.select(F.split(F.col("p")[0], "\x02").alias("h"), F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("path")).where("path <> ''")
    return rows.select("path", F.col("h")[0].cast("long").alias("commit_ts"), F.col("h")[1].alias("author_email"))


def markdown(spark: SparkSession, workspace: str) -> DataFrame:
    """(path, text) of the markdown files below a workspace's DOC_FOLDERS, paths from the workspace on."""
    from .producers import _read

    out = spark.createDataFrame([], "path string, text string")
    for folder in DOC_FOLDERS:
        top = os.path.join(workspace, folder)
        if os.path.isdir(top) and any(f.endswith(".md") for _, _, fs in os.walk(top) for f in fs):
            out = out.unionByName(_read(spark, top, "*.md").select(F.concat(F.lit(folder + "/"), "path").alias("path"), "text"))
    return out
