"""Run and chat history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each project; counts fall back to ``parsed`` and ``chunks`` where those columns exist."""
    fall = lambda c, other: F.coalesce(c, other) if other in runs.columns else F.col(c)
    rows = runs.select("project_path", "last_accessed", fall("total_files", "parsed").alias("total_files"), fall("total_chunks", "chunks").alias("total_chunks"))
    latest = F.max(F.struct("last_accessed", "total_files", "total_chunks"))
    return rows.groupBy("project_path").agg(latest.alias("x")).select("project_path", "x.*")


def recent_projects(runs: DataFrame) -> DataFrame:
    """Projects by their last access, latest first, with the minute of it."""
    shown = F.date_format("last_accessed", "yyyy-MM-dd HH:mm").alias("shown")
    return latest_runs(runs).select("*", shown).orderBy(F.desc("last_accessed"), "project_path")


def chat_of(chats: DataFrame, project_path) -> DataFrame:
    return chats.filter(F.col("project_path") == project_path).orderBy("turn").select("turn", "role", "content")


def replace_chats(chats: DataFrame, incoming: DataFrame) -> DataFrame:
    """Every project in ``incoming`` gets its whole new list."""
    return chats.join(incoming.select("project_path").distinct(), "project_path", "left_anti").unionByName(incoming)
