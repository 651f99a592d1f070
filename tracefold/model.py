"""The normalised model: three flat tables keyed by file, message and call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Log sources in scan order, and the label each gives its sessions (fixed values).
SOURCE_A, SOURCE_B, SOURCE_C = "claude", "codex", "eventlog"
AGENTS = [SOURCE_A, SOURCE_B, SOURCE_C]
#: A label that is accepted as a filter although no source produces it.
VALID_AGENTS = [SOURCE_A, SOURCE_B, "gemini", SOURCE_C]
ROLES = ["user", "assistant", "system", "tool", "summary"]
TIERS = ["trivial", "light", "moderate", "substantive", "heavy"]

SESSION_STATS = (
    "struct<total_input_tokens:bigint,total_output_tokens:bigint,cached_input_tokens:bigint,reasoning_tokens:bigint,"
    "context_window:bigint,final_context_size:bigint,peak_context_size:bigint>"
)
MESSAGE_STATS = "struct<input_tokens:bigint,output_tokens:bigint,cached_input_tokens:bigint,reasoning_tokens:bigint,context_size:bigint>"
RELATED = "array<struct<agent:string,kind:string,session_id:string,title:string,turn_id:string,path:string>>"

SESSIONS = (
    "agent string, agent_ord int, file_path string, file_ord int, session_id string, project string, cwd string,"
    f" started_at string, ended_at string, started_ts timestamp, ended_ts timestamp, model string, message_count bigint, stats {SESSION_STATS}"
)
MESSAGES = (
    "file_path string, agent string, session_id string, msg_index int, ord int, sub_ord int, role string, subtype string,"
    f" text string, timestamp string, ts timestamp, related {RELATED}, stats {MESSAGE_STATS}"
)
TOOL_CALLS = "file_path string, msg_index int, call_index int, name string, input variant, input_json string, status string, output string"


def columns_of(schema: str) -> list[str]:
    """Top-level column names of a DDL schema."""
    depth, names, start = 0, [], 0
    for i, c in enumerate(schema + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            names.append(schema[start:i].split()[0])
            start = i + 1
    return names


@dataclass(frozen=True)
class Index:
    """Sessions with their messages and tool calls; every query takes one."""

    sessions: DataFrame
    messages: DataFrame
    tool_calls: DataFrame

    @classmethod
    def from_frames(cls, sessions: DataFrame, messages: DataFrame, tool_calls: DataFrame) -> Index:
        return cls(sessions.select(*columns_of(SESSIONS)), messages.select(*columns_of(MESSAGES)), tool_calls.select(*columns_of(TOOL_CALLS)))

    @classmethod
    def from_roots(cls, spark: SparkSession, roots: dict[str, str]) -> Index:
        from .sources.scan import scan

        return scan(spark, roots)

    @classmethod
    def empty(cls, spark: SparkSession) -> Index:
        return cls(*(spark.createDataFrame([], s) for s in (SESSIONS, MESSAGES, TOOL_CALLS)))

    @property
    def spark(self) -> SparkSession:
        return self.sessions.sparkSession

    def related(self) -> DataFrame:
        """Edges between sessions, one row a reference, in message order."""
        pos = F.posexplode("related").alias("pos", "r")
        return self.messages.select("file_path", "agent", "session_id", "msg_index", pos).select(
            "file_path", F.col("agent").alias("from_agent"), F.col("session_id").alias("from_session"), "msg_index", "pos", F.col("r.*")
        )

    def turns(self) -> DataFrame:
        """Messages that carry token usage, numbered within their session."""
        from pyspark.sql import Window

        turn = F.row_number().over(Window.partitionBy("file_path").orderBy("msg_index"))
        return self.messages.where("stats is not null").select("file_path", "agent", "session_id", turn.alias("turn"), "role", "stats.*")

    def list(self, **options) -> DataFrame:
        return _commands().list_sessions(self, **options)

    def resolve(self, prefix: str, agent: str | None = None) -> str:
        from .operators.filters import resolve

        return resolve(self.sessions, prefix, agent)

    def show(self, prefix: str, agent: str | None = None) -> DataFrame:
        return _commands().show(self, prefix, agent)

    def search(self, query: str, **options) -> DataFrame:
        return _commands().search(self, query, **options)

    def substance(self) -> DataFrame:
        from .operators.digest import substance

        return substance(self)

    def digest(self, full: bool = False) -> DataFrame:
        from .operators.digest import digest

        return digest(self, full)

    def stats(self) -> DataFrame:
        from .operators.stats import session_stats

        return session_stats(self)

    def global_stats(self, agent: str | None = None) -> DataFrame:
        from .operators.stats import global_stats

        return global_stats(self, agent)

    def register_views(self, prefix: str = "") -> None:
        """Temporary views for plain SQL."""
        views = {"sessions": self.sessions, "messages": self.messages, "tool_calls": self.tool_calls, "turn_usage": self.turns(), "related_sessions": self.related()}
        for name, frame in views.items():
            frame.createOrReplaceTempView(prefix + name)

    def save(self, path: str) -> None:
        """Write a Parquet cache, partitioned so that filters by source and day prune files."""
        day = F.coalesce(F.date_format("started_ts", "yyyy-MM-dd"), F.lit("unknown"))
        keyed = self.sessions.withColumn("started_date", day)
        keyed.write.mode("overwrite").partitionBy("agent", "started_date").parquet(f"{path}/sessions")
        self.messages.write.mode("overwrite").partitionBy("agent").parquet(f"{path}/messages")
        self.tool_calls.withColumn("input", F.to_json("input")).write.mode("overwrite").parquet(f"{path}/tool_calls")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """What ``save`` or ``streaming.tail.follow`` wrote."""
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
        calls = read("tool_calls", TOOL_CALLS.replace("input variant", "input string")).withColumn("input", F.try_parse_json("input"))
        return cls.from_frames(read("sessions", SESSIONS), read("messages", MESSAGES), calls)


def _commands():
    from .plans import commands

    return commands
