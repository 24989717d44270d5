"""Live envelopes as canonical events: who, which session, status, phase, identity and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import text as tx
from tracelode.functions.hashing import live_session_id, stable_hash
from tracelode.functions.timefn import instant
from tracelode.operators.live import order_key
from tracelode.sources.files import MAX_ENVELOPE

# Event names, the status each leaves a session in, its phase, and its rank among events of one instant.
EVENTS = (
    ("SessionStart", "running", "starting", 0),
    ("UserPromptSubmit", "running", "thinking", 1),
    ("PreToolUse", "running", "using-tool", 2),
    ("PostToolUse", "running", "working", 3),
    ("PostToolUseFailure", "error", "tool-failed", 5),
    ("PermissionRequest", "waiting", "needs-you", 4),
    ("Notification", "waiting", "needs-you", 4),
    ("SubagentStart", "running", "delegating", 2),
    ("SubagentStop", "running", "working", 3),
    ("PreCompact", "running", "compacting", 2),
    ("Stop", "completed", "done", 6),
    ("StopFailure", "error", "failed", 7),
    ("SessionEnd", "completed", "ended", 8),
)
#: Payload fields that belong to one provider and mark a foreign event in another's envelope.
FOREIGN = {"claude-code": ("conversation_id", "cursor_version"), "cursor": ("transcript_path",)}


def _case(name: Column, i: int) -> Column:
    out = F.lit(None)
    for row in EVENTS:
        out = F.when(name == row[0], F.lit(row[i])).otherwise(out)
    return out


def canonical(envelopes: DataFrame, raw: str = "value", now: Column | None = None) -> DataFrame:
    """One canonical event an envelope that is JSON, small enough, of a known event and its own provider.

    updated_at is the source's time where it can be read, else that of receipt; event_id is the source's id, else derived
    from source time, kind and tool, else from the whole payload: equal envelopes have equal ids.
    """
    named = {"provider": "string", "received_at": "string", "process_id": "bigint", "origin": "string"}
    inside = {**dict.fromkeys(("hook_event_name", "timestamp", "session_id", "conversation_id", "tool_use_id", "tool_name", "notification_type", "cwd", "event_id"), "string"), "is_error": "boolean", "sequence": "bigint"}
    paths = {**named, **{f"payload.{k}": t for k, t in inside.items()}}
    column = lambda p: "__" + p.replace(".", "_")

    def alien(j: Column, provider: Column) -> Column:
        out = F.lit(False)
        for agent, keys in FOREIGN.items():
            for k in keys:
                out = out | ((provider == agent) & F.try_variant_get(j, f"$.payload.{k}", "variant").isNotNull())
        return out

    def fields(j: Column) -> Column:
        return F.struct(j.alias("__j"), alien(j, F.try_variant_get(j, "$.provider", "string")).alias("__foreign"), *[F.try_variant_get(j, f"$.{p}", t).alias(column(p)) for p, t in paths.items()])

    # Arrays of one element name what each step gives the next, so that an envelope is made and parsed once and not for each of its fields.
    parsed = F.transform(F.array(F.col(raw)), lambda v: F.when(F.octet_length(v) <= MAX_ENVELOPE, F.try_parse_json(v)))
    e = envelopes.select("*", F.inline(F.transform(F.filter(parsed, lambda j: j.isNotNull()), fields)))
    g = lambda p: F.col(column(p))
    name, provider, foreign = g("payload.hook_event_name"), g("provider"), F.col("__foreign")
    source_time = instant(F.coalesce(g("payload.timestamp"), F.lit("")))
    received = F.coalesce(instant(F.coalesce(g("received_at"), F.lit(""))), now if now is not None else F.current_timestamp())
    session = F.coalesce(g("payload.session_id"), g("payload.conversation_id"))
    digest = stable_hash(F.to_json("__j"))
    derived = stable_hash(F.concat_ws("|", provider, session, name, g("payload.timestamp"), g("payload.tool_use_id"), g("payload.tool_name")))
    failed = F.coalesce(g("payload.is_error"), F.lit(False))
    idle = (name == "Notification") & (g("payload.notification_type") == "idle_prompt")
    status = F.when(failed, "error").when(idle, "waiting").otherwise(_case(name, 1))
    out = e.where(name.isin(*[x[0] for x in EVENTS]) & session.isNotNull() & ~foreign)
    return out.select(
        provider.alias("agent"), session.alias("source_session_id"), live_session_id(provider, session).alias("id"), name.alias("event_name"), status.alias("status"), F.when(failed, "tool-failed").otherwise(_case(name, 2)).alias("phase"),
        tx.tool_name(F.coalesce(g("payload.tool_name"), name)).alias("label"), tx.project_label(g("payload.cwd")).alias("project_label"), F.coalesce(source_time, received).alias("updated_at"),
        order_key(g("payload.sequence"), source_time, _case(name, 3), digest).alias("order_key"),
        F.coalesce(g("payload.event_id"), F.when(source_time.isNotNull(), derived), digest).alias("event_id"), g("process_id").alias("process_id"), g("origin").alias("origin"),
    )


def landed(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Envelopes as a stream (value): one file is one JSON document, as a listener puts them down. Cut ones are no JSON and drop out later."""
    return spark.readStream.format("text").schema("value string").option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).load(folder)


def deduplicated(events: DataFrame) -> DataFrame:
    """Events once each. Late ones are never refused, so identities are kept without a watermark."""
    return events.dropDuplicates(["agent", "source_session_id", "event_id"])


def auxiliary_parent(events: DataFrame) -> DataFrame:
    """Auxiliary sessions' events under the latest other session of the same process in the five minutes before."""
    from tracelode.operators.joins import as_of

    main = events.where(F.coalesce("origin", F.lit("")) != "auxiliary").select("process_id", "updated_at", "id")
    helper = events.where(F.col("origin") == "auxiliary")
    found = as_of(helper.where(F.col("process_id").isNotNull()), main.where(F.col("process_id").isNotNull()), ["process_id"], "updated_at", 300, ["id"])
    return found.withColumn("id", F.coalesce("parent_id", "id")).drop("parent_id").unionByName(events.where(F.coalesce("origin", F.lit("")) != "auxiliary"))
