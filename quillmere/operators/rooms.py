"""Message rooms: unread messages, exchanges and turns, presence, claims, task boards.

``log`` (id, room, author, device, recipient, text, human, ts) is append-only; ``agents`` (room, name, cursor, seen).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ident as I
from ..functions import text as T

EXCHANGE_MOST, UNREAD_MOST, ACTIVE_MINUTES, CLAIM_MINUTES, PLAN_MOST = 500, 20, 30, 20, 25
# States of a task, and the tool that archived exchanges belong to.
TASK_STATUSES = ["todo", "doing", "done", "blocked"]
ROOM_TOOL, TITLE_CHARS = "rooms", 70


def history(log: DataFrame, room: str, n: int) -> DataFrame:
    """The last ``n`` messages of a room, the oldest first."""
    return log.where(F.col("room") == room).orderBy(F.desc("id")).limit(n).orderBy("id")


def page_after(log: DataFrame, room: str, after: int, n: int) -> DataFrame:
    """The first ``n`` messages of a room after an id, the oldest first."""
    return log.where((F.col("room") == room) & (F.col("id") > after)).orderBy("id").limit(n)


def unread(log: DataFrame, agents: DataFrame, device: str | None = None) -> DataFrame:
    """(name, message columns): what stands after each agent's cursor, from others or from another device, to all or to it."""
    a = agents.select("room", F.col("name").alias("reader"), F.coalesce("cursor", F.lit(0)).alias("cursor"))
    here = F.lit(device)
    remote = F.col("device").isNotNull() & ~F.col("device").eqNullSafe(here)
    to_me = F.col("recipient").isNull() | (F.col("recipient") == F.col("reader")) | F.coalesce(F.col("recipient") == F.concat(F.col("reader"), F.lit("@"), here), F.lit(False))
    return log.join(a, "room").where((F.col("id") > F.col("cursor")) & ((F.col("author") != F.col("reader")) | remote) & to_me).drop("cursor")


def last_unread(found: DataFrame, most: int = UNREAD_MOST) -> DataFrame:
    """The last ``most`` of each reader, with the number of those before them."""
    w = Window.partitionBy("room", "reader")
    return found.withColumn("rn", F.row_number().over(w.orderBy(F.desc("id")))).withColumn("skipped", F.greatest(F.count("*").over(w) - most, F.lit(0))).where(F.col("rn") <= most).drop("rn")


def mark_read(agents: DataFrame, log: DataFrame, room: str, name: str) -> DataFrame:
    top = log.where(F.col("room") == room).agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    mine = (F.col("room") == room) & (F.col("name") == name)
    return agents.join(F.broadcast(top)).withColumn("cursor", F.when(mine, F.col("_top")).otherwise(F.col("cursor"))).drop("_top")  # top is one row


#: Ids of a run of messages that one task takes at a time.
RUN = 4096


def exchanges(log: DataFrame, run: int = RUN) -> DataFrame:
    """The log with exchange, its number in the room (a DONE of an agent is the last of its exchange), and turn, the
    number of agents' messages since the last DONE or human message, itself included (0 for a boundary).

    A room is dealt out in runs of ids: within a run by a window, and from run to run go three numbers: how many exchanges
    have ended, whether there was a boundary, and the turns since the last one."""
    rows = log.withColumn("_run", F.floor(F.col("id") / run)).withColumn("_done", ~F.col("human") & T.is_done("text")).withColumn("_edge", F.col("human") | T.is_done("text"))
    key = ["room", "_run"]
    w = Window.partitionBy(*key).orderBy("id")
    rows = rows.withColumn("_ended", F.coalesce(F.sum(F.col("_done").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_part", F.sum(F.col("_edge").cast("int")).over(w))
    rows = rows.withColumn("_turn", F.sum((~F.col("_edge")).cast("int")).over(Window.partitionBy(*key, "_part").orderBy("id")))
    runs = rows.groupBy(*key).agg(F.sum(F.col("_done").cast("int")).alias("ended"), F.max(F.col("_edge").cast("int")).alias("edge"), F.max_by("_turn", "id").alias("last"))
    by_run = Window.partitionBy("room").orderBy("_run")
    runs = runs.withColumn("_before", F.coalesce(F.sum("ended").over(by_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_group", F.sum("edge").over(by_run))
    runs = runs.withColumn("_sum", F.sum("last").over(Window.partitionBy("room", "_group").orderBy("_run")))
    runs = runs.select(*key, "_before", F.coalesce(F.lag("_sum").over(by_run), F.lit(0)).alias("_carry"))
    out = rows.join(runs, key).withColumn("exchange", F.col("_ended") + F.col("_before"))
    return out.withColumn("turn", F.col("_turn") + F.when(F.col("_part") == 0, F.col("_carry")).otherwise(0)).drop("_run", "_done", "_edge", "_ended", "_part", "_turn", "_before", "_carry")


def exchange_of(log: DataFrame, room: str, done_id: int) -> DataFrame:
    """The messages of the exchange that the DONE ``done_id`` ends, the last 500 at most."""
    inside = log.where((F.col("room") == room) & (F.col("id") <= done_id))
    start = inside.where((F.col("id") < done_id) & ~F.col("human") & T.is_done("text")).agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_from"))
    found = inside.join(F.broadcast(start)).where(F.col("id") > F.col("_from")).drop("_from")  # start is one row
    return found.orderBy(F.desc("id")).limit(EXCHANGE_MOST).orderBy("id")


def turns_now(log: DataFrame) -> DataFrame:
    """(room, turns): agents' messages after the last boundary."""
    boundary = F.col("human") | T.is_done("text")
    last = log.groupBy("room").agg(F.coalesce(F.max(F.when(boundary, F.col("id"))), F.lit(-1)).alias("last"))
    return log.join(last, "room").groupBy("room").agg(F.count_if((F.col("id") > F.col("last")) & ~F.col("human")).alias("turns"))


def send_allowed(turns: int, cap: int, text: str) -> tuple[bool, str | None]:
    """Whether a message may be sent at so many turns, and a warning near the cap; DONE always may."""
    if text.strip().upper().startswith("DONE"):
        return True, None
    if turns >= cap:
        return False, f"the exchange has used its {cap} turns: send DONE"
    return True, f"{cap - turns} turns are left" if cap - turns <= 2 else None


def closed(log: DataFrame) -> DataFrame:
    """(room, closed): the latest agent message is a DONE."""
    return log.where("NOT human").groupBy("room").agg(T.is_done(F.max_by("text", "id")).alias("closed"))


def rooms_list(log: DataFrame, agents: DataFrame) -> DataFrame:
    """(room, messages, last), the last active first; rooms that have agents only count too."""
    said = log.groupBy("room").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    there = agents.groupBy("room").agg(F.lit(0).cast("long").alias("n"), F.max("seen").alias("ts"))
    return said.unionByName(there).groupBy("room").agg(F.sum("n").alias("messages"), F.max("ts").alias("last")).orderBy(F.desc("last"), "room")


def presence(log: DataFrame, agents: DataFrame, now: Column, listening: Column | None = None) -> DataFrame:
    """(room, name, seconds, state) of agents seen in the last half hour."""
    spoke = log.where("NOT human").groupBy("room", F.col("author").alias("name")).agg(F.max("ts").alias("spoke"))
    ago = now - F.greatest("seen", F.coalesce("spoke", F.col("seen")))
    state = F.when(listening if listening is not None else F.lit(False), "listening").when(ago < 60, "active").otherwise("spoke")
    return agents.join(spoke, ["room", "name"], "left").withColumn("seconds", ago).where(F.col("seconds") <= ACTIVE_MINUTES * 60).select("room", "name", "seconds", state.alias("state"))


def remote_agents(log: DataFrame, since: int) -> DataFrame:
    return log.where((F.col("ts") >= since) & F.col("device").isNotNull()).groupBy("author", "device").agg(F.max("ts").alias("ts"))


def high_water(log: DataFrame) -> DataFrame:
    return log.groupBy("device").agg(F.coalesce(F.max("origin_seq"), F.lit(0)).alias("origin_seq"))


def receive(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """The log with those incoming messages that it does not hold; each (device, origin_seq) once."""
    new = incoming.dropDuplicates(["device", "origin_seq"]).join(log.select("device", "origin_seq"), ["device", "origin_seq"], "left_anti")
    return log.unionByName(new, allowMissingColumns=True)


def import_log(log: DataFrame, agents: DataFrame, foreign: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with foreign messages of rooms that are not there yet, numbered after its own, and the agents that spoke in them:
    present since their last message, with nothing left to read."""
    new = foreign.join(log.select("room").distinct(), "room", "left_anti")
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = new.join(F.broadcast(top)).withColumn("id", F.col("id") + F.col("_top")).drop("_top")  # top is one row
    last = new.groupBy("room").agg(F.max("id").alias("cursor"))
    spoke = new.where("NOT human").groupBy("room", F.col("author").alias("name")).agg(F.max("ts").alias("seen"))
    there = agents.select("room", "name", "cursor", "seen").unionByName(spoke.join(last, "room").select("room", "name", "cursor", "seen"))
    return log.unionByName(new, allowMissingColumns=True), there.groupBy("room", "name").agg(F.max("cursor").alias("cursor"), F.max("seen").alias("seen"))


def live_claims(claims: DataFrame, now: Column) -> DataFrame:
    return claims.where(F.col("expires") >= now)


def conflicts(claims: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Wanted paths (room, holder, path) with the live claims of others that overlap them.

    Two paths overlap if one is the other or an ancestor of it, so each is matched through its ancestors: two equi-joins
    instead of a comparison of all pairs."""
    ups = lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, "/"))), lambda i: F.array_join(F.slice(F.split(p, "/"), 1, i), "/"))
    c = live_claims(claims, now).select("room", F.col("holder").alias("other"), F.rtrim(F.col("path"), F.lit("/")).alias("claimed"))
    w = wanted.withColumn("path", F.rtrim(F.col("path"), F.lit("/")))
    down = w.withColumn("claimed", F.explode(ups(F.col("path")))).join(c, ["room", "claimed"]).select("room", "holder", "path", "other", "claimed")
    up = c.withColumn("path", F.explode(ups(F.col("claimed")))).join(w, ["room", "path"]).select("room", "holder", "path", "other", "claimed")
    return down.unionByName(up).where("holder <> other").distinct()


def release(claims: DataFrame, room: str, holder: str, path: str | None = None) -> DataFrame:
    mine = (F.col("room") == room) & (F.col("holder") == holder)
    return claims.where(~(mine & (F.col("path") == path) if path else mine))


def merge_tasks(tasks: DataFrame, incoming: DataFrame) -> DataFrame:
    """By (room, id) the version of the largest (updated, updated_by); unknown statuses are not taken in."""
    both = tasks.unionByName(incoming.where(F.col("status").isin(TASK_STATUSES)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("room", "id")]
    return both.groupBy("room", "id").agg(F.max_by(F.struct(*rest), F.struct("updated", "updated_by")).alias("t")).select("room", "id", "t.*")


def plan_tasks(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """At most 25 new tasks join the board, clipped."""
    return tasks.unionByName(new.orderBy("created", "id").limit(PLAN_MOST).withColumn("title", T.clip("title", 200)), allowMissingColumns=True)


def plan_messages(planned: DataFrame, lead: str) -> DataFrame:
    """(room, author, recipient, text): what the owners of planned tasks (room, id, title, owner, files) are told."""
    files = F.when(F.size(F.coalesce("files", F.array().cast("array<string>"))) > 0, F.concat(F.lit("\nFiles: "), F.array_join("files", ", "), F.lit(" (claim them before editing)"))).otherwise("")
    text = F.concat(F.lit("Task "), "id", F.lit(" for you: "), "title", files, F.lit("\nSet its status to doing when you start, and to done or blocked when you end."))
    return planned.where("owner IS NOT NULL AND owner <> ''").select("room", F.lit(lead).alias("author"), F.col("owner").alias("recipient"), text.alias("text"))


def change_task(tasks: DataFrame, task_id: str, me: str, at: int, status: str | None = None, owner: str | None = None) -> DataFrame:
    """The board with a task's status or owner changed; an unknown status is an error."""
    if status is not None and status not in TASK_STATUSES:
        raise ValueError(f"no status: {status}")
    mine = F.col("id") == task_id
    for name, value in (("status", status), ("owner", owner), ("updated", at), ("updated_by", me)):
        tasks = tasks.withColumn(name, F.when(mine, F.lit(value)).otherwise(F.col(name))) if value is not None else tasks
    return tasks


def gather(tasks: DataFrame) -> DataFrame:
    """(room, finished, waiting): by room whether all tasks of a plan are done or blocked, and the others as "id (owner, status)"."""
    left = F.when(F.col("status").isin("todo", "doing"), F.concat("id", F.lit(" ("), F.coalesce(F.nullif("owner", F.lit("")), F.lit("unassigned")), F.lit(", "), "status", F.lit(")")))
    return tasks.groupBy("room").agg(F.array_sort(F.collect_list(left)).alias("waiting")).select("room", (F.size("waiting") == 0).alias("finished"), "waiting")


def board_finished(tasks: DataFrame) -> DataFrame:
    return gather(tasks).select("room", "finished")


def sender(device: str | None) -> Column:
    """Who spoke, named the same way on every device: ``author@device``, the device being this one where none is said."""
    at = F.coalesce(F.col("device"), F.lit(device))
    return F.when(at.isNull(), F.col("author")).otherwise(F.concat("author", F.lit("@"), at))


def archive_exchange(log: DataFrame, device: str | None = None) -> DataFrame:
    """The closed exchanges of a log as conversations: (room, exchange, conversation_id, content_hash, tool, kind, title, path,
    started_at, ended_at, message_count, messages).

    ``log`` has exchange (see :func:`exchanges`).  Of each exchange its last 500 messages count; they are ordered by time, sender
    and id, so that the copies of all devices have one hash."""
    closing = log.where(~F.col("human") & T.is_done("text")).select("room", "exchange").distinct()
    back = F.row_number().over(Window.partitionBy("room", "exchange").orderBy(F.desc("id")))
    rows = log.join(closing, ["room", "exchange"]).withColumn("back", back).where(F.col("back") <= EXCHANGE_MOST)
    to = F.coalesce(F.concat(F.lit(" → "), F.col("recipient")), F.lit(""))
    said = F.struct("ts", sender(device).alias("who"), "id", F.when(F.col("human"), "user").otherwise("assistant").alias("role"), F.concat(sender(device), to, F.lit(": "), F.col("text")).alias("content"))
    out = rows.groupBy("room", "exchange").agg(F.array_sort(F.collect_list(said)).alias("ms"), F.min_by("text", "id").alias("opening"), F.min("id").alias("first"), F.min("ts").alias("from"), F.max("ts").alias("to"))
    out = out.withColumn("content_hash", I.conversation_hash(F.lit(ROOM_TOOL), F.col("ms")))
    messages = F.transform("ms", lambda m, i: F.struct(i.alias("seq"), m["role"].alias("role"), m["content"].alias("content"), F.timestamp_seconds(m["ts"]).alias("ts")))
    return out.select(
        "room", "exchange", I.conversation_id(F.col("content_hash")).alias("conversation_id"), "content_hash", F.lit(ROOM_TOOL).alias("tool"), F.lit("exchange").alias("kind"),
        F.concat("room", F.lit(": "), F.substring("opening", 1, TITLE_CHARS)).alias("title"), F.concat(F.lit("room://"), "room", F.lit("#"), F.col("first").cast("string")).alias("path"),
        F.timestamp_seconds("from").alias("started_at"), F.timestamp_seconds("to").alias("ended_at"), F.size("ms").alias("message_count"), messages.alias("messages"),
    )


def speakers(log: DataFrame, sessions: DataFrame, conversations: DataFrame) -> DataFrame:
    """(name, session_key) of the agents that spoke in ``log`` and whose transcript is known; ``sessions`` (room, name, path)."""
    spoke = log.where("NOT human").select("room", F.col("author").alias("name")).distinct()
    fullest = conversations.where("kind = 'thread'").groupBy("path").agg(F.max_by("session_key", F.struct("message_count", "conversation_id")).alias("session_key"))
    return spoke.join(sessions, ["room", "name"]).join(fullest, "path").select("name", "session_key").distinct().orderBy("name")


def conversed(log: DataFrame) -> DataFrame:
    """(room, a, b) of speakers who answered one another."""
    w = Window.partitionBy("room", "exchange").orderBy("ts", "author", "id")
    nxt = F.lead("author").over(w)
    return log.withColumn("b", nxt).where(F.col("b").isNotNull() & (F.col("b") != F.col("author"))).select("room", F.least("author", "b").alias("a"), F.greatest("author", "b").alias("b")).distinct()


def room_view(log: DataFrame, agents: DataFrame, claims: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row a room with its agents, claims and tasks as arrays."""
    arrays = lambda df, name, *cols: df.groupBy("room").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = rooms_list(log, agents)
    for part in (arrays(agents, "agents", "name", "seen"), arrays(claims, "claims", "path", "holder"), arrays(tasks, "tasks", "created", "id", "title", "status")):
        out = out.join(part, "room", "left")
    return out


def message(log: DataFrame, room: str, author: str, text: str, ts: int, device: str | None = None, recipient: str | None = None, human: bool = False) -> DataFrame:
    """One message more, as a row: its id and its device's sequence number follow the largest of ``log``."""
    seq = F.max(F.when(F.col("device").eqNullSafe(F.lit(device)), F.col("origin_seq")))
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id"), F.coalesce(seq, F.lit(0)).alias("seq"))
    cols = {
        "id": F.col("id") + 1, "room": F.lit(room), "author": F.lit(author), "device": F.lit(device).cast("string"), "origin_seq": F.col("seq") + 1,
        "recipient": F.lit(recipient).cast("string"), "text": F.lit(text), "human": F.lit(human), "ts": F.lit(ts).cast("long"),
    }
    return top.select(*[c.alias(n) for n, c in cols.items()])


def post(log: DataFrame, room: str, author: str, text: str, ts: int, **more) -> DataFrame:
    """The log with one message more."""
    return log.unionByName(message(log, room, author, text, ts, **more))


def touch(agents: DataFrame, room: str, name: str, seen: int) -> DataFrame:
    """Presence: the agent is there, its last time the latest one."""
    new = agents.sparkSession.createDataFrame([(room, name, 0, seen)], "room string, name string, cursor long, seen long")
    both = agents.select("room", "name", "cursor", "seen").unionByName(new)
    return both.groupBy("room", "name").agg(F.max("cursor").alias("cursor"), F.max("seen").alias("seen"))


def claim(claims: DataFrame, room: str, holder: str, path: str, now: int, minutes: int = CLAIM_MINUTES) -> tuple[DataFrame, list[str]]:
    """The claims with this one, extended if it is there already, and no blockers; or unchanged, and who holds what overlaps."""
    want = claims.sparkSession.createDataFrame([(room, holder, path)], "room string, holder string, path string")
    blockers = sorted({r.other for r in conflicts(claims, want, F.lit(now)).select("other").collect()})
    if blockers:
        return claims, blockers
    new = claims.sparkSession.createDataFrame([(room, holder, path, now + minutes * 60)], "room string, holder string, path string, expires long")
    mine = (F.col("room") == room) & (F.col("holder") == holder) & (F.col("path") == path)
    return claims.where(~mine & (F.col("expires") >= now)).unionByName(new), []


def ordered_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy("created", "id")
