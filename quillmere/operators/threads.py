"""Threads: which sessions are one piece of work.

``sessions`` (session_key, conversation_id, tool, repo_key, branch, started_at, last_activity, title, message_count).
Gap sessionisation is two windows; link detection an equi-join on the repository with a time range, and for the twenty newest
candidates of a session an equi-join on winnowed hashes of what was said; state changes are joins that return new state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ident as I
from ..functions import text as T
from ..functions.winnow import LEAST as WINNOWED
from ..functions.winnow import fingerprints
from ..store import cut
from .components import smallest

GAP_SECONDS = 3 * 3600
# Branches that name no piece of work, kinds of links, and states of threads.
GENERIC_BRANCHES = ["main", "master", "develop", "dev", "trunk", "HEAD", ""]
LINK_KINDS = ["continued", "conversed", "planned", "reviewed", "related"]
STATUSES = ["active", "parked", "done"]
OVERLAP_HOURS, CANDIDATES, FINGERPRINTS, FINGERPRINT_CHARS, LEAST_CHARS = 24, 20, 8, 160, 80
TAIL_MESSAGES, OPENING_MESSAGES, OPENING_BYTES = 200, 60, 400_000
MOST_DAYS = 366
NEAR_MINUTES, RELATED_HOURS, RELATED_MOST = 30, 48, 3
CONTINUED, SUGGESTED = 0.9, 0.5
#: Threads that are looked up at a time.
BLOCK = 1 << 17


def is_feature(branch: Column) -> Column:
    """Whether a branch is a piece of work by itself; case counts."""
    return branch.isNotNull() & ~branch.isin(GENERIC_BRANCHES)


def sessionise(rows: DataFrame, place: str, branch: str | None, start: str, end: str, key: str, gap: int = GAP_SECONDS) -> DataFrame:
    """``rows`` with head, the key of the first session of its group.

    By place and branch, in order of start: a session joins while it starts at most ``gap`` seconds after the latest end
    so far, which a long earlier session may have set.  A feature branch is one group whatever the gaps, its undated sessions
    the last of it; elsewhere an undated session, or one without a place, is alone.

    A place of very many sessions is dealt out by day: each day learns from the days before only the latest end and the
    last head, one row a day, so no task needs all rows of a place."""
    rows = rows.withColumn("_b", F.coalesce(F.col(branch), F.lit("")) if branch else F.lit("")).withColumn("_p", F.col(place).cast("string"))
    loose = F.col(place).isNull() | F.col(start).isNull()
    alone = rows.where(loose)
    if branch:
        # the head of a feature branch is its first dated session, or else the first by key
        first = F.min(F.struct(F.col(start).isNull().alias("_undated"), F.col(start).alias("_start"), F.col(key).alias("_key")))
        heads = rows.where(F.col(place).isNotNull() & is_feature(F.col("_b"))).groupBy("_p", "_b").agg(first["_key"].alias("_head"))
        alone = alone.join(heads, ["_p", "_b"], "left").withColumn("head", F.coalesce("_head", F.col(key))).drop("_head")
    else:
        alone = alone.withColumn("head", F.col(key))
    rest = rows.where(~loose).withColumn("_day", F.floor(F.unix_micros(F.col(start).cast("timestamp")) / 86_400_000_000)).withColumn("_end", F.coalesce(end, start))
    daily = ["_p", "_b", "_day"]
    earlier = Window.partitionBy("_p", "_b").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    ends = rest.groupBy(*daily).agg(F.max("_end").alias("_m")).withColumn("_carry", F.max("_m").over(earlier)).drop("_m")
    w = Window.partitionBy(*daily).orderBy(start, key)
    rest = rest.join(ends, daily)
    before = F.greatest("_carry", F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    late = F.unix_micros(F.col(start).cast("timestamp")) - F.unix_micros(before.cast("timestamp")) > gap * 1_000_000
    breaks = before.isNull() | (late & ~(is_feature(F.col("_b")) if branch else F.lit(False)))
    rest = rest.withColumn("_new", F.when(breaks, F.col(key)))
    heads = rest.groupBy(*daily).agg(F.max_by("_new", F.when(F.col("_new").isNotNull(), F.struct(start, key))).alias("_l")).withColumn("_from", F.last("_l", ignorenulls=True).over(earlier)).drop("_l")
    own = F.last("_new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rest = rest.join(heads, daily).withColumn("head", F.coalesce(own, "_from"))
    extra = ["_b", "_p", "_day", "_end", "_carry", "_new", "_from"]
    return rest.drop(*extra).unionByName(alone.drop(*extra))


def threads_of(sessions: DataFrame, membership: DataFrame | None = None) -> DataFrame:
    """Sessions with thread_id: the explicit one, else that of the group they fall in."""
    found = sessionise(sessions, "repo_key", "branch", "started_at", "last_activity", "session_key")
    # of a feature branch by repository and branch alone, so that all devices agree; else also by the first session
    branch = F.coalesce("branch", F.lit(""))
    auto = F.when(F.col("repo_key").isNull(), I.implicit_id(F.col("session_key"))).when(is_feature(branch), I.work_id(F.col("repo_key"), branch)).otherwise(I.work_id(F.col("repo_key"), branch, F.col("head")))
    found = found.withColumn("auto_id", auto)
    if membership is None:
        return found.withColumn("thread_id", F.col("auto_id")).drop("auto_id")
    m = membership.select("session_key", F.col("thread_id").alias("explicit"))
    return found.join(m, "session_key", "left").withColumn("thread_id", F.coalesce("explicit", "auto_id")).drop("explicit", "auto_id")


def summarise(members: DataFrame) -> DataFrame:
    """One row a thread: first title, repository, tools and branches in order of appearance, messages, first and last activity."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("started_at").isNull().alias("undated"), "started_at", "session_key", "title", "repo_key", "tool", "branch")))
    agg = members.groupBy("thread_id").agg(ordered.alias("s"), F.count("*").alias("sessions"), F.sum("message_count").alias("messages"), F.min("started_at").alias("started_at"), F.max(F.coalesce("last_activity", "started_at")).alias("last_activity"))
    firsts = lambda c: F.get(F.filter(F.transform("s", lambda x: x[c]), lambda v: v.isNotNull() & (v != "")), F.lit(0))
    distinct = lambda c: F.array_distinct(F.filter(F.transform("s", lambda x: x[c]), lambda v: v.isNotNull() & (v != "")))
    return agg.select("thread_id", firsts("title").alias("title"), firsts("repo_key").alias("repo_key"), distinct("tool").alias("tools"), distinct("branch").alias("branches"), "sessions", "messages", "started_at", "last_activity")


def thread_list(summaries: DataFrame, status: str | None = None, tools: list[str] | None = None, repo: str | None = None, limit: int | None = None) -> DataFrame:
    """The newest first, undated ones last."""
    out = summaries
    if status:
        out = out.where(F.coalesce("status", F.lit("active")) == status)
    if tools:
        out = out.where(F.arrays_overlap("tools", F.array(*[F.lit(t) for t in tools])))
    if repo:
        low = F.lit(repo.lower())
        out = out.where(F.contains(F.lower("repo_key"), low) | F.contains(F.lower(T.repo_label("repo_key")), low))
    out = out.orderBy(F.desc_nulls_last("last_activity"), F.desc("thread_id"))
    return out.limit(limit) if limit else out


# ---- links


def pair(a: Column, b: Column) -> Column:
    """An unordered pair as one value."""
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def link_candidates(fresh: DataFrame, sessions: DataFrame, links: DataFrame | None = None, rejections: DataFrame | None = None) -> DataFrame:
    """(later, earlier, …) of the twenty newest sessions of the same repository that were warm when ``later`` began;
    neither linked nor rejected pairs."""
    later = fresh.where("repo_key IS NOT NULL AND started_at IS NOT NULL").select("repo_key", F.col("session_key").alias("later"), F.col("conversation_id").alias("later_conversation"), F.col("started_at").alias("began"), F.col("tool").alias("later_tool"))
    last = F.coalesce("last_activity", "started_at")
    earlier = sessions.where("repo_key IS NOT NULL AND started_at IS NOT NULL").select(
        "repo_key", F.col("session_key").alias("earlier"), F.col("conversation_id").alias("earlier_conversation"), F.col("started_at").alias("start_e"), last.alias("last_e"), F.col("tool").alias("earlier_tool")
    )
    # a day's bucket besides the repository keeps the sessions of a busy repository apart; a session is warm on each
    # day from its start to a day after its end, those that go on for very long, by a wrong date, in each whole repository
    until = F.date_add(F.to_date(F.greatest("start_e", "last_e")), 1 + OVERLAP_HOURS // 24)
    long = F.date_diff(until, F.to_date("start_e")) > MOST_DAYS
    daily = earlier.where(~long).withColumn("day", F.explode(F.sequence(F.to_date("start_e"), until)))
    found = later.withColumn("day", F.to_date("began")).join(daily, ["repo_key", "day"]).drop("day")
    found = found.unionByName(later.join(earlier.where(long), "repo_key"))
    found = found.where((F.col("earlier") != F.col("later")) & (F.col("start_e") <= F.col("began")) & (F.unix_timestamp("began") <= F.unix_timestamp("last_e") + OVERLAP_HOURS * 3600))
    w = Window.partitionBy("later").orderBy(F.desc("start_e"), "earlier")
    found = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= CANDIDATES)
    for known in (links, rejections):
        if known is not None:
            gone = known.select(pair(F.col("a"), F.col("b")).alias("p")).distinct()
            found = found.withColumn("p", pair(F.col("earlier"), F.col("later"))).join(gone, "p", "left_anti").drop("p")
    return found


def tail_fingerprints(candidates: DataFrame, messages: DataFrame) -> DataFrame:
    """(later, earlier, place, print, by_assistant): what opens the last substantial messages of ``earlier``, as of then, numbered."""
    said = messages.where("seq > 0 AND role IN ('user', 'assistant')").withColumn("back", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("seq")))).where(F.col("back") <= TAIL_MESSAGES)
    said = said.select(F.col("conversation_id").alias("earlier_conversation"), "seq", (F.col("role") == "assistant").alias("by_assistant"), T.normalize("content").alias("norm"), "ts").where(F.length("norm") >= LEAST_CHARS)
    found = candidates.join(said, "earlier_conversation").where(F.col("ts").isNull() | (F.unix_timestamp("ts") <= F.unix_timestamp("began") + 60))
    w = Window.partitionBy("later", "earlier").orderBy(F.desc("seq"))
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= FINGERPRINTS).select("later", "later_conversation", "earlier", F.col("rn").alias("place"), F.substring("norm", 1, FINGERPRINT_CHARS).alias("print"), "by_assistant")


def opening_text(messages: DataFrame) -> DataFrame:
    """(conversation_id, opening): its first messages, normalised, until the byte budget is met."""
    w = Window.partitionBy("conversation_id").orderBy("seq")
    m = messages.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= OPENING_MESSAGES).withColumn("norm", T.normalize(F.coalesce("content", F.lit(""))))
    m = m.withColumn("used", F.coalesce(F.sum(F.octet_length("norm") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("used") < OPENING_BYTES)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "norm"))), lambda x: x["norm"]), "\n")
    return m.groupBy("conversation_id").agg(text.alias("opening"))


def contained(prints: DataFrame, openings: DataFrame) -> DataFrame:
    """Those of ``prints`` (later, later_conversation, earlier, place, print) that stand in the opening of their later conversation.

    A print has ``LEAST_CHARS`` characters at least, so its first winnowed hash is among those of any text that holds it: the two meet in an
    equi-join, at a place, and there the print itself is compared.  A text is joined once with all that met in it."""
    if LEAST_CHARS < WINNOWED:
        raise ValueError("prints are shorter than what is surely found")
    index = openings.select("later_conversation", F.inline(fingerprints("opening"))).withColumnRenamed("at", "there")
    own = prints.withColumn("own", F.get(fingerprints(F.substring("print", 1, WINNOWED)), F.lit(0)))
    met = own.withColumn("h", F.col("own.h")).join(index, ["later_conversation", "h"]).withColumn("start", F.col("there") - F.col("own.at")).where("start >= 0")
    met = met.groupBy("later_conversation").agg(F.collect_set(F.struct("later", "earlier", "place", "print", "start")).alias("met"))
    same = F.filter("met", lambda m: F.col("opening").substr(m["start"] + 1, F.length(m["print"])) == m["print"])
    return met.join(openings, "later_conversation").select(F.explode(F.array_distinct(F.transform(same, lambda m: F.struct(m["later"].alias("later"), m["earlier"].alias("earlier"), m["place"].alias("place"))))).alias("m")).select("m.*")


def detect_links(fresh: DataFrame, sessions: DataFrame, messages: DataFrame, links: DataFrame | None = None, rejections: DataFrame | None = None) -> DataFrame:
    """(later, earlier, kind, confidence, applied): at most one a later session.

    Applied at 0.9 where three fingerprints or more exist and two and half of them, one of the assistant's among them,
    stand in the later opening; else suggested at 0.5 to the newest session of another tool that went quiet 30 minutes
    before at most."""
    found = link_candidates(fresh, sessions, links, rejections)
    prints = tail_fingerprints(found, messages)
    openings = opening_text(messages.join(fresh.select("conversation_id"), "conversation_id", "left_semi")).withColumnRenamed("conversation_id", "later_conversation")
    hits = contained(prints, openings).select("later", "earlier", "place", F.lit(True).alias("hit"))
    judged = prints.join(hits, ["later", "earlier", "place"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    copied = judged.groupBy("later", "earlier").agg(F.count("*").alias("prints"), F.count_if("hit").alias("hits"), F.max(F.col("hit") & F.col("by_assistant")).alias("own"))
    copied = copied.where("prints >= 3 AND hits >= 2 AND hits * 2 >= prints AND own").select("later", "earlier", F.lit(True).alias("copied"))
    judged = found.join(copied, ["later", "earlier"], "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    near = (F.col("earlier_tool") != F.col("later_tool")) & (F.unix_timestamp("began") <= F.unix_timestamp("last_e") + NEAR_MINUTES * 60)
    w = Window.partitionBy("later").orderBy(F.desc("copied"), "place")
    best = judged.where(F.col("copied") | near).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return best.select("later", "earlier", F.lit("continued").alias("kind"), F.when(F.col("copied"), CONTINUED).otherwise(SUGGESTED).alias("confidence"), F.col("copied").alias("applied"))


def pending_suggestions(links: DataFrame, membership: DataFrame) -> DataFrame:
    """(thread_id, pending): suggested links with an end in the thread."""
    ends = links.where("NOT applied").select(pair(F.col("a"), F.col("b")).alias("p"), F.explode(F.array("a", "b")).alias("session_key"))
    return ends.join(membership, "session_key").groupBy("thread_id").agg(F.count_distinct("p").alias("pending"))


def links_of_thread(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links with an end among ``members`` (session_key), and whether both are."""
    a, b = members.select(F.col("session_key").alias("a"), F.lit(True).alias("has_a")), members.select(F.col("session_key").alias("b"), F.lit(True).alias("has_b"))
    out = links.join(a, "a", "left").join(b, "b", "left").where("has_a OR has_b")
    return out.withColumn("inside", F.coalesce(F.col("has_a") & F.col("has_b"), F.lit(False))).drop("has_a", "has_b")


def _nearest(rows: pa.Table) -> pa.Table:
    """(repo_key, branch, _set, _at, other, apart): for each own (_set, _at) of ``rows``, all of a repository, branch and stretch of time, the closest
    others on disjoint devices, one more than is wanted, since a thread without devices is among its own.

    Of each set of devices the next in time on either side are looked up in order; a set is met by all at once."""
    rows, most = rows.combine_chunks(), RELATED_MOST + 1
    known: dict[tuple, int] = {}
    of = np.array([known.setdefault(tuple(x), len(known)) for x in rows.column("_set").to_pylist()])
    devices = {d: i for i, d in enumerate(sorted({d for x in known for d in x if d is not None}))}
    has = np.zeros((len(known), len(devices)), np.float32)
    for x, i in known.items():
        has[i, [devices[d] for d in x if d is not None]] = 1
    none, unknown = np.array([not x for x in known]), np.array([None in x for x in known])  # what cannot be told is not disjoint
    at, own = rows.column("_at").to_numpy().astype(np.int64), rows.column("own").to_numpy(zero_copy_only=False)
    by_id = pa.compute.sort_indices(rows.column("other")).to_numpy()
    rank = np.empty(len(rows), np.int64)
    rank[by_id] = np.arange(len(rows))
    asking = np.flatnonzero(own)
    asking = asking[np.unique(np.stack([of[asking], at[asking]]), axis=1, return_index=True)[1]]
    far, shift = np.iinfo(np.int64).max, 1 << 40
    best = np.full((len(asking), most), far)
    for i in range(len(known)):
        fits = (has @ has[i] == 0) & (none | none[i] | ~(unknown | unknown[i]))
        mine, q = np.flatnonzero(of == i), np.flatnonzero(fits[of[asking]])
        for way in (1, -1):
            there = mine[np.lexsort((rank[mine], way * at[mine]))]
            times = way * at[there]
            for low in range(0, len(q), BLOCK):
                some = q[low : low + BLOCK]
                now = way * at[asking[some]]
                place = np.searchsorted(times, now, "left" if way == 1 else "right")[:, None] + np.arange(most)
                row = np.minimum(place, len(there) - 1)
                apart = times[row] - now[:, None]
                found = np.where((place < len(there)) & (apart <= RELATED_HOURS * 3600), apart * shift + rank[there[row]], far)
                best[some] = np.sort(np.concatenate([best[some], found], axis=1), axis=1)[:, :most]
    q, n = np.nonzero(best < far)
    mine, other = pa.array(asking[q]), pa.array(by_id[best[q, n] % shift])
    return pa.table({**{c: rows.column(c).take(mine) for c in ("repo_key", "branch", "_set", "_at")}, "other": rows.column("other").take(other), "apart": pa.array(best[q, n] // shift, pa.int64())})


def related(summaries: DataFrame) -> DataFrame:
    """(thread_id, other) threads of one repository and feature branch on disjoint devices within 48 hours, the three
    closest; ``summaries`` has devices (array), branch, last_activity, status.

    Threads of the same devices and second have the same answer and are asked for once; of these only the first few can be one.  A branch is dealt
    out by stretches of 48 hours, each with the others of the two beside it, and in these the closest are looked up in order: no pairs are made."""
    live = summaries.where(is_feature(F.col("branch")) & (F.coalesce("status", F.lit("active")) != "done") & F.col("repo_key").isNotNull() & F.col("last_activity").isNotNull() & F.col("devices").isNotNull())
    live = live.select("thread_id", "repo_key", "branch", F.array_sort(F.array_distinct("devices")).alias("_set"), F.unix_timestamp("last_activity").alias("_at"))
    same = ["repo_key", "branch", "_set", "_at"]
    firsts = live.withColumn("rn", F.row_number().over(Window.partitionBy(*same).orderBy("thread_id"))).where(F.col("rn") <= RELATED_MOST + 1)
    stretch = F.floor(F.col("_at") / (RELATED_HOURS * 3600))
    dealt = firsts.select(*same, F.col("thread_id").alias("other"), stretch.alias("_mine"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("_stretch"))
    dealt = dealt.select(*same, "other", "_stretch", (F.col("_mine") == F.col("_stretch")).alias("own"))
    types = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    near = dealt.groupBy("repo_key", "branch", "_stretch").applyInArrow(_nearest, ", ".join([*(f"{c} {types[c]}" for c in [*same, "other"]), "apart bigint"]))
    found = live.join(near, same).where(F.col("thread_id") != F.col("other"))
    w = Window.partitionBy("thread_id").orderBy("apart", "other")
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= RELATED_MOST).select("thread_id", "other", "apart")


# ---- state: functions from state to state


@dataclass(frozen=True)
class State:
    """The tables that say which sessions belong together."""

    threads: DataFrame  # thread_id, title, goal, folder, status
    membership: DataFrame  # session_key, thread_id
    links: DataFrame  # a, b, kind, origin, confidence, applied
    rejections: DataFrame  # a, b

    def thread_of(self, members: DataFrame, session_key: str) -> str:
        """The thread a session is in now: the one it was put in, else that of its group, else its own."""
        held = self.membership.where(F.col("session_key") == session_key).first() or members.where(F.col("session_key") == session_key).select("session_key", "thread_id").first()
        return held.thread_id if held else own_thread(session_key)


def own_thread(session_key: str) -> str:
    """The id of the thread that a session forms by itself."""
    return "th_" + session_key.removeprefix("sk_")


def _between(a: str, b: str) -> Column:
    low, high = sorted((a, b))
    return (F.least("a", "b") == low) & (F.greatest("a", "b") == high)


def ordered_pair(members: DataFrame, a: str, b: str) -> tuple[str, str]:
    """The session that started first, then the other; undated ones last, ties by key."""
    started = {r.session_key: r.started_at for r in members.where(F.col("session_key").isin(a, b)).groupBy("session_key").agg(F.min("started_at").alias("started_at")).collect()}
    first, second = sorted((a, b), key=lambda k: (started.get(k) is None, started.get(k) or 0, k))
    return first, second


def fill_repo_keys(conversations: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (project, repo_key) where none is known."""
    k = keys.select("project", F.col("repo_key").alias("_k"))
    return conversations.join(k, "project", "left").withColumn("repo_key", F.coalesce("repo_key", "_k")).drop("_k")


def materialise(state: State, members: DataFrame, session_key: str) -> tuple[State, str]:
    """The session's thread with a row of its own, and the session as its member."""
    thread = state.thread_of(members, session_key)
    held = state.threads.where(F.col("thread_id") == thread).limit(1).count()
    threads = state.threads if held else create_thread(state.threads, thread, None, None, None)
    return replace(state, threads=threads, membership=attach(state.membership, session_key, thread)), thread


def merge_sessions(state: State, members: DataFrame, earlier: str, later: str) -> tuple[State, str]:
    """Both sessions in the thread of the earlier one.  Where the later one had been put in a thread, all of that moves, and its
    title too, if the kept thread has none."""
    state, keep = materialise(state, members, earlier)
    put = state.membership.where(F.col("session_key") == later).first()
    if put is None:
        return replace(state, membership=attach(state.membership, later, keep)), keep
    return (state if put.thread_id == keep else _absorbed(state, keep, put.thread_id)), keep


def _absorbed(state: State, keep: str, gone: str) -> State:
    title = state.threads.where(F.col("thread_id") == gone).select(F.max("title").alias("_title"))
    mine = F.col("thread_id") == keep
    threads = state.threads.where(F.col("thread_id") != gone).join(F.broadcast(title))  # title is one row
    threads = threads.withColumn("title", F.when(mine, F.coalesce("title", "_title")).otherwise(F.col("title"))).drop("_title")
    return replace(state, threads=threads, membership=merge_members(state.membership, keep, gone))


def merge_members(membership: DataFrame, into: str, other: str) -> DataFrame:
    return membership.withColumn("thread_id", F.when(F.col("thread_id") == other, into).otherwise(F.col("thread_id")))


def merge_threads(state: State, members: DataFrame, part: str, into: str) -> State:
    """All sessions of ``part`` (``members``: session_key, thread_id) belong to ``into``, which keeps its id and its title, if it
    has one."""
    if part == into:
        return state
    if not state.threads.where(F.col("thread_id") == into).limit(1).count():
        state = replace(state, threads=create_thread(state.threads, into, None, None, None))
    moved = members.where(F.col("thread_id") == part).select("session_key", F.lit(into).alias("thread_id"))
    rest = state.membership.join(moved.select("session_key"), "session_key", "left_anti")
    return _absorbed(replace(state, membership=rest.unionByName(moved)), into, part)


def put_link(state: State, members: DataFrame, a: str, b: str, kind: str, origin: str, confidence: float, applied: bool) -> State:
    """The link, from the earlier session to the later, instead of any between the two; an applied one merges their threads."""
    if kind not in LINK_KINDS:
        raise ValueError(f"no kind of link: {kind}")
    first, second = ordered_pair(members, a, b)
    new = state.links.sparkSession.createDataFrame([(first, second, kind, origin, confidence, applied)], state.links.schema)
    state = replace(state, links=state.links.where(~_between(a, b)).unionByName(new))
    return merge_sessions(state, members, first, second)[0] if applied else state


def link_sessions(state: State, members: DataFrame, a: str, b: str, kind: str = "related", origin: str = "explicit") -> State:
    """The link on purpose: it holds whatever was rejected before.  A session has no link to itself."""
    if a == b:
        return state
    return put_link(replace(state, rejections=state.rejections.where(~_between(a, b))), members, a, b, kind, origin, 1.0, True)


def apply_links(state: State, members: DataFrame, found: DataFrame, keep_rows: Callable[[DataFrame], DataFrame] = cut) -> State:
    """The links of :func:`detect_links` at once, and for each applied one the threads of its sessions merged into one.

    ``members`` (session_key, thread_id, started_at): all sessions as they are.  Threads that links chain together are found in rounds
    that grow with the logarithm of the longest chain; ``keep_rows`` materialises what a round made.  The thread of the earliest
    session keeps its id."""
    new = found.select(F.col("earlier").alias("a"), F.col("later").alias("b"), "kind", F.lit("detected").alias("origin"), "confidence", "applied")
    state = replace(state, links=state.links.unionByName(new))
    of = members.groupBy("session_key").agg(F.min("thread_id").alias("thread_id"))
    began = members.groupBy("thread_id").agg(F.min(F.struct(F.col("started_at").isNull().alias("undated"), "started_at", F.col("thread_id").alias("thread"))).alias("began"))
    ends = new.where("applied").join(of.withColumnsRenamed({"session_key": "a", "thread_id": "u"}), "a").join(of.withColumnsRenamed({"session_key": "b", "thread_id": "v"}), "b").where("u <> v").select("u", "v")
    chains = smallest(ends, keep_rows).join(began.withColumnRenamed("thread_id", "node"), "node")
    first = chains.groupBy("root").agg(F.min("began").alias("began"))
    label = keep_rows(chains.drop("began").join(first, "root").select(F.col("node").alias("thread_id"), "began"))
    keep = label.select("thread_id", F.col("began.thread").alias("keep")).where("thread_id <> keep")
    moved = members.join(label.select("thread_id", F.col("began.thread").alias("keep")), "thread_id").select("session_key", F.col("keep").alias("thread_id")).distinct()
    rows = label.select(F.col("began.thread").alias("thread_id")).distinct().join(state.threads.select("thread_id"), "thread_id", "left_anti").withColumn("status", F.lit("active"))
    titles = keep.join(state.threads.select("thread_id", "title"), "thread_id").groupBy("keep").agg(F.min("title").alias("_title")).withColumnRenamed("keep", "thread_id")
    threads = state.threads.join(keep.select("thread_id"), "thread_id", "left_anti").unionByName(rows, allowMissingColumns=True).join(titles, "thread_id", "left").withColumn("title", F.coalesce("title", "_title")).drop("_title")
    rest = state.membership.join(moved.select("session_key"), "session_key", "left_anti")
    return replace(state, threads=threads, membership=rest.unionByName(moved))


def reject_link(state: State, a: str, b: str) -> State:
    """A suggested link goes and is not made again; an applied one stays (see :func:`unlink_session`)."""
    low, high = sorted((a, b))
    new = state.links.sparkSession.createDataFrame([(low, high)], "a string, b string")
    return replace(state, links=state.links.where(F.col("applied") | ~_between(a, b)), rejections=state.rejections.unionByName(new).distinct())


def attach(membership: DataFrame, session_key: str, thread_id: str) -> DataFrame:
    new = membership.sparkSession.createDataFrame([(session_key, thread_id)], "session_key string, thread_id string")
    return membership.where(F.col("session_key") != session_key).unionByName(new)


def unlink_session(state: State, members: DataFrame, session_key: str) -> State:
    """The session in a thread of its own, where it stays; ``members`` (session_key, thread_id, started_at): all as they are.

    Its applied links go, detected ones are remembered as rejected.  What is left of its thread is dissolved, if that is one
    plain session or none, and renamed after its first session, if it bore the name of the one that left."""
    thread, own = state.thread_of(members, session_key), own_thread(session_key)
    rest = members.where((F.col("thread_id") == thread) & (F.col("session_key") != session_key)).groupBy("session_key").agg(F.min("started_at").alias("started_at"))
    rest = rest.orderBy(F.asc_nulls_last("started_at"), "session_key").limit(2).collect()
    if not rest:
        return state
    if not state.membership.where(F.col("session_key") == session_key).limit(1).count():
        return replace(state, membership=attach(state.membership, session_key, own))
    touching = F.col("applied") & ((F.col("a") == session_key) | (F.col("b") == session_key))
    refused = state.links.where(touching & (F.col("origin") == "detected")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    state = replace(state, links=state.links.where(~touching), rejections=state.rejections.unionByName(refused).distinct(), membership=state.membership.where(F.col("session_key") != session_key))
    put = [r.session_key for r in state.membership.where(F.col("thread_id") == thread).select("session_key").limit(2).collect()]
    held = state.threads.where(F.col("thread_id") == thread).first()
    plain = held is None or (not held.title and held.status == "active")
    if not put or len(put) == 1 and plain:
        state = replace(state, membership=state.membership.where(F.col("thread_id") != thread), threads=state.threads.where(F.col("thread_id") != thread))
    elif thread == own:
        renamed = F.when(F.col("thread_id") == thread, own_thread(rest[0].session_key)).otherwise(F.col("thread_id"))
        state = replace(state, membership=state.membership.withColumn("thread_id", renamed), threads=state.threads.withColumn("thread_id", renamed))
    return replace(state, membership=attach(state.membership, session_key, own))


def set_status(threads: DataFrame, thread_id: str, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"no status: {status}")
    return threads.withColumn("status", F.when(F.col("thread_id") == thread_id, status).otherwise(F.col("status")))


def set_title(threads: DataFrame, thread_id: str, title: str) -> DataFrame:
    """An empty title brings the derived one back."""
    return threads.withColumn("title", F.when(F.col("thread_id") == thread_id, F.lit(title.strip() or None).cast("string")).otherwise(F.col("title")))


def create_thread(threads: DataFrame, thread_id: str, title: str | None, goal: str | None, folder: str | None) -> DataFrame:
    """A thread with a row of its own; a planned one waits for sessions."""
    new = threads.sparkSession.createDataFrame([(thread_id, title, goal, folder, "active")], "thread_id string, title string, goal string, folder string, status string")
    return threads.where(F.col("thread_id") != thread_id).unionByName(new, allowMissingColumns=True)


def origin(threads: DataFrame) -> DataFrame:
    """(thread_id, folder, goal) of the threads that were planned in a folder."""
    return threads.where("folder IS NOT NULL").select("thread_id", "folder", "goal")


def served_threads(members: DataFrame, hidden_tools: list[str], hidden_projects: list[str]) -> DataFrame:
    """Threads all of whose sessions a peer may see."""
    bad = F.col("tool").isin(hidden_tools) if hidden_tools else F.lit(False)
    for p in hidden_projects:
        bad = bad | F.contains(F.coalesce("project", F.lit("")), F.lit(p))
    return members.groupBy("thread_id").agg(F.max(F.coalesce(bad, F.lit(False))).alias("bad")).where("NOT bad").select("thread_id")
