"""The engine over a store: what a client asks for, each a method."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .functions import text as T
from .functions import vector as V
from .operators import activity, blocks, ingest, metrics, questions, rooms, search, shared, themes, threads
from .operators.search import Filters
from .plans import context, reports
from .sources.readers import read_sessions
from .store import GRACE, Store
from .streaming.ingest import indexed, ingest_batch, sizes
from .streaming.live import live_states


def hash_embedding(texts: Sequence[str]) -> list[list[float]]:
    """Vectors by hashing the words of each text, repeats included."""
    return [V.hash_vector([w for w in re.split(r"[\W_]+", t.lower()) if w]).tolist() for t in texts]


#: Seconds that another store has to answer: a search is several jobs of Spark, each of which takes its time to start.
PEER_SECONDS = 15.0
#: Texts that a model turns into vectors at a time.
EMBEDDED = 128
#: Rows of a table that say something about a conversation's messages: they go where the conversation goes.
PARTS = ("messages", "embeddings", "postings", "sizes")


class Engine:
    def __init__(
        self, spark: SparkSession, root: str, embed: Callable[[Sequence[str]], list[list[float]]] | None = None, model: str | None = None, load: Callable[[], Callable[[Sequence[str]], list[list[float]]]] | None = None
    ) -> None:
        """``embed`` turns texts into vectors, those that are stored and queries alike (it runs on executors, in batches);
        without it words are hashed.  ``load`` gives such a function instead, where a model is to be loaded: once a worker process.
        Vectors of another ``model`` are not searched but made anew."""
        self.spark, self.store = spark, Store(spark, root)
        self._load, self.model = load or (lambda: embed or hash_embedding), model or ("custom" if embed or load else "hash")
        self._loaded: Callable[[Sequence[str]], list[list[float]]] | None = None
        self._vectors: Callable[..., Column] | None = None
        #: What the last search by words has read of the index.
        self.read = blocks.Read()

    def _embed(self, texts: Sequence[str]) -> list[list[float]]:
        """Vectors of a few texts, on the driver."""
        self._loaded = self._loaded or self._load()
        return self._loaded(texts)

    def _embedded(self, text: Column) -> Column:
        """Vectors of a column of texts, by a model that each worker process loads once, ``EMBEDDED`` texts at a time."""
        if self._vectors is None:
            load = self._load

            def make() -> Callable[[np.ndarray], np.ndarray]:
                model = load()
                return lambda texts: np.asarray(model([str(t) for t in texts]), np.float32)

            self._vectors = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=EMBEDDED)
        return self._vectors(F.coalesce(text, F.lit("")))

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    # ---- ingestion

    def index(self, source: str, folder: str, keys: DataFrame | None = None) -> dict[str, int]:
        """Read a source's files below ``folder`` into the store: new conversations, failures."""
        found = self.store.keep(read_sessions(self.spark, source, folder))
        good = ingest.without_helper_projects(found.where("error IS NULL"))
        sid = F.sha2(F.concat_ws("\u0000", "tool", "path", "native_id"), 256)
        sessions = good.select(sid.alias("session_id"), *[c for c in good.columns if c not in ("messages", "error", "native_id")])
        sessions = sessions.withColumn("last_activity", F.coalesce("ended_at", "started_at")).withColumn("indexed_at", F.current_timestamp())
        sessions = ingest_keys(sessions, keys)
        messages = good.select(sid.alias("session_id"), F.explode("messages").alias("m")).select("session_id", "m.seq", "m.role", "m.content", "m.ts", "m.tools")
        n = ingest_batch(self.store, sessions, messages)
        if n:
            held = self.table("conversations")
            old = self.store.keep(ingest.superseded(self.table("messages"), held))
            if not old.isEmpty():
                self._drop(old)
            self.embed_pending()
        return {"indexed": n, "failed": found.where("error IS NOT NULL").count()}

    def _drop(self, gone: DataFrame) -> None:
        """The conversations of ``gone`` (conversation_id) go, after all that is known of their messages."""
        for name in (*PARTS, "conversations"):
            self.store.delete(name, gone, "conversation_id")

    def embed_pending(self) -> None:
        """Vectors of this engine's model for all messages that have none; those of other models go."""
        held = self.table("embeddings")
        if held.where(F.col("model") != self.model).limit(1).count():
            self.store.replace("embeddings", held.where(F.col("model") == self.model))
        new = ingest.of_kept(ingest.pending_embeddings(self.table("messages"), self.table("embeddings")), self.table("conversations"))
        self.store.append("embeddings", new.select("conversation_id", "seq", self._embedded(F.col("content")).alias("embedding"), F.lit(self.model).alias("model")))

    def forget(self, session_keys: Sequence[str], grace: float = GRACE) -> None:
        """The sessions' conversations with all their messages, vectors and index rows, flags and notes; they will not be taken in again.

        They are no longer found from then on, and leave the disk with the first sweep after ``grace`` seconds: at once, if it is 0 (see
        :meth:`Store.sweep`)."""
        keys = self.spark.createDataFrame([(k,) for k in session_keys], "session_key string")
        kept, gone = ingest.forget(self.table("conversations"), self.table("forgotten"), keys)
        self.store.replace("forgotten", gone)
        self._drop(self.store.keep(self.table("conversations").join(kept.select("conversation_id"), "conversation_id", "left_anti").select("conversation_id")))
        self.store.delete("user_state", keys, "session_key")
        self.store.sweep(grace)

    def sweep(self, grace: float = GRACE) -> int:
        """Free the disk of what was deleted or replaced more than ``grace`` seconds ago; the number of folders removed."""
        return self.store.sweep(grace)

    def flag(self, session_key: str, bookmarked: bool | None = None, pinned: bool | None = None, note: str | None = None, tags: str | None = None) -> None:
        df = self.spark.createDataFrame([(session_key, bookmarked, pinned, note, tags)], "session_key string, bookmarked boolean, pinned boolean, note string, tags string")
        self.store.replace("user_state", ingest.patch(self.table("user_state"), df.withColumn("tags", T.tags("tags")), "session_key"))

    # ---- retrieval

    def hits(self, query: str, mode: str = "hybrid", k: int = 10, filters: Filters | None = None) -> DataFrame:
        """(conversation_id, seq, score).  Words are looked up in the stored index."""
        meta = self.table("conversations").join(self.table("user_state").select("session_key", "tags"), "session_key", "left")
        wanted = meta.where(filters.condition()).select("conversation_id") if filters else None
        depth = k if mode == "lexical" else max(5 * k, 20)

        def words(n: int) -> DataFrame:
            if wanted is not None:  # what is filtered has frequencies of its own
                return search.indexed_search(self.table("postings"), self.table("sizes"), query, n, wanted)
            held, totals = self.store.derived("blocks", blocks.directory), self.store.derived("totals", lambda x: x.agg(F.count("*").alias("n"), F.sum("length").alias("words")))
            if held is None or totals is None:
                return search.indexed_search(self.table("postings"), self.table("sizes"), query, n)
            n_all, n_words = totals.agg(F.sum("n"), F.sum("words")).first()
            found, self.read = blocks.search_blocks(self.table("postings"), held, n_all, (n_words or 0) / max(n_all, 1), query, n)
            return found

        if mode == "lexical":
            return words(depth)
        vectors = self.table("embeddings")
        vectors = vectors.join(wanted, "conversation_id", "left_semi") if wanted is not None else vectors
        near = lambda n: search.semantic_search(vectors, self._embed([query])[0], n)
        return near(k) if mode == "semantic" else search.rrf([words(depth), near(depth)], k)

    def search(self, query: str, mode: str = "hybrid", k: int = 10, filters: Filters | None = None) -> DataFrame:
        hits = self.hits(query, mode, k, filters)
        shown = search.hydrate(hits, self.table("messages"), self.table("conversations").select("conversation_id", "session_key", "title", "tool", "project", "started_at"))
        return shown.withColumn("snippet", search.snippet("content", query)).drop("tools")

    def hits_of_all(self, texts: DataFrame, k: int = 10) -> DataFrame:
        """(question_id, conversation_id, seq, score, rank): the best hits of many questions (question_id, text) in one plan."""
        asked = texts.select("question_id", "text", self._embedded(F.col("text")).alias("embedding"))
        return questions.hybrid_hits(self.table("postings"), self.table("sizes"), self.table("embeddings"), self.store.keep(asked), k)

    def contexts(self, texts: DataFrame, k: int = 3, most: int = context.CONTEXT_CHARS) -> DataFrame:
        """(question_id, text, …): what a model is to be shown for each of many questions (question_id, text)."""
        return questions.contexts(self.hits_of_all(texts, k), self.table("messages"), self.table("conversations"), most)

    def search_devices(
        self, peers: dict[str, Engine], query: str, me: str = "here", mode: str = "hybrid", k: int = 10, filters: Filters | None = None, devices: Sequence[str] | None = None, seconds: float = PEER_SECONDS
    ) -> tuple[DataFrame | None, list[str]]:
        """The best hits of this store and of others', which have ``seconds`` to answer, and which of these could not be searched."""
        asks = {name: (lambda e=e: e.hits(query, mode, max(5 * k, 20), filters)) for name, e in {me: self, **peers}.items()}
        return search.federated_search(asks, k, devices, seconds, own=me)

    def conversation(self, conversation_id: str) -> DataFrame:
        return self.table("messages").where(F.col("conversation_id") == conversation_id).orderBy("seq")

    def context(self, query: str, k: int = 3, most: int = context.CONTEXT_CHARS) -> context.Block:
        hits = self.search(query, k=k).select("conversation_id", "seq", "score")
        return context.context(hits, self.table("messages"), self.table("conversations"), most)

    def ask(self, question: str, k: int = 12, answer: Callable[[str, str], str] | None = None) -> str:
        return context.ask(question, self.search(question, k=k).select("conversation_id", "seq", "score"), self.table("messages"), self.table("conversations"), k, answer)

    def recall(self, query: str, k: int = 5) -> list[str]:
        return context.recall(self.search(query, k=k).select("conversation_id", "seq", "score"), self.table("messages"), self.table("conversations"), query, k)

    def saved(self) -> DataFrame:
        return activity.saved(self.table("user_state"), self.table("conversations"))

    # ---- analytics

    def facets(self) -> dict[str, list[tuple[str, int]]]:
        c = self.table("conversations")
        return {name: [tuple(r) for r in activity.facet(c, name).collect()] for name in ("tool", "project", "kind")}

    def status(self) -> DataFrame:
        return activity.status(self.table("conversations"))

    def activity(self, bucket: str = "day", kind: str | None = "thread") -> DataFrame:
        return activity.activity(self.table("conversations"), bucket, kind)

    def sessions(self, filters: Filters | None = None) -> DataFrame:
        c = activity.longest_version(self.table("conversations")).where("kind = 'thread'")
        c = c.where(filters.of_sessions().condition()) if filters else c
        return c.select(F.col("conversation_id").alias("session_id"), "tool", "project", "model", "started_at", "ended_at")

    def session_metrics(self, filters: Filters | None = None) -> DataFrame:
        s = self.sessions(filters)
        m = self.table("messages").withColumnRenamed("conversation_id", "session_id").join(s.select("session_id"), "session_id", "left_semi")
        return metrics.session_metrics(s, m)

    def metrics(self, filters: Filters | None = None) -> DataFrame:
        return metrics.work_metrics(self.session_metrics(filters))

    def _window(self, now: dt.date, back: int, days: int) -> Filters:
        return Filters(since=(now - dt.timedelta(days=back + days)).isoformat(), until=(now - dt.timedelta(days=back)).isoformat())

    def _windows(self, now: dt.date, days: int) -> tuple[DataFrame, DataFrame]:
        """The metrics of the last ``days`` and of those before: one pass over the messages of both."""
        both = self.store.keep(self.session_metrics(self._window(now, 0, 2 * days)))
        return tuple(metrics.work_metrics(reports.window(both, now, back, days)) for back in (0, days))  # type: ignore[return-value]

    def summary(self, filters: Filters | None = None) -> str:
        per = self.store.keep(self.session_metrics(filters))
        return metrics.summary(metrics.work_metrics(per), per)

    def trends(self, now: dt.date, days: int = reports.WINDOW_DAYS) -> DataFrame:
        return reports.trends(*self._windows(now, days))

    def fluency(self, now: dt.date, days: int = reports.WINDOW_DAYS) -> DataFrame:
        return reports.fluency_report(*self._windows(now, days))

    def weakest(self, now: dt.date) -> DataFrame:
        return reports.weakest(self.fluency(now))

    def unresolved(self, now: dt.date) -> DataFrame:
        return reports.unresolved(self.metrics(self._window(now, 0, reports.STALE_DAYS)))

    def weekly_review(self, now: dt.date, write: Callable[[str], str] | None = None, folder: str | None = None, force: bool = False) -> dict:
        """The week's review, kept for a week; as a file in ``folder``, if one is given."""
        held = self.store.get("weekly")
        week = Filters(since=(now - dt.timedelta(days=reports.STALE_DAYS)).isoformat())
        per = self.store.keep(self.session_metrics(week))
        whole = metrics.work_metrics(per)
        corpus, _ = context.samples(self.table("conversations"), self.table("messages"), 30, 1000, 24_000)
        review = reports.weekly_review(json.loads(held) if held else None, now, whole.first().sessions, metrics.summary(whole, per), corpus, write, force)
        self.store.put("weekly", json.dumps(review))
        if folder:
            path, again = reports.deliver(review, folder, self.store.get("weekly_delivered"), self._put_file)
            self.store.put("weekly_delivered", review["period"])
            review = review | {"path": path, "already_delivered": again}
        return review

    def _put_file(self, path: str, text: str) -> None:
        p, fs = self.store._path(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def insight(self, kind: str, write: Callable[[str], str] | None = None) -> str:
        """What a model makes of the figures and of sessions chosen for ``kind`` (work, gaps, coach, miner, loops); without a
        model, that itself."""
        per = self.store.keep(self.session_metrics())
        c, m = self.table("conversations"), self.table("messages")
        if kind in ("work", "gaps"):
            corpus, _ = context.samples(c, m, 50, 1200, 32_000)
        elif kind == "coach":
            corpus, _ = context.coach_corpus(per, c, m)
        elif kind == "miner":
            corpus, _ = context.miner_corpus(self.themes(12), c, m)
        elif kind == "loops":
            corpus = "\n".join(f"- {r.asked}" for r in context.open_loops(per, m).collect() if r.asked)
        else:
            raise ValueError(f"no kind of insight: {kind}")
        asked = f"{metrics.summary(metrics.work_metrics(per), per)}\n\n{corpus}"
        return write(asked) if write else asked

    def optimise(self, now: dt.date, force: bool = False) -> dict:
        held = self.store.get("optimise")
        current = self.metrics(self._window(now, 0, reports.WINDOW_DAYS))
        lever = reports.top_lever(current).first()
        state = reports.optimise(json.loads(held) if held else None, current.first().asDict(), lever.asDict() if lever else None, now, force)
        self.store.put("optimise", json.dumps(state))
        return state

    def glance(self, now: dt.date) -> DataFrame:
        return reports.glance(self.table("conversations"), now)

    def themes(self, k: int = 8) -> DataFrame:
        vectors = themes.centroids(self.table("embeddings"), "conversation_id")
        items = self.table("conversations").join(vectors, "conversation_id").select(F.col("conversation_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), "tool", "centroid")
        return themes.themes(items, k)

    # ---- threads, rooms, live state

    def threads(self, **filters) -> DataFrame:
        members = threads.threads_of(activity.longest_version(self.table("conversations")), self.table("membership"))
        listed = threads.summarise(members).join(self.table("threads").select("thread_id", F.col("title").alias("given"), "status"), "thread_id", "left")
        return threads.thread_list(listed.withColumn("title", F.coalesce("given", "title")).drop("given"), **filters)

    def _members(self) -> DataFrame:
        """All sessions as they are grouped now: (session_key, thread_id, started_at, …)."""
        return threads.threads_of(activity.longest_version(self.table("conversations")), self.table("membership"))

    def _state(self) -> threads.State:
        return threads.State(self.table("threads"), self.table("membership"), self.table("links"), self.table("rejections"))

    def _set(self, state: threads.State) -> None:
        """All four tables as they were before, then anew: none is read after another has changed."""
        kept = {name: self.store.keep(getattr(state, name)) for name in ("threads", "membership", "links", "rejections")}
        for name, df in kept.items():
            self.store.replace(name, df)

    def detect_links(self) -> int:
        """Links of sessions that have not been looked at before, the oldest first; each is looked at once."""
        c = activity.longest_version(self.table("conversations")).where("kind = 'thread'")
        fresh = self.store.keep(c.join(self.table("scanned"), "session_key", "left_anti"))
        found = self.store.keep(threads.detect_links(fresh, c, self.table("messages"), self.table("links"), self.table("rejections")))
        n = found.count()
        if n:
            self._set(threads.apply_links(self._state(), self.store.keep(self._members()), found, self.store.keep))
        self.store.append("scanned", fresh.select("session_key"))
        return n

    def link(self, a: str, b: str, kind: str = "related") -> None:
        self._set(threads.link_sessions(self._state(), self.store.keep(self._members()), a, b, kind))

    def unlink(self, session_key: str) -> None:
        self._set(threads.unlink_session(self._state(), self.store.keep(self._members()), session_key))

    def reject(self, a: str, b: str) -> None:
        self._set(threads.reject_link(self._state(), a, b))

    def join(self, part: str, into: str) -> None:
        self._set(threads.merge_threads(self._state(), self.store.keep(self._members()), part, into))

    def note(self, note_id: str, thread_id: str, kind: str, text: str, at: int, by: str) -> None:
        self.store.replace("notes", shared.add_note(self.table("notes"), note_id, thread_id, kind, text, at, by))

    def recent_folders(self, n: int = 15) -> DataFrame:
        return activity.recent_folders(self.table("conversations"), n)

    def post(self, room: str, author: str, text: str, ts: int, **more) -> None:
        self.store.append("room_log", rooms.message(self.table("room_log"), room, author, text, ts, **more))

    def send(self, room: str, author: str, text: str, ts: int, cap: int = 0, **more) -> str | None:
        """Post, unless the turns of the exchange are used up: then the reason.  A DONE frees the author's claims and makes the
        exchange a conversation, whose speakers' sessions are linked."""
        done = text.strip().upper().startswith("DONE")
        turns = rooms.turns_now(self.table("room_log")).where(F.col("room") == room).first()
        allowed, note = rooms.send_allowed(turns.turns if turns else 0, cap, text) if cap else (True, None)
        if not allowed:
            return note
        self.post(room, author, text, ts, **more)
        self.store.replace("room_agents", rooms.touch(self.table("room_agents"), room, author, ts))
        if done:
            self.store.replace("claims", rooms.release(self.table("claims"), room, author))
            self.archive(room, more.get("device"))
        return note

    def archive(self, room: str, device: str | None = None) -> int:
        """The closed exchanges of a room that are not yet conversations; how many."""
        log = rooms.exchanges(self.table("room_log").where(F.col("room") == room))
        found = rooms.archive_exchange(log, device).join(self.table("conversations").select("content_hash"), "content_hash", "left_anti")
        found = self.store.keep(found.withColumn("session_key", F.concat(F.lit("sk_"), F.substring(F.sha2("path", 256), 1, 16))))
        n = found.count()
        if n:
            said = found.select("conversation_id", F.inline("messages")).withColumn("tools", F.array().cast("array<string>"))
            self.store.append("messages", said)
            self.store.append("postings", indexed(said))
            self.store.append("sizes", sizes(said))
            self.store.append("conversations", found.drop("room", "exchange", "messages").withColumn("last_activity", F.col("ended_at")).withColumn("indexed_at", F.current_timestamp()))
            self.embed_pending()
            spoke = rooms.speakers(log.join(found.select("exchange"), "exchange", "left_semi"), self.table("room_sessions"), self.table("conversations")).collect()
            for a, b in zip(spoke, spoke[1:], strict=False):
                self.link(a.session_key, b.session_key, "conversed")
        return n

    def bind(self, room: str, name: str, path: str) -> None:
        """Which transcript an agent of a room writes."""
        held = self.table("room_sessions").where((F.col("room") != room) | (F.col("name") != name))
        self.store.replace("room_sessions", held.unionByName(self.spark.createDataFrame([(room, name, path)], held.schema)))

    def history(self, room: str, n: int = 50) -> DataFrame:
        return rooms.history(self.table("room_log"), room, n)

    def claim(self, room: str, holder: str, path: str, now: int) -> list[str]:
        """Who holds what overlaps; nobody, and the claim is made."""
        claims, blockers = rooms.claim(self.table("claims"), room, holder, path, now)
        if not blockers:
            self.store.replace("claims", claims)
        return blockers

    def release(self, room: str, holder: str, path: str | None = None) -> None:
        self.store.replace("claims", rooms.release(self.table("claims"), room, holder, path))

    def plan(self, room: str, lead: str, tasks: Sequence[dict], at: int) -> None:
        """New tasks on the board, and a message to each owner."""
        rows = [(room, t["id"], t["title"], t.get("owner", ""), "todo", list(t.get("files", [])), at, at, lead) for t in tasks]
        new = self.spark.createDataFrame(rows, self.table("tasks").schema)
        self.store.replace("tasks", rooms.plan_tasks(self.table("tasks"), new))
        for r in rooms.plan_messages(new, lead).collect():
            self.post(room, r.author, r.text, at, recipient=r.recipient)

    def task(self, room: str, task_id: str, me: str, at: int, status: str | None = None, owner: str | None = None) -> None:
        """A task moved along, and its lead told."""
        held = self.table("tasks").where(F.col("id") == task_id).first()
        self.store.replace("tasks", rooms.change_task(self.table("tasks"), task_id, me, at, status, owner))
        if held and held.updated_by and held.updated_by != me and status:
            self.post(room, me, f"{task_id} is {status}: {held.title}", at, recipient=held.updated_by)

    def gather(self, room: str) -> DataFrame:
        return rooms.gather(self.table("tasks").where(F.col("room") == room))

    def rooms(self) -> DataFrame:
        return rooms.room_view(self.table("room_log"), self.table("room_agents"), self.table("claims"), self.table("tasks"))

    def unread(self, device: str | None = None) -> DataFrame:
        return rooms.last_unread(rooms.unread(self.table("room_log"), self.table("room_agents"), device))

    def live(self, events: DataFrame, now: dt.datetime) -> DataFrame:
        return live_states(events, F.lit(now))

    def changes(self, since: int) -> tuple[dict[str, DataFrame], int | None]:
        return shared.changes_since({"tasks": self.table("tasks"), "notes": self.table("notes")}, since)


def ingest_keys(sessions: DataFrame, keys: DataFrame | None) -> DataFrame:
    """Sessions with repo_key: from ``keys`` (project, repo_key), else the path of the project."""
    sessions = sessions.withColumn("repo_key", F.lit(None).cast("string"))
    sessions = threads.fill_repo_keys(sessions, keys) if keys is not None else sessions
    return sessions.withColumn("repo_key", F.coalesce("repo_key", F.when(F.col("project") != "", F.concat(F.lit("path:"), "project"))))
