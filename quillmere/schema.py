"""The engine's tables."""

from __future__ import annotations

#: A parsed session, as all connectors return it.
SESSION = (
    "tool string, kind string, path string, native_id string, title string, project string, branch string, model string, started_at timestamp, ended_at timestamp, error string, "
    "messages array<struct<seq:int,role:string,content:string,ts:timestamp,tools:array<string>,snippets:array<struct<language:string,text:string>>>>"
)
CONVERSATIONS = (
    "conversation_id string, content_hash string, session_key string, repo_key string, tool string, kind string, path string, title string, project string, branch string, model string, "
    "started_at timestamp, ended_at timestamp, last_activity timestamp, message_count int, indexed_at timestamp"
)
MESSAGES = "conversation_id string, seq int, role string, content string, ts timestamp, tools array<string>"
EMBEDDINGS = "conversation_id string, seq int, embedding array<float>, model string"
USER_STATE = "session_key string, bookmarked boolean, pinned boolean, note string, tags array<string>"
FORGOTTEN = "session_key string"
THREADS = "thread_id string, title string, goal string, folder string, status string"
MEMBERSHIP = "session_key string, thread_id string"
LINKS = "a string, b string, kind string, origin string, confidence double, applied boolean"
REJECTIONS = "a string, b string"
ROOM_LOG = "id long, room string, author string, device string, origin_seq long, recipient string, text string, human boolean, ts long"
ROOM_AGENTS = "room string, name string, cursor long, seen long"
ROOM_SESSIONS = "room string, name string, path string"
SCANNED = "session_key string"
POSTINGS = "term string, conversation_id string, seq int, tf long, length int, level int, bucket int"
SIZES = "conversation_id string, seq int, length int"
CLAIMS = "room string, holder string, path string, expires long"
TASKS = "room string, id string, title string, owner string, status string, files array<string>, created long, updated long, updated_by string"
NOTES = "note_id string, thread_id string, kind string, text string, created long, updated long, updated_by string"
HOOK_EVENTS = "path string, event string, message string, ts timestamp"
