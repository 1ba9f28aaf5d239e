"""Named tools over the operators: registry, guarded dispatch and the nine built-in tools."""

from __future__ import annotations

import inspect
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vocab as V
from millrace.functions.regex import checked_pattern
from millrace.operators import fold, grading, ledger, merge, readback, recall, tasks
from millrace.sources.store import Store


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: dict[str, Any]
    call: Callable[..., str]
    read_only: bool = True
    requires_confirm: bool = False
    internal: bool = False

    def schema(self) -> dict[str, Any]:
        """The tool as a function schema for a model."""
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": self.parameters}}


@dataclass
class Registry:
    """Tools by name. ``dispatch`` never raises: errors come back as text.

    A hook that raises does not stop a call that it only watches (``on_dispatch``);
    one that decides (``guard``, ``confirm``, ``enabled``) decides against it.
    """

    tools: dict[str, Tool] = field(default_factory=dict)
    enabled: Callable[[str], bool] = lambda name: True
    on_dispatch: Callable[[str, dict], None] | None = None
    guard: Callable[[Tool, dict], str | None] | None = None
    confirm: Callable[[Tool, dict], bool] | None = None

    def tool(self, name: str, description: str = "", parameters: dict | None = None, **flags: bool):
        """Register a function as a tool."""

        def register(f: Callable[..., str]) -> Callable[..., str]:
            self.tools[name] = Tool(name, description or (f.__doc__ or ""), parameters or {"type": "object", "properties": {}}, f, **flags)
            return f

        return register

    def _is_enabled(self, name: str) -> bool:
        try:
            return bool(self.enabled(name))
        except Exception:
            return False

    def names(self, internal: bool = False) -> list[str]:
        return [n for n, t in self.tools.items() if self._is_enabled(n) and (internal or not t.internal)]

    def schemas(self) -> list[dict[str, Any]]:
        return [self.tools[n].schema() for n in self.names()]

    def get(self, name: str) -> Tool | None:
        return self.tools.get(name)

    def specs(self, read_only: bool | None = None) -> list[Tool]:
        """All tools, or those that only read, or those that write; internal and disabled ones too."""
        return [t for t in self.tools.values() if read_only is None or t.read_only == read_only]

    def dispatch(self, name: str, arguments: dict[str, Any]) -> str:
        """Hook, lookup, guard, confirmation, argument check and call, in this order.

        Arguments whose names begin with ``_`` are marks of a parser and reach
        neither hooks that decide nor the tool.
        """
        if self.on_dispatch:
            try:
                self.on_dispatch(name, arguments)
            except Exception:
                pass  # it only watches
        tool = self.tools.get(name)
        if tool is None:
            return f"ERROR: no tool {name!r}; there are {', '.join(self.names())}"
        if not self._is_enabled(name):
            return f"ERROR: {name} is off here" + ("; go on without it" if tool.internal else "; only the user can turn it on, so ask them to")
        arguments = {k: v for k, v in arguments.items() if not k.startswith("_")}
        try:
            refusal = self.guard(tool, arguments) if self.guard else None
        except Exception as broken:
            refusal = f"the guard failed ({_first_line(broken)})"
        if refusal:
            return f"BLOCKED: {refusal}"
        if tool.requires_confirm:
            try:
                agreed = bool(self.confirm and self.confirm(tool, arguments))
            except Exception:
                agreed = False
            if not agreed:
                return f"DENIED: {name} was not confirmed"
        try:
            inspect.signature(tool.call).bind(**arguments)
        except TypeError as wrong:
            return f"ERROR: {name}: {wrong}"
        try:
            return str(tool.call(**arguments))
        except Exception as failed:
            return f"ERROR: {name}: {_first_line(failed)}"


def _first_line(error: Exception) -> str:
    return str(error).splitlines()[0] if str(error) else type(error).__name__


def within(spark, seconds: float, work: Callable[[], Any]) -> Any:
    """the result of ``work``; Spark jobs that it still runs after so many seconds are cancelled, which raises TimeoutError."""
    group = f"millrace-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    spark.sparkContext.setJobGroup(group, "bounded read", interruptOnCancel=True)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return work()
    except Exception as failed:
        if late.is_set():
            raise TimeoutError(f"stopped after {seconds:g} s; use a simpler pattern") from failed
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


class Session:
    """One run over a store: its marks, its grants and its tally of read-back calls.

    ``run_id`` names a live turn; without one, writes are the machine's own and
    nothing is planted. ``grants`` are the handles that it may read (None: all).
    """

    def __init__(self, store: Store, run_id: str | None = None, branch: str = "main", grants: set[str] | None = None):
        self.store, self.run_id, self.branch, self.grants = store, run_id, branch, grants
        self.pages = self.misses = 0
        self.reading = True
        self._walks: dict[str, list[int]] = {}  # handle -> pages seen, furthest line, pages lost, losses told

    def lineage(self) -> str:
        return f"model/{self.branch}/d0" if self.run_id else "machine/scan/scan"

    def plant(self, fact_id: int) -> None:
        if self.run_id:
            row = [(self.run_id, "planted", fact_id, None)]
            self.store.append("marks", self.store.spark.createDataFrame(row, "run_id string, kind string, fact_id long, term string"))

    def lost(self, handle: str) -> None:
        """A page of the handle was collapsed out of the conversation."""
        self._walks.setdefault(handle, [0, 0, 0, 0])[2] += 1

    def walk(self, handle: str, last: int | None = None) -> tuple[int, int, int]:
        """(seen, reached, newly lost) for the page that is asked for now; with ``last`` the page has been read that far."""
        w = self._walks.setdefault(handle, [0, 0, 0, 0])
        if last is not None:
            w[1] = max(w[1], last)
            return w[0], w[1], 0
        w[0] += 1
        self.pages += 1
        new = w[2] if w[2] > w[3] else 0
        w[3] = w[2]
        return w[0], w[1], new

    def finish(self, outcome: str = "ok", request: str = "", summary: str = "", tools: str = "") -> None:
        """Grade what the run was served and planted; ``stopped`` drops its marks without a grade.

        With its ``request`` the turn becomes an episode, and the shortcuts that the
        request covers are tallied as used.
        """
        if not self.run_id:
            return
        spark, store = self.store.spark, self.store
        if request and outcome != "stopped":
            turn = [((store.table("episodes").agg(F.max("id")).first()[0] or 0) + 1, request, summary, tools, outcome)]
            rows = spark.createDataFrame(turn, "id long, request string, summary string, tools string, outcome string").withColumn("ts", F.current_timestamp())
            store.append("episodes", tasks.episode_rows(rows))
            if store.settings.reinforce:
                asked, members = tasks.request_classes(spark.createDataFrame([(0, request)], "query_id long, text string"))
                known = tasks.pattern_classes(store.patterns())
                fired = known.join(tasks.covered_classes(asked, known), "pcls", "left_semi").select("key")
                store.append("pattern_uses", fired.select("key", F.lit(outcome).alias("outcome"), F.current_timestamp().alias("ts")))
        seq = (store.table("outcomes").agg(F.max("seq")).first()[0] or 0) + 1
        ended = spark.createDataFrame([(self.run_id, outcome, seq)], "run_id string, outcome string, seq long").withColumn("ts", F.current_timestamp())
        store.append("outcomes", ended)
        ended = store.table("outcomes").where(F.col("run_id") == self.run_id)
        if store.settings.reinforce:
            turns, bonds = grading.graded(store.table("marks"), ended)
            store.append("turn_events", turns if store.settings.hold_unproven else turns.where("kind <> 'planted'"))
            if store.settings.scatter:
                store.append("bond_events", bonds)
        self.run_id = None


def builtin_tools(store: Store, session: Session | None = None) -> Registry:
    """The nine tools over a store. Results are texts of bounded length.

    A store has one writer at a time: ids and event numbers follow the highest there is.
    """
    spark, registry, settings = store.spark, Registry(), store.settings
    session = session or Session(store)
    now = F.current_timestamp()

    def next_number(table: str, column: str) -> int:
        return (store.table(table).agg(F.max(column)).first()[0] or 0) + 1

    def one_query(text: str):
        return spark.createDataFrame([(0, text)], "query_id long, text string")

    def write_event(**values: Any) -> None:
        kinds = {"event": "long", "id": "long", "reset": "boolean"}
        columns = ", ".join(f"{k} {kinds.get(k, 'string')}" for k in values)
        store.append("fact_events", spark.createDataFrame([tuple(values.values())], columns).withColumn("created_at", now))

    @registry.tool("remember", "Write one fact, or correct one.", read_only=False)
    def remember(fact: str, category: str = "fact", context: str = "", cues: str | None = None, replaces: int | None = None) -> str:
        fact = (fact or "").strip()
        if not fact:
            return "ERROR: a fact needs text"
        if replaces is not None and (type(replaces) is not int or replaces <= 0):
            return "ERROR: replaces must be a positive id"
        if cues is not None and not isinstance(cues, str):
            return "ERROR: cues must be text"
        category = category if category in dict(V.CATEGORY_FOLDERS) else "fact"
        facts, event, lineage = store.facts(), next_number("fact_events", "event"), session.lineage()
        row = spark.createDataFrame([(fact, lineage, cues)], "fact string, lineage string, cues string")
        note, own_cues = row.select(T.cue_note(F.col("fact")), F.when(F.col("cues").isNotNull(), T.retrieval_cues(F.col("cues")))).first()
        near = store.merge_candidates(fact, event) if replaces is None else None
        found = merge.write_decision(row, facts if near is None else store.facts(near), grading.standing(facts), now, replaces).first()
        if found is None and replaces is not None:
            return f"ERROR: there is no memory #{replaces}"
        if found is None:
            write_event(event=event, op="insert", id=event, fact=fact, category=category, context=context, cues=own_cues or "", lineage=lineage, grafted="")
            session.plant(event)
            return f"Remembered #{event}. {note}".strip()
        if found["action"] == "restated":
            session.plant(found["id"])
            return f"Already held as #{found['id']}, in fuller words: {found['old_fact']}"
        reset = found["changed"] or found["demoted"]
        values: dict[str, Any] = {"event": event, "op": "update", "id": found["id"], "fact": fact, "category": category, "lineage": lineage, "reset": reset}
        if context or replaces is not None:
            values["context"] = context
        if own_cues is not None:
            values["cues"] = own_cues
        if found["kin"] == "grove" and found["old_tree"] != "import":
            record = spark.createDataFrame([(found["grafted"], found["old_tree"], found["uses"], found["wins"])], "g string, t string, u long, w long")
            values["grafted"] = record.select(grading.graft_record(F.col("g"), F.col("t"), F.col("u"), F.col("w"))).first()[0]
        write_event(**values)
        session.plant(found["id"])
        why = (
            " (the claim changed: its rank starts over)" if found["changed"]
            else f" (taken from the {found['old_tree']} tree, which stands better: its rank starts over)" if found["demoted"]
            else " (in place of words that nothing could find)" if found["elaborated"]
            else ""
        )
        return f"Updated #{found['id']}{why}: {fact} {note}".strip()

    @registry.tool("recall", "Find facts.")
    def recall_facts(query: str, limit: int = 0, history_id: int = 0) -> str:
        if history_id:
            rows = recall.history(store.revisions().where(F.col("id") == int(history_id)), limit or 8).orderBy("pos").collect()
            shown = [f"{'now' if r.current else f'until {r.superseded_at:%Y-%m-%d %H:%M}'}: {r.fact}" for r in rows]
            return f"History of #{history_id}:\n" + "\n".join(shown) if rows else f"No memory #{history_id}."
        facts, asked = store.facts(), one_query(query)
        facts = facts if settings.routing else facts.drop("folder")
        hits = recall.recall(asked, facts, limit or settings.recall_limit, None, store.bonds() if settings.scatter else None, now, spread=settings.scatter).cache()
        rows = hits.join(facts, hits["key"] == facts["id"].cast("string")).orderBy("rank").collect()
        if rows and session.run_id and settings.reinforce:
            store.append("marks", grading.turn_marks(hits, asked, facts, session.run_id))
        hits.unpersist()
        return "\n".join(f"#{r.id} [{r.category}] {r.fact}  ({r.created_at:%Y-%m-%d})" for r in rows) or f"No memories matching {query!r}. Stored facts: {facts.count()}."

    @registry.tool("list_memories", "The newest facts.")
    def list_memories(limit: int = 30) -> str:
        facts = store.facts()
        rows = facts.orderBy(F.desc("id")).limit(max(1, min(int(limit), 500))).collect()
        shown = "\n".join(f"#{r.id} [{r.category}] {r.fact}  ({r.created_at:%Y-%m-%d})" for r in rows)
        return f"{shown}\n{len(rows)} of {facts.count()} memories" if rows else "Memory is empty."

    @registry.tool("forget", "Delete a fact.", read_only=False, requires_confirm=True)
    def forget(id: int) -> str:
        if store.facts().where(F.col("id") == int(id)).isEmpty():
            return f"No memory #{id}."
        write_event(event=next_number("fact_events", "event"), op="forget", id=int(id))
        return f"Forgot #{id}."

    @registry.tool("trust_memory", "Vouch for a fact.", read_only=False, internal=True)
    def trust_memory(id: int) -> str:
        if store.facts().where(F.col("id") == int(id)).isEmpty():
            return f"No memory #{id}."
        write_event(event=next_number("fact_events", "event"), op="trust", id=int(id))
        return f"Trusted #{id}."

    @registry.tool("move_memory", "File a fact elsewhere.", read_only=False, internal=True)
    def move_memory(id: int, folder: str) -> str:
        if store.facts().where(F.col("id") == int(id)).isEmpty():
            return f"No memory #{id}."
        clean = spark.createDataFrame([(folder,)], "f string").select(T.clean_folder(F.col("f"))).first()[0]
        write_event(event=next_number("fact_events", "event"), op="move", id=int(id), folder=clean)
        return f"Moved #{id} to {clean or 'no folder'}."

    @registry.tool("learn_task", "Teach a shortcut.", read_only=False)
    def learn_task(trigger: str, resolution: str) -> str:
        row = (next_number("patterns", "seq"), trigger, resolution, True)
        store.append("patterns", spark.createDataFrame([row], "seq long, trigger string, resolution string, taught boolean"))
        return f"Learned {trigger!r}."

    @registry.tool("forget_task", "Delete a shortcut.", read_only=False, internal=True)
    def forget_task(trigger: str) -> str:
        row = (next_number("patterns", "seq"), "forget", trigger)
        store.append("patterns", spark.createDataFrame([row], "seq long, op string, trigger string"))
        return f"Forgot {trigger!r}."

    @registry.tool("recall_task", "Find shortcuts for a request, and how a like one went.")
    def recall_task(request: str) -> str:
        known, asked = store.patterns(), one_query(request)
        uses = store.table("pattern_uses")
        fired = uses.join(known.select("key", "id"), "key").select(F.col("ts").alias("turn"), "id")
        hits = tasks.predict_with_related(asked, known, tasks.cofire_edges(fired))
        shown = [f"{r.trigger}: {r.resolution}" + (" (related)" if r.related else "") for r in hits.join(known, "id").orderBy("rank").collect()]
        episode = tasks.similar_episode(asked, store.table("episodes")).join(store.table("episodes"), "id").first()
        if episode:
            shown.append(f"Before, {episode.ts:%Y-%m-%d}: {episode.request} -> {episode.summary or 'done'}")
        return "\n".join(shown) or "Nothing learned for that."

    def held(handle: str):
        """The body of a handle, or an error that says what is known of it."""
        if not session.reading:
            raise ValueError("reading back is off")
        asked = spark.createDataFrame([(handle, "run")], "handle string, conv_id string")
        grants = None if session.grants is None else spark.createDataFrame([("run", h) for h in session.grants], "conv_id string, handle string")
        live, tombs = store.held(), store.table("tombs")
        kind, number = F.left("handle", F.lit(1)).alias("kind"), ledger.handle_number(F.col("handle"))
        swept = tombs.groupBy(kind).agg(F.max(number).alias("mark"))
        status = ledger.handle_status(asked, live, swept, store.graves(), grants).first()["status"]
        if status == "live":
            store.append("touches", spark.createDataFrame([(handle,)], "handle string").withColumn("ts", now))
            return store.bodies(live.where(F.col("handle") == handle)).select("handle", "body").limit(1)
        if status == "expired":
            was = ledger.tomb_meta(asked, tombs).first()
            raise ValueError(f"{handle} has expired" + (f"; it held {was.chars} characters of {was.tool}, which can be run again" if was else ""))
        session.misses += 1
        others = [r.handle for r in ledger.live_handles(store.bodies(live)).collect()] if grants is None else sorted(session.grants)
        raise ValueError(f"no held text under {handle!r}; there are {', '.join(others) or 'none'}")

    @registry.tool("fold_peek", "Lines of a held text.")
    def fold_peek(handle: str, start: int = 1, count: int = 60, part: int = 0) -> str:
        body = held(handle)
        if part >= 1:
            pieces = fold.line_parts(body).where((F.col("line_no") == start) & (F.col("part") == part)).collect()
            return f"{handle} line {start}, part {part}:\n{pieces[0].text}" if pieces else f"{handle} has no part {part} of line {start}"
        seen, reached, lost = session.walk(handle)
        kinds = "handle string, start int, count int, seen long, reached int, lost long"
        page = readback.pages(body, spark.createDataFrame([(handle, start, count, seen, reached, lost)], kinds)).first()
        if page["last"] is not None:
            session.walk(handle, page["last"])
        return page["text"]

    @registry.tool("fold_grep", "Matching lines of a held text.")
    def fold_grep(handle: str, pattern: str, max_hits: int = 40) -> str:
        checked_pattern(pattern)
        body = held(handle)
        return readback.grep_within(body, pattern, settings.read_seconds, max_hits).first()["text"]

    @registry.tool("fold_stats", "One aggregate over a column of a held table, or a count of lines.")
    def fold_stats(handle: str, column: str = "", op: str = "count", where: str | None = None) -> str:
        if op not in (*fold.STATS, "top"):
            return f"ERROR: no aggregate {op!r}; there are {', '.join((*fold.STATS, 'top'))}"
        if where:
            checked_pattern(where)
        body = held(handle)
        if not column:
            if op != "count":
                return f"ERROR: {op} needs a column"
            lines = within(spark, settings.read_seconds, lambda: fold.line_count(body, where).first())
            return f"{handle}: {lines.matched} of {lines.scanned} lines\ncount = {lines.matched}"
        wanted = spark.createDataFrame([(handle, column, where or None)], "handle string, column string, pattern string")
        shape = fold.sniff(body).first()
        if shape is None:
            return f"ERROR: {handle} is no delimited text, so it has no columns; count lines without one"
        row = within(spark, settings.read_seconds, lambda: fold.column_stats(body, wanted).first())
        if row is None:
            return f"ERROR: {handle} has no column {column!r}; its columns are {', '.join(shape['columns'])}"
        told = f"(rows {row.matched} of {row.scanned}, numbers {row.numeric}, skipped {row.skipped}, ragged {row.ragged})"
        if op == "top":
            best = fold.column_top(body, wanted).orderBy("rank").collect()
            return "\n".join([f"top({column}) {told}", *(f"  {r.value}: {r.n}" for r in best)])
        if op in ("count", "distinct"):
            return f"{op}({column}) = {row['matched'] if op == 'count' else row['distinct']} {told}"
        if row[op] is None:
            return f"{op}({column}): no numbers in this column {told}"
        value = spark.createDataFrame([(float(row[op]),)], "v double").select(T.number_text(F.col("v"))).first()[0]
        return f"{op}({column}) = {value} {told}"

    return registry
