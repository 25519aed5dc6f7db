"""Structured Streaming forms of the per-session operators.

* ``stream_prompt_kind`` (O9), ``stream_context_at_turn`` (O3) and
  ``stream_revision_diff`` (O18) keep a small typed state per session,
  conversation or document with ``transformWithStateInPandas`` (the state store
  must be RocksDB). A key's rows of a micro-batch come in chunks and in any
  order. Each chunk is cut down to the few numbers that the rule needs (no
  text), these are sorted, and the results go out in chunks; a row whose order
  is not after the last one seen is flagged ``late``, has NULL results and does
  not move the state.
* With ``idle_timeout_ms`` a key's state is dropped after that much processing
  time without rows: by the state's time to live where all of it is written
  with every batch (O9), by a timer elsewhere.
* ``stream_latest_nonempty`` (O17) is the batch ``max_by`` aggregate run in
  update mode: the order key decides, so late rows are harmless.

Word counts, state digests and line digests are native expressions computed
before the Python handlers; these only walk numbers.
"""

from __future__ import annotations

import bisect
from collections import Counter, deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.functions.text import speaker_words
from parley.operators.completions import latest_nonempty, text_lines
from parley.operators.prompts import CONTEXTFUL, CONTEXTLESS

#: Rows in one chunk of results.
CHUNK_ROWS = 10_000


def _chunks(n: int) -> Iterator[slice]:
    return (slice(i, min(i + CHUNK_ROWS, n)) for i in range(0, n, CHUNK_ROWS))


def _time_mode(idle_timeout_ms: int | None) -> str:
    return "ProcessingTime" if idle_timeout_ms else "None"


class _Idle(StatefulProcessor):
    """A processor whose state is cleared by a timer after ``idle_ms`` without rows."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def postpone(self, now_ms: int) -> None:
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now_ms + int(self.idle_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        return iter([])

    def close(self) -> None:
        pass


# ------------------------------------------------------------- O9 stream --
class _KindProcessor(StatefulProcessor):
    """State: the last order key, and the digest of the last answered state."""

    def __init__(self, order_types: str, order: list[str], ttl_ms: int | None):
        self.order_types, self.order, self.ttl_ms = order_types, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kind", f"{self.order_types}, has_prev boolean, prev string", self.ttl_ms)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        order, digests, answered = [], [], []
        for pdf in rows:  # a few numbers and 32 characters a row
            order.append([pdf[c].to_numpy() for c in self.order])
            digests.append(pdf["st"].to_numpy(dtype="U32"))
            answered.append(pdf["answered"].fillna(False).to_numpy(dtype=bool))
        cols = [np.concatenate([o[i] for o in order]) for i in range(len(self.order))]
        at = np.lexsort(cols[::-1])
        cols = [c[at] for c in cols]
        digest, answered = np.concatenate(digests)[at], np.concatenate(answered)[at]
        state = self.state.get() if self.state.exists() else None
        n = len(at)
        same = np.ones(n, dtype=bool)  # as the row before: late too
        same[0] = False
        for c in cols:
            same[1:] &= c[1:] == c[:-1]
        late = same
        if state is not None:
            last = tuple(_plain(x) for x in state[:len(cols)])
            late[:bisect.bisect_right(range(n), last, key=lambda i: tuple(_plain(c[i]) for c in cols))] = True
        counts = answered & ~late
        before = np.maximum.accumulate(np.where(counts, np.arange(n), -1))
        before = np.concatenate([[-1], before[:-1]])  # the last answered row before each
        has_prev, prev = (bool(state[-2]), state[-1]) if state is not None else (False, None)
        known = np.where(before >= 0, digest[before] == digest, has_prev & (digest == (prev or "")))
        for part in _chunks(n):
            out = pd.DataFrame({c: v[part] for c, v in zip(self.order, cols, strict=True)})
            out.insert(0, "session", [key[0]] * len(out))
            kind = np.where(known[part], CONTEXTLESS, CONTEXTFUL).astype(object)
            kind[late[part]] = None
            yield out.assign(prompt_kind=kind, late=late[part])
        if counts.any():
            has_prev, prev = True, str(digest[np.flatnonzero(counts)[-1]])
        if not late.all():
            self.state.update((*(_python(c[-1]) for c in cols), has_prev, prev))
        elif self.ttl_ms:
            self.state.update(tuple(state))


def _plain(x):
    """A comparable form of an order value."""
    if isinstance(x, np.datetime64):
        return pd.Timestamp(x).value
    if hasattr(x, "timestamp") and not isinstance(x, (int, float, str)):
        return pd.Timestamp(x).tz_localize(None).value
    return x.item() if hasattr(x, "item") else x


def _python(x):
    """An order value as the state keeps it."""
    if isinstance(x, np.datetime64):
        return pd.Timestamp(x).to_pydatetime()
    return x.item() if hasattr(x, "item") else x


def stream_prompt_kind(events: DataFrame, *, session: str = "session_id",
                       seq: str | Sequence[str] = "seq", state: Sequence[str] = ("state",),
                       answered: str | Column = "answered",
                       idle_timeout_ms: int | None = None) -> DataFrame:
    """Streaming O9: ``session, <seq columns>, prompt_kind, late`` per
    question, ordered by ``seq`` (one or several columns, compared in order; not
    NULL).

    The state compared is the 128-bit digest of ``to_json(struct(state))``, so a
    NULL state and a missing state differ. Kept per session: the last order key
    and the digest of the last answered state."""
    order = [seq] if isinstance(seq, str) else list(seq)
    ans = F.col(answered) if isinstance(answered, str) else answered
    types = {c: events.schema[c].dataType.simpleString() for c in order}
    # Times travel as microseconds: exact, and alike in rows and in the state.
    times = {c: t for c, t in types.items() if t in ("timestamp", "timestamp_ntz", "date")}
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if c in times else F.col(c)
    inp = events.select(F.col(session).alias("session"), *[micros(c).alias(c) for c in order],
                        F.md5(F.to_json(F.struct(*[F.col(c) for c in state]))).alias("st"),
                        ans.alias("answered"))
    typed = ", ".join(f"{c} {inp.schema[c].dataType.simpleString()}" for c in order)
    out = inp.groupBy("session").transformWithStateInPandas(
        _KindProcessor(typed, order, int(idle_timeout_ms) if idle_timeout_ms else None),
        f"session {inp.schema['session'].dataType.simpleString()}, {typed}, prompt_kind string, late boolean",
        "append", _time_mode(idle_timeout_ms))
    return out.select("session", *[F.timestamp_micros(c).cast(times[c]).alias(c) if c in times else F.col(c) for c in order],
                      "prompt_kind", "late")


# ------------------------------------------------------------- O3 stream --
class _ContextProcessor(_Idle):
    """State: a few numbers, and the kept turns with their words as a list that
    is appended to while nothing is dropped from it."""

    def __init__(self, key: str, order: str, idle_ms: int | None):
        super().__init__(idle_ms)
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "w0 long, last long, most long")
        self.kept = handle.getListState("kept", "turn long, words long")

    def forget(self) -> None:
        self.seen.clear()
        self.kept.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [pdf[["t", "is_user", "n", "lim"]].fillna({"lim": 0, "is_user": False}).to_numpy(dtype=np.int64) for pdf in rows]
        row = np.concatenate(parts)  # four numbers a row
        row = row[np.argsort(row[:, 0], kind="stable")]
        w0, last, most = self.seen.get() if self.seen.exists() else (None, None, 0)
        kept = deque((int(t), int(w)) for t, w in self.kept.get()) if w0 is not None else deque()
        total, dropped, fresh = sum(w for _, w in kept), 0, len(kept)
        out: list[tuple] = []

        def trim(limit: int) -> None:
            nonlocal total, dropped
            while w0 + total > limit and len(kept) > 1:
                total -= kept.popleft()[1]
                dropped += 1

        for i in range(len(row)):
            t, is_user, n, limit = (int(x) for x in row[i])
            if last is not None and t <= last:
                out.append((t, None, None, None, None, True))
            else:
                last, most = t, max(most, limit)
                if w0 is None:
                    w0 = n
                    if is_user:
                        out.append((t, None, 1, w0, "overflow" if w0 > limit else "ok", False))
                else:
                    kept.append((t, n))
                    total += n
                    if is_user:
                        trim(limit)
                        out.append((t, kept[0][0], len(kept) + 1, w0 + total, "overflow" if w0 + total > limit else "ok", False))
                    elif len(kept) % 1024 == 0:
                        trim(most)  # never more kept turns than the largest limit has words
            if len(out) >= CHUNK_ROWS:
                yield self.told(key, out)
                out = []
        trim(most)
        if w0 is not None:
            self.seen.update((w0, last, most))
            if dropped:
                self.kept.put(list(kept)) if kept else self.kept.clear()
            elif len(kept) > fresh:
                self.kept.appendList([kept[i] for i in range(fresh, len(kept))])
        self.postpone(timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else 0)
        if out:
            yield self.told(key, out)

    def told(self, key, rows: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=[self.order, "first_kept", "turns_sent", "words", "status", "late"])
        df.insert(0, self.key, [key[0]] * len(df))
        return df.astype({"first_kept": "Int64", "turns_sent": "Int64", "words": "Int64"})


def stream_context_at_turn(turns: DataFrame, limit: int | Column, *, key: str = "conv_id",
                           order: str = "turn", role: str = "role",
                           user_role: str = "user",
                           idle_timeout_ms: int | None = None) -> DataFrame:
    """Streaming O3: per user turn ``conv_id, turn, first_kept, turns_sent,
    words, status, late``. ``limit`` may be a column: each user turn has its
    own (NULL: 0). State: the pinned row's words and the kept turns with their
    words. They are trimmed whenever they are saved, also between user turns, to
    what fits the largest limit met so far (each turn has a word at least, so
    that many turns, and the newest), so a later turn cannot bring back what did
    not fit then. Late turns have NULL results and are in no later context."""
    lim_col = limit if isinstance(limit, Column) else F.lit(limit)
    inp = turns.select(F.col(key).alias("k"), F.col(order).cast("long").alias("t"),
                       (F.col(role) == user_role).alias("is_user"),
                       speaker_words("text").alias("n"), lim_col.cast("long").alias("lim"))
    inp = inp.withColumn("lim", F.coalesce("lim", F.lit(0))).withColumn("is_user", F.coalesce("is_user", F.lit(False)).cast("int"))
    out = (f"{key} {inp.schema['k'].dataType.simpleString()}, {order} long, first_kept long, turns_sent long, "
           f"words long, status string, late boolean")
    return inp.groupBy("k").transformWithStateInPandas(
        _ContextProcessor(key, order, idle_timeout_ms), out, "append", _time_mode(idle_timeout_ms))


# ------------------------------------------------------------ O17 stream --
def stream_latest_nonempty(log: DataFrame, value: str, **kw) -> DataFrame:
    """Streaming O17: the batch aggregate, to be written in ``update`` mode."""
    return latest_nonempty(log, value, **kw)


# ------------------------------------------------------------ O26 stream --
def stream_settings_upsert(changes: DataFrame, *, owner: str = "owner", key: str = "key",
                           value: str = "value", seq: str = "seq") -> DataFrame:
    """Streaming O26, written in ``update`` mode: each changed key emits its
    latest value; a deletion surfaces as a NULL value (a downstream upsert
    removes the key)."""
    latest = changes.groupBy(owner, key).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.col(seq)).alias("_last"))
    return latest.select(owner, key, F.col("_last.v").alias(value))


# ------------------------------------------------------------ O18 stream --
class _DiffProcessor(_Idle):
    """State: the last version, and a map from each line's digest to how often
    the version has it. Only the lines that a batch changed are written."""

    def __init__(self, doc: str, version: str, idle_ms: int | None):
        super().__init__(idle_ms)
        self.doc, self.version = doc, version

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "version long")
        self.lines = handle.getMapState("lines", "line string", "n long")

    def forget(self) -> None:
        self.last.clear()
        self.lines.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, Counter]] = []
        for pdf in rows:  # digests, counted version by version
            found += [(int(v), Counter(x)) for v, x in zip(pdf["v"], pdf["x"], strict=True)]
        found.sort(key=lambda r: r[0])
        last = self.last.get()[0] if self.last.exists() else None
        stored = {k[0]: int(n[0]) for k, n in self.lines.iterator()} if last is not None else {}
        prev: dict[str, int] = stored
        out = []
        for v, cur in found:
            if last is not None and v <= last:
                out.append((v, None, None, True))
                continue
            out.append((v, sum(max(n - prev.get(line, 0), 0) for line, n in cur.items()),
                        sum(max(n - cur.get(line, 0), 0) for line, n in prev.items()), False))
            last, prev = v, cur
        if prev is not stored:
            self.last.update((last,))
            for line in stored.keys() - prev.keys():
                self.lines.removeKey((line,))
            for line, n in prev.items():
                if stored.get(line) != n:
                    self.lines.updateValue((line,), (n,))
        self.postpone(timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else 0)
        for part in _chunks(len(out)):
            df = pd.DataFrame(out[part], columns=[self.version, "lines_added", "lines_removed", "late"])
            df.insert(0, self.doc, [key[0]] * len(df))
            yield df.astype({"lines_added": "Int64", "lines_removed": "Int64"})


def stream_revision_diff(versions: DataFrame, *, doc: str = "doc_id",
                         version: str = "version", text: str = "text",
                         idle_timeout_ms: int | None = None) -> DataFrame:
    """Streaming O18: ``doc, version, lines_added, lines_removed, late`` per
    version, against the previous version seen for the document. State: a
    128-bit digest and a count of each line of the latest version, not the
    lines; a new version writes the lines that it changed. Late versions have
    NULL counts."""
    inp = versions.select(F.col(doc).alias("d"), F.col(version).cast("long").alias("v"),
                          F.transform(text_lines(F.col(text)), F.md5).alias("x"))
    out = (f"{doc} {inp.schema['d'].dataType.simpleString()}, {version} long, lines_added long, "
           f"lines_removed long, late boolean")
    return inp.groupBy("d").transformWithStateInPandas(
        _DiffProcessor(doc, version, idle_timeout_ms), out, "append", _time_mode(idle_timeout_ms))
